"""Near-duplicates by the exact Jaccard similarity of sets of word shingles.

Texts with equal sets are one class. MinHash bands propose: classes that share a band are
tied to the smallest of them, and what hangs together is one candidate group, so each
candidate's text travels once for its group and pairs are never shuffled. Inside a group
the sets themselves are compared; large groups are cut into chunks, and chunk pairs are
compared apart. A pair right at the threshold that shares no band is lost with a
probability of 5e-8 (0.8, 32 bands of 4), closer pairs with less; none is added wrongly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import checkpointed, map_batches
from foliolens.llm.components import connected_components, local_labels

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 4
#: Classes that a chunk of a candidate group is meant to hold, and the most chunks of a group.
CHUNK_ROWS, MOST_CHUNKS = 128, 64
SEED = 42

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xBF58476D1CE4E5B9)
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)[:, None]
_ODD = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)[:, None] | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _LAST
    return h ^ (h >> np.uint64(27))


def shingle_set(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles; words as in ``simhash_vp.fingerprint``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle_words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype=np.uint64)
    n = len(hashes) - shingle_words + 1
    out = hashes[:n].copy()
    for k in range(1, shingle_words):
        out = _mixed(out) * _MIX + hashes[k : k + n]
    return np.unique(_mixed(out))


def bands(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of minima; sets that share a key are candidates."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        np.minimum(least, ((shingles[None, k : k + 512] ^ _XOR) * _ODD).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = _mixed(keys * _MIX + column)
    return keys.view(np.int64)


def set_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Smallest reachable index of each set over the pairs of ``left`` and ``right`` at the threshold or above.

    Pairs that hang together already are passed over: they change no group.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    held, labels = np.zeros(len(words), bool), np.arange(len(sets))
    for p in left:
        others = right[(labels[right] != labels[p]) & (np.minimum(sizes[right], sizes[p]) >= threshold * np.maximum(sizes[right], sizes[p]))]
        if not len(others):
            continue
        held[own[p]] = True
        starts = np.concatenate(([0], np.cumsum(sizes[others])[:-1]))
        shared = np.add.reduceat(held[np.concatenate([own[o] for o in others])].astype(np.int64), starts)
        held[own[p]] = False
        near = others[shared / (sizes[p] + sizes[others] - shared) >= threshold]
        labels = local_labels(len(sets), np.full(len(near), p), near, labels)
    return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, component_id) of each row: groups linked by sets of shingles at ``threshold`` or above.

    component_id is the smallest id reachable; ids must be integers. A row with a null id
    takes part in no link and belongs to the group of its equals, if any. Texts without
    words are equals. An empty table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, shingle_words) for t in batch.column(1).to_pylist()]
        keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "key", "bands"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = checkpointed(map_batches(rows, sign, f"doc_id {kind}, key binary, bands array<bigint>"))
    classes = checkpointed(signed.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").cast("bigint").alias("rep"), F.first("bands").alias("bands")))
    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("band", "a")
    tied = connected_components(banded.join(shared, "band").select("a", F.col("rep").alias("b")))
    members = checkpointed(tied.unionByName(tied.select(F.col("component").alias("node"), "component").distinct()))

    large = members.groupBy("component").count().where(F.col("count") > 2 * CHUNK_ROWS).select(
        "component", F.least(F.ceil(F.col("count") / CHUNK_ROWS), F.lit(MOST_CHUNKS)).cast("int").alias("chunks"))
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(F.col("chunk"), j).alias("low"), F.greatest(F.col("chunk"), j).alias("high")))
    placed = members.join(large, "component", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))

    def with_set(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, shingle_words).tobytes() for t in batch.column(4).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], names=["component", "node", "chunks", "chunk", "shingles"])

    texts = rows.join(placed, F.col("doc_id") == F.col("node")).select("component", "node", "chunks", "chunk", "text")
    dealt = (
        map_batches(texts, with_set, "component bigint, node bigint, chunks int, chunk int, shingles binary").where(F.length("shingles") > 0)
        .withColumn("cell", F.explode(cells)).select("component", "cell.low", "cell.high", "chunk", "node", "shingles")
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.take(pa.array(np.argsort(table["node"].to_numpy(), kind="stable")))
        node, chunk = table["node"].to_numpy(), table["chunk"].to_numpy()
        left, right = np.flatnonzero(chunk == table["low"][0].as_py()), np.flatnonzero(chunk == table["high"][0].as_py())
        labels = set_links([np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()], left, right, threshold)
        linked = labels != np.arange(len(node))
        return pa.table({"a": pa.array(node[labels[linked]], pa.int64()), "b": pa.array(node[linked], pa.int64())})

    found = connected_components(dealt.groupBy("component", "low", "high").applyInArrow(compare, "a bigint, b bigint"))
    groups = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    return signed.select("doc_id", "key").join(groups, "key", "left").select("doc_id", "component_id")
