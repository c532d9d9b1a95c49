"""Embedding near-duplicates: sign hashes of random hyperplanes, exact cosines, connected components.

Equal vectors are one class from the start, so copies make no pairs. Each class gets a
sign hash in several tables and a sketch of 128 further signs. Buckets are met twice: first
by sketches, which tell the classes with a neighbour that may be near enough; then only
those bring their vectors, and are compared exactly. A pair is counted in the first table
where it meets, so links are counted once without shuffling pairs, and each bucket returns
counts and a spanning forest, never pairs. Buckets beyond a size are cut into chunks, and
chunk pairs are compared apart.
"""

from __future__ import annotations

from functools import cache
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import checkpointed, map_batches
from foliolens.llm.components import connected_components, local_labels
from foliolens.llm.vectors import matrix, takes_part, usable

THRESHOLD = 0.9
#: Share of the pairs right at the threshold that some table must catch; closer pairs are caught more often.
RECALL = 0.995
#: Classes that a bucket is meant to hold, and from where it is cut into chunks of half that size.
BUCKET_ROWS, CHUNKED_ROWS = 512, 4096
#: Signs in a sketch, and by how many deviations a pair at the threshold may exceed the signs it is expected to differ in (a share of 3e-5 does).
SKETCH, DEVIATIONS = 128, 4


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int]:
    """(bits in a hash, tables) for ``n`` classes."""
    bits = min(24, max(4, ceil(log2(max(n, 1) / bucket_rows)) if n > bucket_rows else 4))
    meet = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(1 - recall) / log(1 - meet))


@cache
def _planes(dim: int, count: int, kind: int = 0) -> np.ndarray:
    return np.random.default_rng([dim, kind] if kind else dim).standard_normal((dim, count))


def levelled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, each divided by a power of two near its largest component: cosines stay as they are, squares don't overflow."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def sign_hashes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of each row in each table."""
    signs = (levelled(x) @ _planes(x.shape[1], bits * tables)) > 0
    return (signs.reshape(len(x), tables, bits) * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def sketches(x: np.ndarray) -> np.ndarray:
    """Signs to further planes, 64 in a number."""
    signs = (levelled(x) @ _planes(x.shape[1], SKETCH, 1)) > 0
    return np.packbits(signs, axis=1).view(np.uint64)


def widest(threshold: float) -> int:
    """Signs of a sketch that a pair near enough differs in at most."""
    share = acos(threshold) / pi
    return int(SKETCH * share + DEVIATIONS * sqrt(SKETCH * share * (1 - share)))


def with_neighbours(sketch: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Whether a row has a partner, over the pairs of ``left`` and ``right`` rows, whose sketch differs in ``most`` signs or fewer."""
    out = np.zeros(len(sketch), bool)
    for k in range(0, len(left), 512):
        some = left[k : k + 512]
        apart = np.zeros((len(some), len(right)), np.uint8)
        for word in sketch.T:
            apart += np.bitwise_count(word[some][:, None] ^ word[right][None, :])
        near = (apart <= most) & (some[:, None] != right[None, :])
        out[some] |= near.any(axis=1)
        out[right] |= near.any(axis=0)
    return out


def bucket_links(x: np.ndarray, mult: np.ndarray, sigs: np.ndarray, table: int, left: np.ndarray, right: np.ndarray,
                 threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(linked vectors of each row, smallest row of its group) over the pairs of ``left`` and ``right`` rows.

    Where both are the same rows, each pair counts once; pairs that met in an earlier
    table are left out of the counts and, being linked there, of the groups.
    """
    x = levelled(x)
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / norm[:, None]
    same = left is right
    counts, labels = np.zeros(len(x), np.int64), np.arange(len(x))
    for k in range(0, len(left), 512):
        some = left[k : k + 512]
        i, j = np.nonzero(unit[some] @ unit[right].T >= threshold - 1e-9)
        a, b = some[i], right[j]
        if same:
            a, b = a[i + k < j], b[i + k < j]
        if table:
            fresh = ~(sigs[a, :table] == sigs[b, :table]).any(axis=1)
            a, b = a[fresh], b[fresh]
        exact = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]) >= threshold
        a, b = a[exact], b[exact]
        counts += np.bincount(a, mult[b], len(x)).astype(np.int64) + np.bincount(b, mult[a], len(x)).astype(np.int64)
        labels = local_labels(len(x), a, b, labels)
    return counts, labels


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
                    recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    n_links counts the other rows linked directly, equal vectors included; component_id
    is the smallest vec_id reachable; kept says that it is the row's own. Rows whose
    vector is null, empty, zero or not finite link with nothing, and vectors of another
    length link with none of the others. Rows with a null id are returned with no links,
    a null component and kept false. An empty table gives an empty result. A link right at
    the threshold is lost with a probability of 1 - ``recall`` (and 3e-5), a closer one with
    less (0.97 or more: below 1e-4 of them); none is added. Other columns are not read.
    """
    rows = usable(df, vec_id, embedding)
    classes = checkpointed(rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")))
    bits, tables = plan_tables(classes.count(), threshold, recall)
    most = widest(threshold)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors, sizes = batch.column(0), batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        hashes, signs = np.zeros((len(sizes), tables), np.int64), np.zeros((len(sizes), SKETCH // 64), np.uint64)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            x = matrix(vectors.take(pa.array(own)))
            hashes[own], signs[own] = sign_hashes(x, bits, tables), sketches(x)
        # A bucket's key: length of the vectors, table, hash.
        hashes += (sizes.astype(np.int64)[:, None] << 39) + (np.arange(tables) << 24)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * tables), pa.array(hashes.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(1), lists, *(pa.array(w.view(np.int64)) for w in np.ascontiguousarray(signs.T))], names=["rep", "buckets", "s0", "s1"])

    signed = checkpointed(map_batches(classes.select("embedding", "rep"), sign, "rep bigint, buckets array<bigint>, s0 bigint, s1 bigint"))
    placed = signed.select(F.explode("buckets").alias("bucket"), "rep", "s0", "s1")
    large = checkpointed(
        placed.groupBy("bucket").count().where(F.col("count") > CHUNKED_ROWS).select("bucket", F.ceil(F.col("count") / (CHUNKED_ROWS // 2)).cast("int").alias("chunks")))
    whole = [F.lit(0).alias(c) for c in ("low", "high", "chunk")]
    if large.isEmpty():
        dealt = placed.select("bucket", *whole, "rep", "s0", "s1")
    else:
        chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(F.col("chunk"), j).alias("low"), F.greatest(F.col("chunk"), j).alias("high")))
        dealt = (
            placed.join(large, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            .withColumn("chunk", chunk).withColumn("cell", F.explode(cells)).select("bucket", "cell.low", "cell.high", "chunk", "rep", "s0", "s1")
        )

    def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own, low, high = table["chunk"].to_numpy(), table["low"][0].as_py(), table["high"][0].as_py()
        left = np.flatnonzero(own == low)
        return left, left if low == high else np.flatnonzero(own == high)

    def look(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sketch = np.stack([table[c].to_numpy().view(np.uint64) for c in ("s0", "s1")], axis=1)
        near = with_neighbours(sketch, *sides(table), most)
        return table.drop_columns(["s0", "s1"]).filter(pa.array(near))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.take(pa.array(np.argsort(table["rep"].to_numpy(), kind="stable")))
        rep, tbl = table["rep"].to_numpy(), table["bucket"][0].as_py() >> 24 & 0x7FFF
        counts, labels = bucket_links(matrix(table["embedding"]), table["mult"].to_numpy(), matrix(table["buckets"]), tbl, *sides(table), threshold)
        some = np.flatnonzero((counts > 0) | (labels != np.arange(len(rep))))
        return pa.table({"rep": rep[some], "n": counts[some], "a": rep[labels[some]]})

    cell = ["bucket", "low", "high"]
    near = checkpointed(dealt.groupBy(*cell).applyInArrow(look, "bucket bigint, low int, high int, chunk int, rep bigint"))
    vectors = near.join(classes, "rep").join(signed.select("rep", "buckets"), "rep")
    found = checkpointed(vectors.select(*cell, "chunk", "rep", "mult", "embedding", "buckets").groupBy(*cell).applyInArrow(compare, "rep bigint, n bigint, a bigint"))
    groups = connected_components(found.select("a", F.col("rep").alias("b")))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    of_class = (
        classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("embedding", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = rows.join(of_class, "embedding", "left").select("vec_id", "n_links", "component_id")
    others = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding")).where(
        F.col("vec_id").isNull() | ~takes_part(F.col("embedding"))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(others).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))

