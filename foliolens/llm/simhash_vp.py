"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Two fingerprints within 3 bits differ in at most 1 bit of their upper or of their lower
half, and agree in one of their four quarters. So there is one tree for each part, whose
metric is the Hamming distance of that part and whose search radius is 1 for halves and 0
for quarters. The top of a tree is fitted on a bounded sample: each node has a vantage
point and the median distance to it, and its leaves are shards. A fingerprint lives in one
shard of each tree and also visits every shard that the triangle bound can't exclude (those
across a border that it is near to). Such visits grow with each level, so trees of halves
serve up to ``HALF_LEVELS`` levels and trees of quarters, which have none, beyond: a row is
copied about five times at the most, however many shards there are. Inside a shard trees of
halves go on until few fingerprints remain, which are compared in whole, all 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import checkpointed, hash_fraction, map_batches
from foliolens.llm.components import connected_components, local_labels

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Fingerprints that a shard is meant to hold, and the bound of the sample that trees are fitted on.
SHARD_ROWS = 65_536
FIT_ROWS = 40_000
#: Sampled fingerprints that a leaf is fitted on at least; levels up to which halves serve.
LEAF_SAMPLE, HALF_LEVELS = 16, 4
#: Rows from where a shard (of one quarter's value, say) is cut into chunks of half that size.
CHUNKED_ROWS = 1 << 20
#: Below so many comparisons a node is searched whole.
BLOCK = 1 << 18

_SHIFTS = np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text: a bit is 1 if over half of the shingles' hashes have it.

    A-Z are lower-cased; words are what ASCII white space divides; fewer words than a
    shingle count as one; without words (or for null) it is zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    parts = [words[i:] for i in range(SHINGLE_WORDS)]
    hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*parts, strict=False)], dtype=np.uint64)
    # Sixteen bits at a time keep the unpacked bits of very long texts small.
    bits = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        bits += np.unpackbits(hashes[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _SHIFTS)[bits * 2 > len(hashes)].sum(dtype=np.uint64))


def with_fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), text), run, f"doc_id {kind}, fp bigint")


def _part(fps: np.ndarray, tree: int, parts: int) -> np.ndarray:
    """The bits of a tree's part, the upper ones first."""
    width = 64 // parts
    return fps.view(np.uint64) >> np.uint64(64 - width * (tree + 1)) & np.uint64((1 << width) - 1)


@dataclass
class VantageTree:
    """The top of a tree in heap order: node k has children 2k + 1 (near) and 2k + 2 (far)."""

    tree: int
    points: np.ndarray
    radii: np.ndarray
    levels: int
    parts: int = 2

    @staticmethod
    def fit(sample: np.ndarray, tree: int, levels: int, parts: int = 2) -> VantageTree:
        values = _part(sample, tree, parts)
        n = (1 << levels) - 1
        points, radii = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        rng = np.random.default_rng(tree)
        held = {0: values}
        for k in range(n):
            own = held.pop(k)
            points[k] = own[rng.integers(len(own))] if len(own) else rng.integers(1 << 64 // parts)
            d = np.bitwise_count(own ^ points[k]).astype(np.int64)
            # The distance that divides the rows most evenly.
            upto = np.bincount(d, minlength=64).cumsum()
            radii[k] = int(np.abs(2 * upto - len(own)).argmin()) if len(d) else 32 // parts
            if 2 * k + 1 < n:
                held[2 * k + 1], held[2 * k + 2] = own[d <= radii[k]], own[d > radii[k]]
        return VantageTree(tree, points, radii, levels, parts)

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): the shards that each row visits; home where it lives there."""
        values, radius = _part(fps, self.tree, self.parts), RADIUS // self.parts
        row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.levels):
            d = np.bitwise_count(values[row] ^ self.points[node]).astype(np.int64)
            r = self.radii[node]
            near, far = d <= r + radius, d > r - radius  # what lives across lies that near to the border
            row, node, home = (
                np.concatenate((row[near], row[far])),
                np.concatenate((2 * node[near] + 1, 2 * node[far] + 2)),
                np.concatenate(((home & (d <= r))[near], (home & (d > r))[far])),
            )
        return row, node - ((1 << self.levels) - 1), home


def _search(fps: np.ndarray, halves: np.ndarray, members: np.ndarray, queries: np.ndarray, labels: np.ndarray, rng) -> np.ndarray:
    """Join the labels of all pairs of a member and a query within the radius."""
    stack = [(members, queries, 0)]
    while stack:
        m, q, depth = stack.pop()
        if not len(m) or not len(q):
            continue
        if len(m) * len(q) > BLOCK and depth < 40:
            point = halves[m[rng.integers(len(m))]]
            dm, dq = np.bitwise_count(halves[m] ^ point), np.bitwise_count(halves[q] ^ point)
            r = int(np.median(dm))
            inside = dm <= r
            if inside.all():  # many lie at one distance: cut below it, where that divides
                r -= 1
                inside = dm <= r
            if inside.any():
                stack.append((m[inside], q[dq <= r + 1], depth + 1))
                stack.append((m[~inside], q[dq >= r], depth + 1))
                continue
        step = max(1, BLOCK // len(m))
        for k in range(0, len(q), step):
            some = q[k : k + step]
            i, j = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fps[m][None, :]) <= RADIUS)
            labels = local_labels(len(fps), some[i], m[j], labels)
    return labels


def shard_links(fps: np.ndarray, reps: np.ndarray, home: np.ndarray, tree: int, parts: int = 2, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups found in one shard: each row to the smallest row of its group.

    ``sides`` tells the two chunks of a shard's rows apart; only pairs across them are looked for.
    """
    order = np.argsort(reps, kind="stable")
    fps, reps, home = fps[order].view(np.uint64), reps[order], home[order]
    everyone = np.arange(len(fps))
    pairs = [(everyone[home], everyone)]
    if sides is not None:
        low = sides[order]
        pairs = [(everyone[home & low], everyone[~low]), (everyone[home & ~low], everyone[low])]
    labels = everyone.copy()
    # In a shard of one half's tree that half is the near one of its pairs; in one of a quarter's either may be.
    for half in (tree,) if parts == 2 else (0, 1):
        for members, queries in pairs:
            labels = _search(fps, _part(fps, half, 2), members, queries, labels, np.random.default_rng(tree))
    linked = labels != everyone
    return reps[labels[linked]], reps[linked]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of each row: groups linked by fingerprints at 3 or fewer bits.

    Equal fingerprints are one class, so copies cost a pre-aggregated minimum and no pairs.
    component_id is the smallest id reachable; ids must be integers. A row with a null id
    keeps its fingerprint, takes part in no link, and belongs to the group of its equals,
    if any. An empty table gives an empty result.
    """
    fps = checkpointed(with_fingerprint(docs, doc_id, text))
    classes = checkpointed(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("rep")))
    n = classes.count()
    drawn = classes.where(hash_fraction(F.col("fp")) < F.lit(min(1.0, fit_rows / max(n, 1)))).select("fp").orderBy("fp").collect()
    sample = np.array([r["fp"] for r in drawn], dtype=np.int64)
    levels = max(0, int(np.ceil(np.log2(max(n, 1) / shard_rows))))
    levels = min(levels, int(np.log2(max(len(sample) / LEAF_SAMPLE, 1))))
    parts = 2 if levels <= HALF_LEVELS else 4
    trees = [VantageTree.fit(sample, t, levels, parts) for t in range(parts)]

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rep = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        found = []
        for tree in trees:
            row, shard, home = tree.route(own)
            found.append(pa.RecordBatch.from_arrays(
                [pa.array(((tree.tree << levels) + shard).astype(np.int32)), pa.array(own[row]), rep.take(pa.array(row)), pa.array(home)],
                names=["shard", "fp", "rep", "home"]))
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0]

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        sides = None if low == high else table["chunk"].to_numpy() == low
        a, b = shard_links(table["fp"].to_numpy(), table["rep"].to_numpy(), table["home"].to_numpy(zero_copy_only=False), table["shard"][0].as_py() >> levels, parts, sides)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    routed = map_batches(classes, route, "shard int, fp bigint, rep bigint, home boolean")
    large = routed.groupBy("shard").count().where(F.col("count") > CHUNKED_ROWS).collect()  # a row for each million rows at most
    chunks = F.lit(1)
    if large:
        sizes = F.create_map(*[F.lit(x) for r in large for x in (r["shard"], -(-r["count"] // (CHUNKED_ROWS // 2)))])
        chunks = F.coalesce(F.element_at(sizes, F.col("shard")), F.lit(1))
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(F.col("chunk"), j).alias("low"), F.greatest(F.col("chunk"), j).alias("high")))
    links = (
        routed.withColumn("chunks", chunks.cast("int")).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        .withColumn("cell", F.explode(cells)).select("shard", "cell.low", "cell.high", "chunk", "fp", "rep", "home")
        .groupBy("shard", "low", "high").applyInArrow(search, "a bigint, b bigint")
    )
    found = connected_components(links)
    groups = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(groups, "fp", "left").select("doc_id", "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The rows of one document of each group, the smallest id.

    ``groups`` gives each row's doc_id and component_id. An id stands for one document: of
    rows that repeat a kept id the one of the smallest text stays (then of the smallest row
    as JSON). Rows with a null id stay: they can't be told apart. Their scan reads only
    files whose statistics tell of nulls.
    """
    kept = checkpointed(
        groups(docs, doc_id, text).where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")))
    ids = lambda some: some.select(F.col("doc_id").alias(doc_id))
    once = ids(kept.where("rows = 1")).hint("merge")  # the kept ids grow with the documents: never broadcast
    parts = docs.join(once, doc_id, "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))
    repeated = kept.where("rows > 1")
    if not repeated.isEmpty():
        row = F.struct(*docs.columns)
        again = docs.join(ids(repeated), doc_id, "left_semi").groupBy(F.col(doc_id).alias("id")).agg(F.min_by(row, F.struct(F.col(text), F.to_json(row))).alias("row"))
        parts = parts.unionByName(again.select("row.*"))
    return parts.select(*docs.columns)
