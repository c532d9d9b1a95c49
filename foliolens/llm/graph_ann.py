"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Rows are dealt to shards by a hash of the id, so shards are even whatever the vectors.
In a shard equal vectors are one node. The graph starts from random edges; greedy beam
searches for each node propose neighbours, and relaxed distance pruning keeps those that
no kept neighbour is closer to by a factor, so edges point in diverse directions. A
query is searched by beam in every shard, and the shards' best are merged.

A shard is one partition, placed by its number, so tasks are even. Its graph stays where
it is read, and queries stream past it; only beyond ``QUERY_BLOCK`` queries is it read by
a second task. Searches run on vectors moved to the shard's middle and divided by their
size; scores are computed on the vectors as given.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.common import checkpointed
from foliolens.llm.vectors import matrix, usable

#: Nodes that a shard is meant to hold; edges of a node; beam of the build and of queries; pruning factor.
SHARD_ROWS, DEGREE, BUILD_BEAM, QUERY_BEAM, ALPHA = 16_384, 32, 64, 160, 1.2
#: Nodes expanded in one step of a beam, and searches that run side by side.
WIDTH, SIDE_BY_SIDE = 4, 512
#: Queries that one task answers in one shard; they stream, so the bound is on its time.
QUERY_BLOCK = 262_144


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the ``beam`` nearest nodes that greedy searches reach, nearest first; -1 pads."""
    n, rows, beam = len(x), len(q), min(beam, len(x))
    qn = (q * q).sum(axis=1)
    #: Whether a search has met a node, and scratch room to keep one of a node's several mentions.
    met, mention = np.zeros(rows * n, bool), np.empty(rows * n, np.int32)

    def distances(of: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.maximum(norms[nodes] - 2 * np.einsum("kd,kd->k", x[nodes], q[of]) + qn[of], 0)

    start = np.broadcast_to(entries, (rows, len(entries)))
    met[(np.arange(rows)[:, None] * n + start).ravel()] = True
    ids = np.full((rows, max(beam, len(entries))), -1, np.int32)
    dist = np.full(ids.shape, np.inf, x.dtype)
    ids[:, : len(entries)] = start
    dist[:, : len(entries)] = distances(np.repeat(np.arange(rows), len(entries)), start.ravel()).reshape(start.shape)
    order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    seen = np.zeros((rows, beam), bool)
    active = np.arange(rows)
    while len(active):
        a_ids, a_dist, a_seen = ids[active], dist[active], seen[active]
        rank = np.where(a_seen | (a_ids < 0), np.inf, a_dist)
        pick = np.argpartition(rank, WIDTH - 1, axis=1)[:, :WIDTH] if beam > WIDTH else np.broadcast_to(np.arange(beam), rank.shape)
        open_ = np.isfinite(np.take_along_axis(rank, pick, 1))
        going = open_.any(axis=1)
        if not going.all():
            active, a_ids, a_dist, a_seen, pick, open_ = active[going], a_ids[going], a_dist[going], a_seen[going], pick[going], open_[going]
            if not len(active):
                break
        np.put_along_axis(a_seen, pick, np.take_along_axis(a_seen, pick, 1) | open_, 1)
        near = np.where(open_[:, :, None], graph[np.where(open_, np.take_along_axis(a_ids, pick, 1), 0)], -1).reshape(len(active), -1)
        at = np.flatnonzero(near.ravel() >= 0)
        key = active[at // near.shape[1]] * n + near.ravel()[at]
        fresh = ~met[key]
        at, key = at[fresh], key[fresh]
        mention[key] = np.arange(len(key))
        once = mention[key] == np.arange(len(key))
        at, key = at[once], key[once]
        met[key] = True
        d = np.full(near.size, np.inf, x.dtype)
        d[at] = distances(key // n, key % n)
        all_ids = np.concatenate((a_ids, np.where(np.isfinite(d), near.ravel(), -1).reshape(near.shape)), axis=1)
        all_dist = np.concatenate((a_dist, d.reshape(near.shape)), axis=1)
        all_seen = np.concatenate((a_seen, np.zeros(near.shape, bool)), axis=1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        ids[active], dist[active], seen[active] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_dist, all_seen))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node among its candidates (-1 pads), nearest first."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == nodes[:, None]] = -1
    points = x[np.maximum(cand, 0)]
    diff = points - x[nodes][:, None, :]
    dist = np.where(cand < 0, np.inf, np.einsum("bkd,bkd->bk", diff, diff))
    sq = np.einsum("bkd,bkd->bk", points, points)
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = dist.argmin(axis=1)
        ok = np.isfinite(dist[rows, best])
        if not ok.any():
            break
        out[ok, k] = cand[rows, best][ok]
        kept = points[rows, best]
        apart = sq - 2 * np.einsum("bkd,bd->bk", points, kept) + sq[rows, best][:, None]
        dist[(alpha * alpha * apart <= dist) & ok[:, None]] = np.inf
        dist[rows, best] = np.inf
    return out


def _add_back(x: np.ndarray, graph: np.ndarray, to: np.ndarray, back: np.ndarray, degree: int, factor: float) -> None:
    """Let each node of ``to`` point to its node of ``back``: in free places where there are enough, else all are pruned."""
    fresh = ~(graph[to] == back[:, None]).any(axis=1)
    by = np.argsort(to[fresh], kind="stable")
    to, back = to[fresh][by], back[fresh][by]
    own, first, size = np.unique(to, return_index=True, return_counts=True)
    rows = graph[own]
    rows = graph[own] = np.take_along_axis(rows, np.argsort(rows < 0, axis=1, kind="stable"), 1)
    held = (rows >= 0).sum(axis=1)
    owner, place = np.repeat(np.arange(len(own)), size), np.arange(len(to)) - np.repeat(first, size)
    roomy = (held + size <= graph.shape[1])[owner]
    graph[to[roomy], (held[owner] + place)[roomy]] = back[roomy]
    owner, place, back, step = owner[~roomy], place[~roomy], back[~roomy], 2 * degree
    while len(owner):  # a slice of each node's new edges at a time, until all have taken part
        now = place < step
        some, local = np.unique(owner[now], return_inverse=True)
        new = np.full((len(some), step), -1, np.int32)
        new[local, place[now]] = back[now]
        for j in range(0, len(some), SIDE_BY_SIDE):
            nodes = own[some[j : j + SIDE_BY_SIDE]]
            graph[nodes, :degree] = robust_prune(x, nodes, np.concatenate((graph[nodes], new[j : j + SIDE_BY_SIDE]), axis=1), degree, factor)
            graph[nodes, degree:] = -1
        owner, place, back = owner[~now], place[~now] - step, back[~now]


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries): neighbours of each node (-1 pads), and the nodes that searches enter by.

    While it is built a node may hold half as many edges more, so that few are pruned again and again.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    norms = (x * x).sum(axis=1)
    graph = np.full((n, degree + degree // 2), -1, np.int32)
    graph[:, :degree] = rng.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = -1
    middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    entries = np.unique(np.concatenate(([middle], rng.choice(n, min(n, 8), replace=False)))).astype(np.int32)
    for factor in (1.0, alpha):
        order = rng.permutation(n)
        for k in range(0, n, SIDE_BY_SIDE):
            nodes = order[k : k + SIDE_BY_SIDE]
            found, _ = beam_search(x, norms, graph, entries, x[nodes], beam)
            graph[nodes, :degree] = robust_prune(x, nodes, np.concatenate((found, graph[nodes]), axis=1), degree, factor)
            graph[nodes, degree:] = -1
            to, back = graph[nodes, :degree].ravel(), np.repeat(nodes, degree).astype(np.int32)
            _add_back(x, graph, to[to >= 0], back[to >= 0], degree, factor)
    full = np.flatnonzero((graph >= 0).sum(axis=1) > degree)
    for k in range(0, len(full), SIDE_BY_SIDE):
        nodes = full[k : k + SIDE_BY_SIDE]
        graph[nodes, :degree] = robust_prune(x, nodes, graph[nodes], degree, alpha)
        graph[nodes, degree:] = -1
    graph = np.take_along_axis(graph, np.argsort(graph < 0, axis=1, kind="stable"), 1)
    return np.ascontiguousarray(graph[:, :degree]), entries


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x).max(initial=0)) or 1.0


def exact_distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to ``q`` in double precision; scaled first where plain squares overflow or vanish.

    Squares are added one after another, as a plain loop would.
    """
    x, q = x.astype(np.float64), q.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        plain = np.sqrt(np.cumsum((x - q) ** 2, axis=1)[:, -1])
        odd = ~np.isfinite(plain) | (plain < 1e-140)
        if odd.any():
            half = x[odd] / 2 - q / 2  # the difference itself could overflow
            top = np.abs(half).max(axis=1, initial=0)
            plain[odd] = top * np.sqrt(((half / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1)) * 2
    return plain


class Shard:
    """One shard's index: distinct vectors as nodes, their graph, and the k + 1 smallest ids of each node."""

    PARTS = (("x", None), ("graph", np.int32), ("entries", np.int32), ("ids", np.int64), ("node", np.int64))

    def __init__(self, x: np.ndarray, graph: np.ndarray, entries: np.ndarray, ids: np.ndarray, node: np.ndarray) -> None:
        self.x, self.graph, self.entries, self.ids, self.node = x, graph, entries, ids, node
        self.first = np.searchsorted(node, np.arange(len(x) + 1))
        self.n_ids, self.size = len(np.unique(ids)), 0.0

    def fit_to(self, size: float) -> None:
        """Hold the vectors, moved to their middle, as parts of ``size``: then no square can overflow.

        Single precision does unless some vector would be lost beside the largest.
        """
        if size <= self.size:
            return
        self.size = size
        low = self.x.astype(np.float64) / size
        self.middle = low.mean(axis=0) if len(low) else low.sum(axis=0)
        low -= self.middle
        spread = np.abs(low).max(axis=1, initial=0)
        small = spread[spread > 0].min(initial=1.0)
        self.low = low.astype(np.float32 if small > 1e-12 else np.float64)
        self.norms = (self.low * self.low).sum(axis=1)

    @staticmethod
    def build(ids: np.ndarray, x: np.ndarray, k: int, seed: int) -> Shard:
        _, first, node = np.unique(x, axis=0, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack((node.ravel(), ids), axis=1), axis=0)  # an id counts once for a vector
        node, ids = pairs[:, 0], pairs[:, 1]
        sizes = np.bincount(node, minlength=len(first))
        keep = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) <= k
        own = Shard(np.ascontiguousarray(x[first]), None, None, ids[keep], node[keep])
        own.fit_to(_largest(own.x))
        own.graph, own.entries = build_graph(own.low, seed=seed)
        return own

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, beam: int) -> list[tuple[np.ndarray, ...]]:
        """(query ids, ids, scores) of the k nearest found for each query."""
        out = []
        for at in range(0, len(q), SIDE_BY_SIDE):
            some = q[at : at + SIDE_BY_SIDE]
            self.fit_to(max(_largest(self.x), _largest(some)))
            found, _ = beam_search(self.low, self.norms, self.graph, self.entries, (some.astype(np.float64) / self.size - self.middle).astype(self.low.dtype), beam)
            for own, one, got in zip(q_ids[at : at + SIDE_BY_SIDE], some, found, strict=True):
                got = got[got >= 0]
                ids, score = self._best(own, one, got, k)
                if len(ids) < min(k, self.n_ids) and len(got) < len(self.x):  # the search reached too few: look at all
                    ids, score = self._best(own, one, np.arange(len(self.x)), k)
                out.append((np.full(len(ids), own), ids, score))
        return out

    def _best(self, own: int, one: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        count = self.first[nodes + 1] - self.first[nodes]
        rows = np.repeat(self.first[nodes] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        score, ids = np.repeat(exact_distances(self.x[nodes], one), count), self.ids[rows]
        score, ids = score[ids != own], ids[ids != own]
        order = np.lexsort((ids, score))
        ids, score = ids[order], score[order]
        _, first = np.unique(ids, return_index=True)  # an id of several vectors counts at its nearest
        best = np.sort(first)[:k]
        return ids[best], score[best]


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
            shard_rows: int = SHARD_ROWS, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query id, its own id left out.

    score is the Euclidean distance in double precision on the original vectors; ties go
    to the smaller id; fewer than ``k`` candidates give fewer rows. Vectors that are null,
    empty, zero or not finite take no part, nor do null ids; vectors of another length
    are no candidates. An id is answered once and found once: of rows that repeat a query's
    id the smallest vector (by its components in order) asks, and a candidate of several
    vectors counts at its nearest. Copies beyond the k + 1 smallest ids of a vector can't
    be among the k nearest, so no result is lost by leaving them. An empty table gives an
    empty result; other columns, whatever their names, are not read.
    """
    base = usable(df, vec_id, embedding)
    asked = checkpointed(usable(queries, vec_id, embedding).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    shards = max(1, ceil(base.count() / shard_rows))
    blocks = max(1, ceil(asked.count() / QUERY_BLOCK))
    wide = df.schema[embedding].dataType.elementType.typeName() == "double"
    kind, number = np.dtype("<f8" if wide else "<f4"), "double" if wide else "float"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        dims, shard = rows["dim"].to_numpy(), rows["shard"][0].as_py()
        for dim in np.unique(dims):
            of = rows.take(pa.array(np.flatnonzero(dims == dim)))
            own = Shard.build(of["vec_id"].to_numpy(), matrix(of["embedding"]).astype(kind), k, shard)
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()),
                **{part: pa.array([np.ascontiguousarray(getattr(own, part)).tobytes()], pa.binary()) for part, _ in Shard.PARTS}})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[int, Shard] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            asks, dims = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("dim").to_numpy()
            for i in np.flatnonzero(~asks).tolist():
                x, graph, entries, ids, node = (np.frombuffer(batch.column(part)[i].as_py(), dtype=d or kind) for part, d in Shard.PARTS)
                index[int(dims[i])] = Shard(x.reshape(-1, dims[i]), graph.reshape(-1, DEGREE), entries, ids, node)
            out: list[tuple[np.ndarray, ...]] = []
            for dim in np.unique(dims[asks]).tolist():
                own = pa.array(np.flatnonzero(asks & (dims == dim)))
                if dim in index:
                    out += index[dim].search(batch.column("vec_id").take(own).to_numpy(), matrix(batch.column("embedding").take(own)), k, beam)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["query_id", "vec_id", "score"])

    dealt = base.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "embedding")
    parts = ", ".join(f"{part} binary" for part, _ in Shard.PARTS)
    index = checkpointed(dealt.repartitionById(shards, "shard").mapInArrow(build, f"dim int, shard int, {parts}"))
    # A cell is a shard and a block of queries: its graph comes first, then the queries stream past.
    names = [part for part, _ in Shard.PARTS]
    graphs = index.select(
        F.explode(F.sequence(F.col("shard") * blocks, F.col("shard") * blocks + blocks - 1)).alias("cell"), "dim", F.lit(False).alias("asks"),
        F.lit(None).cast("bigint").alias("vec_id"), F.lit(None).cast(f"array<{number}>").alias("embedding"), *names)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asking = asked.select(
        F.explode(F.sequence(block, block + (shards - 1) * blocks, F.lit(blocks))).alias("cell"), F.size("embedding").alias("dim"), F.lit(True).alias("asks"),
        "vec_id", F.col("embedding").cast(f"array<{number}>").alias("embedding"), *[F.lit(None).cast("binary").alias(n) for n in names])
    found = (
        graphs.unionByName(asking).repartitionById(shards * blocks, "cell").sortWithinPartitions("asks")
        .mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
