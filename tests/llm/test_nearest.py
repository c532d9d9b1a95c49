"""Nearest neighbours: repeated ids, sizes beyond single precision, searches that reach too little, and SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from foliolens.llm import graph_ann, queries, vector_dedup

SF01 = "/root/testdata/sf0.01"


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], f"vec_id bigint, embedding array<{kind}>")


def answers(got) -> dict[int, list[tuple[int, int, float]]]:
    out: dict[int, list] = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_a_repeated_id_is_answered_once_and_found_once(spark):
    rows = [(0, (0, 1)), (0, (0, 1)), *((i, (i, 1)) for i in range(1, 15)), (3, (0, 1.5)), (3, (3, 1)), (20, (1, 1))]
    got = answers(graph_ann.nearest(frame(spark, rows), frame(spark, [*rows[:2], (0, (0, 2))]), k=10))
    assert [x[:2] for x in got[0]] == list(zip(range(1, 11), [3, 1, 20, 2, 4, 5, 6, 7, 8, 9], strict=True))
    assert got[0][0][2] == 0.5


@pytest.mark.parametrize("size", [1e25, 1e200, 1e307, 1e-200])
@pytest.mark.parametrize("shard_rows", [4, 100])
def test_very_large_and_very_small_vectors(spark, size, shard_rows):
    rows = [(i, ((i + 1) * size, size, 0)) for i in range(12)]
    got = answers(graph_ann.nearest(frame(spark, rows), frame(spark, rows[:1]), k=20, shard_rows=shard_rows))
    assert [x[1] for x in got[0]] == list(range(1, 12))
    assert np.allclose([x[2] / size for x in got[0]], range(1, 12))


def test_large_floats_and_vectors_of_mixed_size(spark):
    rows = [(i, ((i + 1) * 1e25, 0, 1)) for i in range(12)] + [(100 + i, (i + 1, 1, 0)) for i in range(30)]
    got = answers(graph_ann.nearest(frame(spark, rows, "float"), frame(spark, [rows[0], rows[12]], "float"), k=41))
    assert sorted(x[1] for x in got[0]) == sorted(i for i, _ in rows if i)
    assert [x[1] for x in got[100]][:29] == [100 + i for i in range(1, 30)]


def test_unreached_nodes_are_looked_at():
    x = np.arange(1.0, 41.0)[:, None]
    own = graph_ann.Shard.build(np.arange(40), x, 10, 0)
    own.graph[:] = -1
    own.entries = own.entries[:1]
    (_, ids, score), = own.search(np.array([0]), x[:1], 10, 160)
    assert ids.tolist() == list(range(1, 11)) and score.tolist() == list(range(1, 11))


def test_all_edges_back_take_part():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 4)).astype(np.float32)
    graph = np.full((400, 12), -1, np.int32)
    order = rng.permutation(np.arange(1, 400))
    graph_ann._add_back(x, graph, np.zeros(399, np.int32), order.astype(np.int32), 8, 1.0)
    nearest = 1 + ((x[1:] - x[0]) ** 2).sum(axis=1).argmin()
    assert nearest in graph[0]


@pytest.mark.parametrize("name", ["op2_nearest", "op6_vector_dedup"])
def test_queries_equal_brute_force_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF01}/embeddings.parquet'")
    got = queries.QUERIES[name](spark, SF01)
    wanted = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    assert sorted(map(tuple, got.select(*wanted.columns).collect())) == sorted(wanted.fetchall())


def test_links_of_very_large_and_very_small_vectors(spark):
    rows = [(i, (v * size, size, size / 3)) for i, (v, size) in enumerate([(1, 1e200), (1.01, 1e300), (1, 1e-300), (1.02, 1e-200), (1, 1), (-1, 1), (1.01, 1e25)])]
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert [got[i]["n_links"] for i in range(7)] == [5, 5, 5, 5, 5, 0, 5]
    assert [got[i]["component_id"] for i in range(7)] == [0, 0, 0, 0, 0, 5, 0]


def test_sketches_pass_every_pair_near_enough():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20_000, 64))
    y = x + 0.46 * rng.standard_normal(x.shape)
    cosine = (x * y).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    apart = np.bitwise_count(vector_dedup.sketches(x) ^ vector_dedup.sketches(y)).sum(axis=1)
    lost = apart[cosine >= 0.9] > vector_dedup.widest(0.9)
    assert len(lost) > 5000 and lost.mean() < 1e-3
    z = rng.standard_normal((20_000, 64))
    assert (np.bitwise_count(vector_dedup.sketches(x) ^ vector_dedup.sketches(z)).sum(axis=1) <= vector_dedup.widest(0.9)).mean() < 1e-3
