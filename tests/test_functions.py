"""Properties of folds, spatial joins and streams."""

from __future__ import annotations

import bisect
import shutil

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliolens.functions import geometry as G
from foliolens.functions import text as T
from foliolens.functions.similarity import fragments_joined, indel_ratio, partial_ratio, preservation, repaired, script_of, sequence_ratio, with_similarity
from foliolens.operators.assignment import best_assignment
from foliolens.operators.clusters import greedy_rows
from foliolens.operators.spatial import best_box_match, overlapping
from foliolens.plans.windows import longest_nondecreasing
from foliolens.sources import frames as S
from foliolens.streaming import events as E


def test_longest_nondecreasing_equals_patience(spark):
    rng = np.random.default_rng(0)
    lists = [rng.integers(0, 12, rng.integers(0, 20)).tolist() for _ in range(300)]

    def patience(a):
        tails = []
        for x in a:
            i = bisect.bisect_right(tails, x)
            tails[i : i + 1] = [x]
        return len(tails)

    df = spark.createDataFrame([(i, a) for i, a in enumerate(lists)], "i int, a array<bigint>")
    got = {r["i"]: r["n"] for r in df.select("i", longest_nondecreasing(F.col("a")).alias("n")).collect()}
    assert got == {i: patience(a) for i, a in enumerate(lists)}


def test_overlapping_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    low = rng.uniform(-300, 300, (120, 2))
    size = rng.uniform(1, 260, (120, 2))
    rows = [(i, i % 3, *map(float, (a[0], a[1], a[0] + s[0], a[1] + s[1]))) for i, (a, s) in enumerate(zip(low, size, strict=True))]
    df = spark.createDataFrame(rows, "box int, page int, l double, b double, r double, t double")
    got = sorted((r["box"], r["o_box"]) for r in overlapping(df).collect())
    wanted = sorted((p[0], q[0]) for p in rows for q in rows if p[0] != q[0] and p[1] == q[1] and min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3]))
    assert got == wanted and best_box_match(df).count() == len({p for p, _ in wanted})


def test_geometry_identities(spark, sf_dir):
    a = G.box()
    r = S.boxes(spark, sf_dir).select(F.min(G.iou(a, a)).alias("i"), F.min(G.containment(a, a)).alias("c"), F.min(G.distance_score(a, a)).alias("d")).first()
    assert (r["i"], r["c"], r["d"]) == (1.0, 1.0, 1.0)


def test_text_rules_on_known_cases(spark):
    rows = [("Introduction ..... 12", True), ("1.2 Methods  7", True), ("12", False), ("Plain title", False), ("Preface ... xii", True)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.where(T.is_toc_entry(F.col("t")) != F.col("want")).count() == 0
    keys = {r["t"]: r["k"] for r in spark.createDataFrame([("Appendix A.1 Data",), ("2.3.1 X",), ("Other",)], "t string").select("t", T.section_key(F.col("t")).alias("k")).collect()}
    assert keys == {"Appendix A.1 Data": "appendix a.1", "2.3.1 X": "2.3.1", "Other": ""}


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=20), st.text("abc", max_size=20))
def test_indel_ratio_equals_dynamic_programme(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    wanted = 1.0 if not a and not b else 2 * table[-1][-1] / (len(a) + len(b))
    assert abs(indel_ratio(a, b) - wanted) < 1e-12


def test_similarity_columns(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", ""), ("", ""), (None, "x")], "a string, b string")
    got = with_similarity(df, "a", "b").toPandas()
    assert list(got["indel"]) == [1.0, 0.0, 1.0, 0.0] and sequence_ratio("abc", "abc") == 1.0


def test_assignment_is_optimal(spark):
    rng = np.random.default_rng(2)
    score = rng.uniform(size=(5, 6))
    df = spark.createDataFrame([(1, i, j, float(score[i, j])) for i in range(5) for j in range(6)], "page int, a int, b int, score double")
    from itertools import permutations

    best = max(sum(score[i, p[i]] for i in range(5)) for p in permutations(range(6), 5))
    got = best_assignment(df).toPandas()
    assert abs(got.score.sum() - best) < 1e-9 and got.a.is_unique and got.b.is_unique


def test_greedy_rows(spark):
    df = spark.createDataFrame([(1, 0, 10.0, 5.0, "b"), (1, 1, 12.0, 1.0, "a"), (1, 2, 30.0, 0.0, "c")], "page int, pos int, y double, x double, text string")
    assert [r["text"] for r in greedy_rows(df).orderBy("row").collect()] == ["a b", "c"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    events = S.table(spark, sf_dir, "events").where("event_id < 400")
    events.repartition(3).write.parquet(str(source))
    query = E.latest_steps(E.read_events(spark, str(source), 1)).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.table("latest").toPandas().sort_values(["user_id", "event_type"]).reset_index(drop=True)
    wanted = E.latest_steps(events).toPandas().sort_values(["user_id", "event_type"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, wanted)
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_sessions_batch(spark, sf_dir):
    s = E.sessions(S.table(spark, sf_dir, "events"))
    assert s.agg(F.sum("n")).first()[0] == S.table(spark, sf_dir, "events").count()


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12))
def test_preservation_bounds(a, b):
    assert 0.0 <= preservation(a, b) <= 1.0 and preservation(a, a) == 1.0
    assert preservation(a, a + b) == 1.0  # what is added damages nothing


def test_repairs():
    assert preservation("abcd", "abXd") == 0.75 and preservation("abcd", "") == 0.0
    assert partial_ratio("abc", "xxabcxx") == 1.0 and partial_ratio("", "a") == 0.0
    assert repaired("caf\u00c3\u00a9  x") == "café x" and repaired(None) == ""
    assert fragments_joined("w ord and a n ew one") == "word and anew one"
    assert [script_of(x) for x in "aα中1"] == ["LATIN", "GREEK", "OTHER", None]
