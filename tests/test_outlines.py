"""Operators over elements, trees, orders and reports, case by case; SQL stated apart; plans without nested loops."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from foliolens.functions import similarity as X
from foliolens.operators import outlines as O
from foliolens.operators.places import with_places
from foliolens.plans.oracles import SQL_APART
from foliolens.plans.registry import QUERIES
from test_queries import TABLES, plain


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_contents_runs(spark):
    texts = [("heading", "Contents"), ("paragraph", "One .... 3"), ("artifact", "x"), ("heading", "Two 4"), ("paragraph", "No entry"), ("paragraph", "Three .... 5"),
             ("heading", "Table of  contents"), ("paragraph", "none"), ("heading", "CONTENTS"), ("list_item", "Four 9"), ("figure", "")]
    rows = [(d, i, k, t) for d in (1, 2) for i, (k, t) in enumerate(texts)]
    got = sorted(map(tuple, O.contents_runs(frame(spark, rows, "doc int, pos int, type string, text string")).where("doc = 2").collect()))
    assert got == [(2, 0, "toc_caption", 0), (2, 1, "toc_item", 0), (2, 3, "toc_item", 0), (2, 8, "toc_caption", 1), (2, 9, "toc_item", 1)]


def test_figure_context_stays_on_its_page(spark):
    rows = [(1, 0, 0, "heading", "Far"), (1, 1, 1, "heading", "Near"), (1, 1, 2, "paragraph", " a  b "), (1, 1, 3, "paragraph", ""), (1, 1, 4, "artifact", "z"), (1, 1, 5, "note", "c"),
            (1, 1, 6, "figure", "own"), (1, 1, 7, "figure", "own"), (1, 1, 8, "paragraph", "d"), (1, 2, 9, "paragraph", "e"), (1, 3, 10, "figure", "")]
    got = {r["pos"]: tuple(r)[2:] for r in O.figure_context(frame(spark, rows, "doc int, page int, pos int, type string, text string")).collect()}
    assert got == {6: ("Near", "a b | c", "d"), 7: ("Near", "a b | c", "d"), 10: ("", "", "")}


def test_title_bookmarks(spark):
    schema = "doc int, title string, has_toc boolean, entries array<struct<text:string,page:int,level:int>>"
    pieces = [("Annual", 0, 1), ("Report 2024", 0, 2), ("Start", 0, 2), ("Annual", 1, 2)]
    rows = [(1, "Annual Report 2024", False, pieces), (2, "Annual Report 2024", True, pieces), (3, "Annual", False, pieces), (4, None, False, pieces), (5, "Annual Report 2024", False, pieces[:1]), (6, "x", False, [])]
    got = {r["doc"]: [tuple(e) for e in r["entries"]] for r in O.title_bookmarks(frame(spark, rows, schema)).collect()}
    assert got[1] == [("Annual Report 2024", 0, 1), ("Start", 0, 2), ("Annual", 1, 2)]
    assert got[2] == got[3] == got[4] == pieces and got[5] == pieces[:1] and got[6] == []


def test_orders_that_fit_and_that_do_not(spark):
    rows = [(p, i * 10, i) for p in (1, 2, 3, 4) for i in (1, 2, 3)]
    orders = [(1, [3, 1, 2]), (2, [3, 1]), (3, [3, 1, 1])]
    got = sorted(map(tuple, O.reordered(frame(spark, rows, "page int, pos int, id int"), frame(spark, orders, "page int, ids array<int>")).collect()))
    assert got == [(1, 10, 3), (1, 20, 1), (1, 30, 2)] + [(p, i * 10, i) for p in (2, 3, 4) for i in (1, 2, 3)]


def test_tagging_regressions(spark):
    def lost(before, now):
        kinds = ("headings", "figures", "tables", "lists", "links")
        return spark.range(1).select(O.tagging_regressions({k: F.lit(n) for k, n in zip(kinds, now, strict=True)}, {k: F.lit(n) for k, n in zip(kinds, before, strict=True)}).alias("x")).first()["x"]

    assert lost((3, 4, 10, 10, 2), (0, 1, 7, 8, 1)) == ["headings dropped to zero (3 -> 0)", "tables dropped significantly (10 -> 7)", "links decreased (2 -> 1)"]
    assert lost((0, -4, 6, 5, 0), (0, 0, 4, 4, 0)) == [] and lost((0, 0, 0, 0, 2), (1, 1, 1, 1, 2)) == []


def test_statuses_at_any_depth():
    text = '{"Status": " Passed ", "x": [{"result": "FAIL", "y": {"state": "Ok"}}, "status", {"status": 3}], "result": {"status": "in"}}'
    assert sorted(O.statuses(text)) == ["fail", "in", "ok", "passed"]
    assert O.statuses(None) == O.statuses("") == O.statuses("{") == O.statuses("[]") == []


def test_walks_of_deep_trees(spark):
    rows = [(1, 0, None, 0, "r"), (1, 1, 0, 2, "b"), (1, 2, 0, 1, "a"), (1, 3, 2, 0, ""), (1, 4, 3, 0, "deep"), (1, 5, 3, 1, ""), (1, 6, 5, 0, None), (1, 8, 99, 0, "lost"), (1, 10, 11, 0, "round"), (1, 11, 10, 0, "round"),
            *((2, i, i - 1 if i else None, 0, "x") for i in range(300))]
    got = O.walked(frame(spark, rows, "doc bigint, node bigint, parent bigint, pos bigint, label string"))
    one = {r["node"]: tuple(r)[3:] for r in got.where("doc = 1").collect()}
    assert one == {
        0: (0, 0, "/r", True, True), 2: (1, 1, "/r/a", True, True), 3: (2, 2, "/r/a/", True, False), 4: (3, 3, "/r/a//deep", True, False),
        5: (3, 4, "/r/a//", False, False), 6: (4, 5, "/r/a///", False, False), 1: (1, 6, "/r/b", True, True)}
    assert got.where("doc = 2").agg(F.max("depth")).first()[0] == 299
    heads = frame(spark, [(1, "A!", 5, 2), (1, "a", 1, 1), (1, "deep", 0, 3), (1, "B", 9, 4)], "doc bigint, title string, page int, pos int")
    nodes = frame(spark, rows, "doc bigint, node bigint, parent bigint, pos bigint, label string")
    assert [tuple(r) for r in O.native_bookmarks(nodes, heads, F.lit(8)).collect()] == [(1, 2, 1, 2)]


def test_places_over_many_stretches(spark):
    keys = [-200_000, -1, 0, 5, 65_535, 65_536, 1_000_000]
    got = with_places(frame(spark, [(k, 3) for k in keys], "k bigint, n int"), "k", "n").collect()
    assert {r["k"]: r["place"] for r in got} == {k: 3 * i for i, k in enumerate(keys)}
    assert sorted(r["place"] for r in with_places(frame(spark, [(k, 3) for k in keys], "k bigint, n int"), "k").collect()) == list(range(7))


def test_only_the_measures_asked_for(spark):
    df = frame(spark, [("ab", "ac")], "a string, b string")
    assert X.with_similarity(df, "a", "b", "indel").columns == ["a", "b", "indel"] and len(X.with_similarity(df, "a", "b").columns) == 4


@pytest.mark.parametrize("name", sorted(SQL_APART))
def test_sql_stated_apart(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, wanted = QUERIES[name](spark, sf_dir), con.sql(SQL_APART[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns) and name in __spark_entry__.oracle_sql()
    rows = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({SQL_APART[name]})").fetchall()
    assert sorted(map(plain, map(tuple, got.select(*columns).collect()))) == sorted(map(plain, rows))


def test_short_passages_are_found_where_they_stand(spark, tmp_path):
    frame(spark, [(1, "one two three four five six seven eight nine ten"), (2, "éa"), (3, "x, yz and"), (4, ""), (5, "a"), (6, "absent words"), (7, "\nline")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, [(1, "zone two three four five six seven eight nine tenx"), (2, "créa lex, yz and\nline"), (3, None), (4, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["item_id"]: r["present"] for r in QUERIES["j4_gold_passages"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False, 7: True}


def test_no_plan_compares_all_pairs(spark, sf_dir):
    plans = {name: q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString() for name, q in QUERIES.items()}
    assert not [name for name, plan in plans.items() if "NestedLoop" in plan or "CartesianProduct" in plan]
