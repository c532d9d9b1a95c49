"""Summaries of answers and checks of proposed changes on cases made by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.operators.reviews import figure_context, merged_chunks, order_fits, order_summary, repair_gate, table_summary, updates_fit

_ITEM = "job int, pos int, table_id string, confidence string, action string, reason string"


def test_table_summary(spark):
    rows = [
        (1, 0, "a", "high", "set_table_headers", "one"), (1, 1, "a", "Medium", "reclassify_region", "two"), (1, 2, "b", "high", "confirm_current_headers", " one "),
        (2, 0, "a", "high", "confirm_current_headers", None), (3, 0, "a", None, "manual_only", ""), (4, 0, "", "low", "reclassify_region", "x"),
    ]
    got = {r["job"]: r for r in table_summary(spark.createDataFrame(rows, _ITEM), "job").collect()}
    assert (got[1]["action"], got[1]["confidence"], got[1]["proposed"], got[1]["reason"]) == ("set_table_headers", "medium", 1, "one two")
    assert got[1]["summary"] == "Reviewed 3 tables; proposed header updates for 1 and left 1 needing manual follow-up."
    assert (got[2]["action"], got[2]["summary"]) == ("confirm_current_headers", "Reviewed 1 tables; current header flags look acceptable.")
    assert (got[3]["action"], got[3]["confidence"]) == ("manual_only", "low") and got[3]["summary"].endswith("manual follow-up is still required.")
    assert got[4]["action"] == "reclassify_region" and "1 region was identified" in got[4]["summary"] and got[4]["reclassified"] == 0
    assert table_summary(spark.createDataFrame([], _ITEM), "job").count() == 0


def test_figure_context(spark):
    rows = [(1, i, 0.0, 0.0, float(w), 1.0, None if i else "c") for i, w in enumerate([1000, 1, 900, 800, 700, 600])] + [(2, 0, 0.0, 0.0, 0.0, 0.0, None)]
    got = {(r["page"], r["box"]): r for r in figure_context(spark.createDataFrame(rows, "page int, box int, l double, b double, r double, t double, caption string")).collect()}
    assert got[1, 1]["child"] and got[1, 1]["siblings"] == [0, 2, 3, 4] and got[1, 1]["relative"] == 0.001
    assert not got[1, 0]["child"] and got[1, 0]["siblings"] == [] and got[2, 0]["relative"] == 0.0


def test_changes_fit(spark):
    cases = [([1, 2], [2, 1]), ([1, 2], [1, 1]), ([1, 2], [1, 3]), ([1], [1, 2]), ([], []), ([1], None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<int>, b array<int>")
    assert [r["x"] for r in df.orderBy("i").select(order_fits(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, False, False, False]
    updates = spark.createDataFrame([(1, "a", None), (1, "b", " set_table_headers "), (2, "a", "manual_only"), (3, None, "")], "k int, table_id string, action string")
    tables = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "table_id string")
    assert {r["k"]: r["valid"] for r in updates_fit(updates, tables, "k").collect()} == {1: True, 2: False, 3: False}


def test_merged_chunks(spark):
    rows = [
        (1, 0, True, "high", " one ", None, [3, 1], {"a": "x", " ": "y"}), (1, 1, True, "low", "two", "cap", [9], {"a": "z"}),
        (1, 2, True, " Medium", "three", " cap  2 ", [1, 2], {"a": "w", "b": "v"}), (2, 0, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, pos int, is_toc boolean, confidence string, reason string, caption string, entry_indexes array<int>, entry_types map<string,string>")
    got = {r["k"]: r for r in merged_chunks(df, "k").collect()}
    assert (got[1]["is_toc"], got[1]["confidence"], got[1]["reason"], got[1]["entry_indexes"], got[1]["entry_types"], got[1]["caption"], got[1]["chunk_count"]) == (True, "high", "one three", [1, 2, 3], {"a": "w", "b": "v"}, "cap 2", 3)
    assert (got[2]["is_toc"], got[2]["confidence"], got[2]["reason"], got[2]["entry_indexes"], got[2]["entry_types"], got[2]["caption"]) == (False, "low", "", [], {}, "")


def test_order_summary(spark):
    rows = [(1, 0, 1, "high", "manual_only", "b", "s", ["x"]), (1, 1, 2, "low", " reorder_review ", "a", "s", []), (1, 2, 0, "high", None, "b", None, ["y"]), (2, 0, 1, "medium", None, None, None, None)]
    got = {r["k"]: tuple(r)[1:] for r in order_summary(spark.createDataFrame(rows, "k int, pos int, page int, confidence string, action string, reason string, summary string, ids array<string>"), "k").collect()}
    assert got == {1: ("reorder_review", "low", "s", "b a", 1, 2), 2: ("confirm_current_order", "medium", "Current reading order looks acceptable on the reviewed pages.", "", 0, 1)}


def test_repair_gate(spark):
    font = lambda k, pos, subtype="/Type1", embedded=True, mapped=False, unread=0, repairable=0, policy=None, base=None: (k, pos, subtype, "/CIDFontType2", embedded, mapped, unread, 0, repairable, policy, base, False, False)
    rows = [font(1, 0, "/Type0"), font(1, 1, policy="explicit", repairable=1), font(2, 0, base="B"), font(2, 1), font(2, 2, base="B"), font(2, 3, "/Type0", embedded=False), font(3, 0, "/Type3"), font(3, 1, mapped=True)]
    df = spark.createDataFrame(rows, "k int, pos int, subtype string, descendant string, embedded boolean, mapped boolean, unread int, missing int, repairable int, policy string, base_font string, unicode_rules boolean, invalid_rules boolean")
    got = {r["k"]: tuple(r)[1:5] + (r["reason"],) for r in repair_gate(df, "k").collect()}
    assert got[1] == (True, 1, 1, 0, "deterministic font candidates available")
    assert got[2] == (False, 0, 0, 3, "unicode issues appear tied to simple fonts without explicit encoding (B, (unnamed))")
    assert got[3] == (False, 0, 0, 0, "no deterministic ToUnicode candidates found")
