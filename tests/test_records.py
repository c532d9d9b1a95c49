"""Functions of encodings, service answers, decisions and candidate choice on cases made by hand."""

from __future__ import annotations

import json

import pandas as pd
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliolens.functions.decisions import decision
from foliolens.functions.encoding import cmap_entries, cmap_text
from foliolens.operators.services import asked, with_answers
from foliolens.plans.records import climbed, code_accepted, escaped, files_under, frequent_word_language, grounded_candidates


def test_cmap_ranges_lists_comments_and_what_cannot_be_read():
    text = """2 beginbfchar
<01> <0041> % <01> <0042>
<02> <D800>
<03>
endbfchar
1 beginbfrange
<10> <12> <0061>
<20> <22> [<0078> <> <007A>]
<30> <2F> <0061>
<0000> <FFFFFF> <0061>
<40> <41> <00610062>
<50> <51> <FEFE>
endbfrange
<99> <0041>"""
    assert cmap_entries(text) == ({1: "A", 16: "a", 17: "b", 18: "c", 32: "x", 33: "z", 80: "\ufefe"}, 5)
    assert cmap_entries(None) == ({}, 0) and cmap_entries("") == ({}, 0)


letters = st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00\ufeff\ufffe"), min_size=1, max_size=3)


def test_cmap_round_trip_in_sections(spark):
    entries = {i: chr(0x4E00 + i) + ("\U0001f600" if i % 7 == 0 else "") for i in range(250)}
    rows = [(1, [(k, v) for k, v in entries.items()] + [(70_000, "out"), (7_000, "a\x00"), (7_001, "")]), (2, [])]
    df = spark.createDataFrame(rows, "id int, entries array<struct<code:bigint,text:string>>")
    got = {r["id"]: r["cmap"] for r in df.select("id", cmap_text(F.col("entries"), 2).alias("cmap")).collect()}
    assert cmap_entries(got[1]) == (entries, 0)
    assert got[1].count("100 beginbfchar") == 2 and got[1].count("50 beginbfchar") == 1
    assert "beginbfchar" not in got[2] and got[2].endswith("end\nend\n")


@given(st.dictionaries(st.integers(0, 255), letters, max_size=20))
def test_cmap_entries_reads_what_is_written(entries):
    lines = [f"<{k:02X}> <{v.encode('utf-16-be').hex()}>" for k, v in entries.items()]
    assert cmap_entries("\n".join([f"{len(lines)} beginbfchar", *lines, "endbfchar"])) == (entries, 0)


def test_asked_tries_again_and_keeps_the_last_error():
    calls = []

    def ask(rows):
        calls.append(len(rows))
        if len(calls) < 3:
            raise OSError("later")
        return [{"x": 1}] * len(rows)

    rows = pd.DataFrame({"a": [1, 2]})
    assert asked(ask, rows, 3, 0.0) == ([{"x": 1}] * 2, None)
    assert asked(lambda r: [], rows, 2, 0.0) == ([None, None], "0 answers to 2 rows")


def test_batches_are_bounded_and_of_one_page(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("page"), F.floor(F.col("id") / 2).alias("pos"))
    got = with_answers(rows, "page", "pos", lambda r: [{"n": len(r), "pages": r["page"].nunique()}] * len(r), "n int, pages int").collect()
    assert len(got) == 100 and max(r["n"] for r in got) == 8 and {r["pages"] for r in got} == {1}


def test_batches_are_whole_across_arrow_batches_and_nulls_go_alone(spark):
    rows = spark.range(50).select(F.col("id").alias("pos"), F.when(F.col("id") < 48, F.floor(F.col("id") / 24)).alias("page"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = with_answers(rows, "page", "pos", lambda r: [{"n": len(r)}] * len(r), "n int").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted((r["pos"], r["n"]) for r in got) == [(i, 8 if i < 48 else 1) for i in range(50)]
    assert with_answers(rows.where("pos < 0"), "page", "pos", lambda r: [], "n int").count() == 0


def test_decision_defaults_and_cleaning(spark):
    verdicts = [None, "no json", json.dumps({"confidence": " HIGH", "header_rows": [3, 0, -1, 3], "entry_types": {" a ": " b ", "c": " "}, "entry_text_overrides": {"k": " two   words "}, "alt_text": " ", "is_toc": True})]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(verdicts)], "id int, v string")
    got = [r["d"] for r in df.select("id", decision(F.col("id").cast("string"), F.lit("t"), F.col("v")).alias("d")).orderBy("id").collect()]
    for d in got[:2]:
        assert (d.confidence, d.confidence_score, d.suggested_action, d.header_rows, d.entry_types, d.is_toc, d.alt_text) == ("low", 0.5, "manual_only", [], {}, False, None)
    d = got[2]
    assert (d.confidence, d.confidence_score, d.header_rows, d.entry_types, d.entry_text_overrides, d.is_toc, d.alt_text) == ("high", 0.9, [0, 3], {"a": "b"}, {"k": "two words"}, True, None)
    assert len(d) == 22


def test_climbed_keeps_only_what_beats_the_best(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([5, 7, 5, 4, 4, 1])], "k int, i int, x int")
    assert [r["accepted"] for r in climbed(df, "k", "i", "x").orderBy("i").collect()] == [True, False, False, True, False, True]


def test_escaped_text(spark):
    assert spark.createDataFrame([("<a & 'b\">",), (None,)], "t string").select(escaped(F.col("t")).alias("x")).collect() == [("&lt;a &amp; &#x27;b&quot;&gt;",), ("",)]


def test_files_are_found_once(spark, sf_dir):
    got = [r["path"] for r in files_under(spark, [sf_dir], [f"{sf_dir}/region.parquet"], "re*.parquet").collect()]
    assert len(got) == 1 and got[0].endswith("region.parquet")


def test_grounded_candidates(spark):
    rows = [
        (1, 0, "p", "h e l l o w o r l d", "hello world"),  # apart: spacing only
        (1, 1, "p", "plain words here", "other words there"),  # nothing suspicious
        (1, 2, "artifact", "h e l l o w o r l d", "hello world"),
        (1, 3, "p", "a b c d e f g", None),
        (2, 0, "p", "x y z w v u", "q r s t u v w"),  # reads differently
        (2, 1, "p", "x y z w v u", "x y z w v u and very much more text than that"),  # holds far more
        (2, 2, "p", None, "text"),
    ]
    got = grounded_candidates(spark.createDataFrame(rows, "page int, pos int, role string, text string, ocr string")).collect()
    assert [(r["page"], r["pos"], r["issue_type"]) for r in got] == [(2, 0, "encoding_problem"), (1, 0, "spacing_only")]
    assert got[1]["next_text"] == "plain words here" and got[1]["previous_text"] == ""


def test_code_accepted(spark):
    code = "def f(x):\n    return x"
    rows = [(1, "code", "high", True, code, "def f(x): return x", None), (2, "code", "high", True, code, "unlike", None), (3, "p", "high", True, code, code, code), (4, "code", "high", True, "one line = 1", "one line = 1", ""), (5, "code", None, None, None, None, None)]
    df = spark.createDataFrame([(i, r, k, b, "encoding_problem", h, n, o) for i, r, k, b, h, n, o in rows], "id int, role string, confidence string, blocking boolean, issue_type string, hint string, native string, ocr string")
    assert {r["id"]: r["accepted"] for r in code_accepted(df).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_frequent_word_language(spark):
    rows = [("the cat and the dog of it is here",), ("le chat et la souris dans une maison avec toi",), ("the short",), ("a1 b2 c3 d4 e5 f6 g7 h8",), (None,), ("",)]
    got = [r["x"] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(frequent_word_language(F.col("t")).alias("x")).collect()]
    assert got == ["en", "fr", None, None, None, None]
