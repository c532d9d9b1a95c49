"""Decisions on documents, case by case."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from foliolens.functions import lanes as L
from foliolens.plans.registry import ORACLE_SQL, QUERIES


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_published_counts_of_rule_coverage():
    first: dict[str, str] = {}
    for status, _, listed in L.COVERAGE:
        for rule in L.rules_of(listed):
            first.setdefault(rule, status)
    n = Counter(first.values())
    assert (n["partial"], n["unproven"]) == (53, 10)
    assert first["7.2-40"] == "covered" and first["7.2-41"] == "partial"


def test_rule_coverage_falls_back(spark):
    got = [tuple(one(spark, L.rule_coverage(F.lit(r), F.lit(t)))) for r, t in (("5-9", "x"), ("9-9", "metadata"), ("9-9", None), (None, None))]
    assert got == [("covered", "identification"), ("covered", "metadata"), ("unproven", "other"), ("unproven", "other")]


def lanes(spark, *, embed=False, unicode=True, dictionary=False, unembedded=0, candidates=None, reason=None, skip=(), force=False):
    skip = F.array(*map(F.lit, skip)).cast("array<string>")
    x = one(spark, L.font_lanes(F.lit(embed), F.lit(unicode), F.lit(dictionary), F.lit(unembedded), F.lit(candidates).cast("int"), F.lit(reason).cast("string"), skip, force))
    return x["lanes"], x["skipped"]


def test_font_lanes(spark):
    assert lanes(spark) == (["repair_tounicode", "embed_fonts", "ocr_redo"], [])
    assert lanes(spark, unembedded=2, dictionary=True, force=True)[0] == ["repair_font_dicts", "embed_fonts", "repair_tounicode", "ocr_redo", "ocr_force"]
    assert lanes(spark, candidates=0) == (["embed_fonts", "ocr_redo"], ["ToUnicode repair skipped: no deterministic font candidates"])
    assert lanes(spark, candidates=0, reason="why", skip=["a", "b"]) == (["embed_fonts"], ["ToUnicode repair skipped: why", "OCR lanes skipped: a; b"])
    assert lanes(spark, unicode=False) == (["embed_fonts"], ["No known font remediation rule family matched"])
    assert lanes(spark, unicode=False, embed=True) == (["embed_fonts"], [])


def test_ocr_skip_reasons(spark):
    reasons = lambda kind, suspect, forms, pages: one(spark, L.ocr_skip_reasons(F.lit(kind).cast("string"), F.lit(suspect), F.lit(forms), F.lit(pages)))
    assert reasons(" DIGITAL ", 0, True, 41) == ["digital document", "fillable forms present", "page count 41 > limit 40"]
    assert reasons("digital", 1, False, 200) == [] and reasons(None, 1, False, 201) == ["page count 201 > limit 200"]


def test_figure_decision(spark):
    def reason(area=0.6, share=0.8, figures=0, fields=0, blocks=3, chars=900, long=2, fragmentary=0.0):
        return tuple(one(spark, L.figure_decision(*map(F.lit, (area, share, figures, fields, blocks, chars, long, fragmentary)))))

    assert reason(area=0.54) == (False, "image_not_dominant") == reason(share=0.69)
    assert reason(figures=1) == (False, "figure_already_present") and reason(fields=1) == (False, "page_contains_fields")
    assert reason(blocks=0) == (True, "dominant_image_without_text") and reason(chars=260, long=0) == (True, "dominant_image_with_sparse_text")
    assert reason(blocks=1, area=0.72) == (True, "dominant_image_with_single_text_block")
    assert reason(long=1, fragmentary=0.6) == (True, "dominant_image_with_fragmentary_text") and reason() == (False, "narrative_text_already_present")


def test_title_decision_and_plan(spark):
    decide = lambda t, e: tuple(one(spark, L.title_decision(F.lit(t).cast("string"), F.array(*map(F.lit, e)).cast("array<string>"))))
    assert decide(None, []) == decide("  ", ["x"]) == ("ask", "missing_title")
    assert decide("Annual Report", ["annual report", "A Guide to Forms"]) == ("ask", "early_title_evidence_requires_adjudication")
    assert decide("Annual Report", ["Annual Report!"]) == decide("Annual Report", ["Other"]) == decide("!!", ["x"]) == ("keep", "title_present")
    assert decide("A very long annual report title", ["annual report", "other words"]) == ("keep", "title_present")
    plan = one(spark, L.escalation_plan(F.lit(""), F.array(), F.lit(False)))
    assert {k: v["decision"] for k, v in plan.items()} == {"title": "ask", "toc": "ask", "bookmarks": "ask", "language": "keep"}


@pytest.mark.parametrize("name", ["p38_title_decision", "p39_escalation_plan"])
def test_titles_of_two_words_over_many_lines_equal_sql(spark, tmp_path, name):
    """Two words by blanks that hold five by white space; line breaks alone; blanks alone; a page without a title."""
    firsts = {1: "One.\nTwo.\nThree four.\nFive six", 2: "\n\t \n x", 3: "   x", 4: "a\tb\x0bc\x0cd\re f", 5: "One two", 6: "One two"}
    rows = [(i, turn, "user", text) for i, first in firsts.items() for turn, text in enumerate((first, "Another text", ""))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", ["p38_title_decision", "p39_escalation_plan"])
def test_titles_of_odd_texts_equal_sql(spark, tmp_path, name):
    """A first turn without a text; blanks of other widths alone, before a word, before a line separator; a capital sigma at a word's end that another text has as a small one; no texts at all."""
    pages = {1: (None, "Another text"), 2: ("\xa0\u2003 \u3000 x", "Another text"), 3: ("\xa0\u2028", "Another text"), 4: ("\u0391\u03a3 1", "\u03b1\u03c3"), 6: (None, None), 7: ("\xa0\u3000",)}
    rows = [(i, turn, "user", text) for i, texts in pages.items() for turn, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall())
