"""Gold and candidate documents compared, on cases made by hand."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from foliolens.operators.roundtrip import Side, compare_documents

KINDS = {
    "documents": "doc int, pages int, lang string, title string, text string",
    "elements": "doc int, pos int, type string, text string, caption string",
    "fields": "doc int, pos int, page int, ord int, kind string, name string, label string",
    "links": "doc int, pos int, page int, ord int, uri string, dest string, contents string, descriptive boolean",
    "titles": "doc int, pos int, title string",
}
ASSERTIONS = "doc int, set string, id string, kind string, expected array<string>, page int, field_name string, field_type string, uri string, dest string, match_mode string, terms_all array<string>, terms_any array<string>"

GOLD = {
    "documents": [(1, 2, "en-US", "Annual Report", "one two three"), (2, 1, None, None, None), (3, 1, "de", "x", "y")],
    "elements": [
        (1, 0, "heading", "Chapter One of the annual report", None), (1, 1, "paragraph", "The second passage is longer than that", None), (1, 2, "paragraph", "The THIRD passage, a little longer", None),
        (1, 3, "figure", "", "A caption"), (1, 4, "artifact", "This is only in the margin of a page", None), (1, 5, "toc_item", "Contents line that is long enough", None), (1, 6, "paragraph", "The second passage is longer than that", None)],
    "fields": [(1, 0, 1, 0, "text", "First_Name", "Your name"), (1, 1, 1, 1, "text", "b", "City"), (1, 2, 1, 2, "button", "c", " "), (1, 3, 2, 0, "text", "d", "!!")],
    "links": [(1, 0, 1, 0, "http://a", None, "Read the report", True), (1, 1, 1, 1, "b", None, "a b", True), (1, 2, 1, 2, "c", None, "here", False), (1, 3, 1, 3, "d", "q", "gone", True)],
    "titles": [(1, 0, "Chapter One"), (1, 1, "Higher Thing"), (1, 2, " ")],
}
OTHER = {
    "documents": [(1, 2, "en", "ANNUAL REPORT: final", "one two four"), (2, 2, "en", "t", ""), (4, 1, None, None, None)],
    "elements": [(1, 0, "paragraph", "The second passage is longer than that", None), (1, 1, "heading", "Chapter One of the Annual Report", None), (1, 2, "paragraph", "the third passage a little longer", None)],
    "fields": [(1, 0, 1, 0, "text", "first name", "old"), (1, 9, 1, 0, "text", "FIRST NAME", "your  NAME."), (1, 1, 1, 1, "text", "b", "Town"), (1, 2, 1, 2, "text", "c", "")],
    "links": [(1, 0, 1, 0, "HTTP a", None, "Read all the (new) report", True), (1, 1, 1, 1, "b", None, "b a", True)],
    "titles": [(1, 0, "chapter one!")],
}


def side(spark, rows: dict) -> Side:
    return Side(**{k: spark.createDataFrame(rows[k], kind) for k, kind in KINDS.items()})


def assertion(kind: str, *expected: str, doc: int = 1, set: str = "recoverable", **more) -> tuple:
    names = [x.split()[0] for x in ASSERTIONS.split(", ")]
    return tuple({"doc": doc, "set": set, "id": kind, "kind": kind, "expected": list(expected), **more}.get(k) for k in names)


@pytest.fixture(scope="module")
def report(spark):
    asked = [
        assertion("document_lang", "EN"), assertion("title_equals", "annual-report"), assertion("title_contains", "annual report"), assertion("text_contains", "two THREE"), assertion("ordered_text", "one", "three"),
        assertion("field_present", field_name="first name", page=1), assertion("field_type", field_type="button"), assertion("field_accessible_name", "your name", field_name="first_name"),
        assertion("field_accessible_name", field_name="b", terms_any=["city", "town"]), assertion("link_contents", "read the report", uri="http a"), assertion("bookmark_title", "chapter one"),
        assertion("bookmark_title", "nothing", set="hidden"), assertion("odd", "x", set="hidden"), assertion("text_contains", None, set="hidden"),
    ]
    rows = compare_documents(side(spark, GOLD), side(spark, OTHER), spark.createDataFrame(asked, ASSERTIONS)).collect()
    return {r["doc"]: r for r in rows}


def test_only_documents_on_both_sides(report):
    assert sorted(report) == [1, 2]
    two = report[2]
    assert not (two["page_count_match"] or two["document_lang_match"] or two["title_match"])
    assert (two["raw_text_similarity"], two["gold_fields"], two["field_presence_match_rate"], two["bookmark_match_rate"], two["match_mode"], two["recoverable_passed"]) == (1.0, 0, None, None, "none", 0)


def test_description_and_structure(report):
    one = report[1]
    assert one["page_count_match"] and one["document_lang_match"] and one["title_match"]
    assert one["raw_text_similarity"] == round(2 * 9 / 25, 4)
    assert [(t["type"], t["gold"], t["candidate"], t["recall"], t["surplus"]) for t in one["types"]] == [("heading", 1, 1, 1.0, 0), ("paragraph", 3, 2, 0.6667, 0), ("figure", 1, 0, 0.0, 0)]
    assert (one["gold_typed"], one["matched_typed"], one["recoverable_type_recall"]) == (5, 3, 0.6)
    assert (one["fragments_considered"], one["matched_fragments"], one["ordered_fragments"], one["hit_rate"], one["order_rate"], one["match_mode"]) == (3, 3, 2, 1.0, 0.6667, "dense")


def test_fields_links_and_bookmarks(report):
    one = report[1]
    assert (one["gold_fields"], one["candidate_fields"], one["matched_fields"], one["matched_field_types"], one["gold_named_fields"], one["matched_named_fields"]) == (4, 4, 2, 2, 3, 1)
    assert [(m["name"], m["actual"]) for m in one["field_mismatches"]] == [("b", "Town"), ("d", "")]
    assert (one["gold_links"], one["candidate_links"], one["gold_descriptive_links"], one["matched_descriptive_links"], one["descriptive_link_match_rate"]) == (4, 2, 3, 1, 0.3333)
    assert [m["expected"] for m in one["link_mismatches"]] == ["a b", "gone"]
    assert (one["bookmark_gold_total"], one["bookmark_matched_titles"], one["bookmark_recoverable_gold_total"], one["bookmark_missing_higher_order_titles"]) == (2, 1, 1, ["Higher Thing"])


def test_assertions(report):
    one = report[1]
    assert (one["recoverable_passed"], one["recoverable_failed"], one["recoverable_invalid"]) == (7, 4, 0)
    assert (one["hidden_passed"], one["hidden_failed"], one["hidden_invalid"]) == (0, 0, 3)


def test_empty_frames(spark):
    empty = Side(**{k: spark.createDataFrame([], kind) for k, kind in KINDS.items()})
    assert compare_documents(empty, empty, spark.createDataFrame([], ASSERTIONS)).count() == 0
    assert compare_documents(side(spark, GOLD), empty._replace(documents=side(spark, GOLD).documents)).agg(F.sum("matched_fields")).first()[0] == 0


def test_frames_are_gathered_once(spark):
    """A task that joins every frame of a document on its own holds a sort for each, and their pages pass its memory."""
    asked = spark.createDataFrame([assertion("document_lang", "EN")], ASSERTIONS)
    plan = compare_documents(side(spark, GOLD), side(spark, OTHER), asked)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\b(?:SortMerge|BroadcastHash|ShuffledHash)Join\b", plan)) <= 5
