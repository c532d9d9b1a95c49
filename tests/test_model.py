"""The page model on cases made by hand."""

from __future__ import annotations

from foliolens.operators.model import document_pages

ELEMENTS = "doc int, pos int, page int, review_id string, type string, text string, resolved_text string, actual_text string, hint string, level int"
CELLS = "doc int, tbl string, pos int, row int, col int, text string, is_header boolean, column_header boolean, row_header boolean"
FIELDS = "doc int, page int, ord int, field_id string, kind string, name string, label string, value string"


def test_pages_hold_blocks_tables_and_fields_in_order(spark):
    elements = spark.createDataFrame([
        (1, 0, 0, "a", "heading", " A  title ", "", "said", "hint", 2), (1, 1, 0, None, " table ", "grid", None, None, None, None), (1, 2, 0, "", None, "x" * 300, None, None, " ", None),
        (1, 3, None, "n", "heading", "no page", None, None, None, None), (1, 4, -1, "m", "heading", "none", None, None, None, None), (1, 5, 2, "t", "table", None, None, None, None, None)], ELEMENTS)
    cells = spark.createDataFrame([(1, "review-1", 1, 1, 0, "b", None, None, True), (1, "review-1", 0, None, None, "c" * 130, False, True, None), (1, "gone", 0, 0, 0, "z", None, None, None), (1, "a", 0, 0, 0, "z", None, None, None)], CELLS)
    fields = spark.createDataFrame([(1, 1, 2, "f2", "text", "n", None, " v "), (1, 1, 1, "f1", "text", "n", None, None), (1, 9, 1, "f3", "text", None, None, None)], FIELDS)
    got = {r["page"]: r for r in document_pages(elements, cells, fields).collect()}
    assert sorted(got) == [1, 3, 9]
    one = got[1]
    assert [(b["ord"], b["id"], b["role"], b["text"], b["resolved"], b["level"]) for b in one["blocks"]] == [(1, "a", "heading", "A title", "said", 2), (3, "review-2", "paragraph", "x" * 240, None, None)]
    (table,) = one["tables"]
    assert (table["ord"], table["id"], table["excerpt"], table["header_rows"], table["header_cols"]) == (2, "review-1", "grid", [0], [0])
    assert [(x["row"], x["col"], len(x["text"]), x["is_header"]) for x in table["cells"]] == [(0, 0, 120, True), (1, 0, 1, True)]
    assert [(f["field_id"], f["value"]) for f in one["fields"]] == [("f1", ""), ("f2", "v")]
    assert got[3]["tables"][0]["cells"] is None and got[3]["blocks"] == [] and got[9]["blocks"] == [] and got[9]["fields"][0]["field_id"] == "f3"


def test_empty_tables(spark):
    assert document_pages(spark.createDataFrame([], ELEMENTS), spark.createDataFrame([], CELLS), spark.createDataFrame([], FIELDS)).count() == 0
