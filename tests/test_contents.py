"""Contents, bookmarks, table decisions and flagged texts on cases made by hand."""

from __future__ import annotations

from foliolens.operators import contents as O
from foliolens.operators import overlays as V

ELEMENTS = "doc int, pos int, page int, type string, text string, grp int"


def test_contents_become_bookmarks(spark):
    elements = spark.createDataFrame([
        (1, 0, 0, "toc_caption", "Contents", 7), (1, 1, 0, "toc_item", "Intro ... 3", 7), (1, 2, 9, "toc_item", "Lost 4", None), (1, 3, None, "toc_item_table", "INTRO!", 7), (1, 4, 0, "toc_item", "12 ... 3", 7),
        (1, 5, 0, "paragraph", "Intro", 7), (1, 6, 1, "toc_item", "2.1 Deep .... iv", 8), (1, 7, 0, "toc_item", None, 7), (2, 0, 0, "toc_item", "Intro", None)], ELEMENTS)
    headings = spark.createDataFrame([(1, 10, 4, 6, "Intro"), (1, 9, 2, None, "intro."), (1, 11, 3, 9, "2.1 deep"), (3, 0, 0, 1, "")], "doc int, pos int, page int, level int, text string")
    pages = spark.createDataFrame([(1, 5), (2, 0)], "doc int, pages int")
    got = {(r["doc"], r["pos"]): (r["text"], r["page"], r["source_page"], r["level"], r["section"]) for r in O.contents_bookmarks(elements, headings, pages).collect()}
    assert got == {
        (1, 0): ("Contents", 0, 0, 1, ""), (1, 1): ("Intro", 2, 0, 2, ""), (1, 2): ("Lost", 0, 0, 1, ""), (1, 6): ("2.1 Deep", 3, 1, 6, "2.1"), (2, 0): ("Intro", 0, 0, 1, "")}


def test_candidates_have_the_nearest_texts(spark):
    rows = [(1, 0, 0, "toc_item", "One 1", 0), (1, 1, 0, "heading", "Front", 0), (1, 2, 1, "paragraph", "body a", 0), (1, 3, 1, "figure", "x", 0), (1, 4, 1, "heading", "One", 0), (1, 5, 1, "heading", " ", 0),
            (1, 6, 2, "note", "1.2 note", 0), (1, 7, None, "heading", "no page", 0), (1, 8, 2, "heading", "1.2 Two", 0), (2, 0, 5, "heading", "no contents", 0)]
    elements = spark.createDataFrame(rows, ELEMENTS)
    got = {r["pos"]: tuple(r)[2:] for r in O.bookmark_candidates(elements).collect()}
    assert got == {
        2: ("landmark", 2, "body a", "", "", "", "One", "", ""), 4: ("heading", 2, "One", "", "", "Front", "1.2 Two", "body a", ""),
        6: ("landmark", 3, "1.2 note", "1.2", "1", "One", "1.2 Two", "", ""), 8: ("heading", 3, "1.2 Two", "1.2", "1", "One", "", "", "")}
    assert [tuple(r) for r in O.contents_targets(elements).collect()] == [(1, 0, "One", 4)]
    assert O.bookmark_candidates(elements.where("doc = 2")).count() == 0


def test_last_headers_count_and_confidence_never_falls(spark):
    tables = spark.createDataFrame([(1, 1, "a", [5], [5], 0.9), (1, 1, "b", [5], [], 0.1), (1, 2, "c", [0], [], None), (1, 2, "d", [], [], 0.2)], "doc int, page int, tbl string, header_rows array<int>, header_cols array<int>, confidence double")
    asked = [(1, 0, 1, " a ", "set_table_headers", [1], [0], 0.4), (1, 1, 1, "a", "set_table_headers", [2, -1, 0, 2], None, 0.3), (1, 2, 1, "a", "keep", [9], [9], 0.2), (1, 3, 1, "b", "keep", [9], [], 0.0),
             (1, 4, 1, "c", "set_table_headers", [1], [], 0.9), (1, 5, 0, "d", "set_table_headers", [1], [], 0.9), (1, 6, 2, " ", "set_table_headers", [1], [], 0.9)]
    decided = V.table_decisions(tables, spark.createDataFrame(asked, "doc int, place int, page int, tbl string, action string, header_rows array<int>, header_cols array<int>, confidence double"))
    got = {r["tbl"]: tuple(r)[3:] for r in decided.collect()}
    assert got == {"a": ([0, 2], [], 0.9, True, True), "b": ([5], [], 0.5, False, True), "c": ([0], [], None, False, False), "d": ([], [], 0.2, False, False)}
    cells = spark.createDataFrame([(1, 1, "a", 0, 0, False, True), (1, 1, "a", 1, 0, True, True), (1, 1, "b", 0, 0, None, True), (1, 9, "z", 0, 0, None, None)], "doc int, page int, tbl string, row int, col int, column_header boolean, row_header boolean")
    assert sorted(tuple(r)[2:4] + (r["column_header"], r["row_header"], r["is_header"]) for r in V.with_headers(cells, decided).collect()) == [
        ("a", 0, True, False, True), ("a", 1, False, False, False), ("b", 0, None, True, True), ("z", 0, None, None, False)]


def test_flagged_texts_are_dropped_or_block(spark):
    kinds = "doc int, place int, task_type string, source string, candidate boolean, title string, severity string, blocking boolean"
    rows = [(d, p, "content_fidelity", s, k, "t", "low", False) for d, p, s, k in ((1, 0, "other", True), (1, 1, None, True), (1, 2, "fidelity", True), (2, 0, None, True), (2, 1, None, None), (3, 0, None, False))]
    blocks = [(1, 4, " a", True), (1, 2, "encoding_problem", True), (1, 2, None, True), (1, 9, "b", False), (2, 1, "a", False), (3, 1, "a", True)]
    found = V.adjudicated_tasks(spark.createDataFrame(rows, kinds), spark.createDataFrame(blocks, "doc int, page int, issue_type string, blocks_access boolean"))
    got = {(r["doc"], r["place"]): (r["severity"], r["blocking"], r["issue_types"], r["pages_to_check"], r["confirmed"], r["encoding_problems"]) for r in found.collect()}
    plain = ("low", False, None, None, None, None)
    assert got == {(1, 0): plain, (1, 1): ("high", True, ["a", "encoding_problem"], [2, 4], 3, 1), (1, 2): plain, (2, 1): plain, (3, 0): plain}
