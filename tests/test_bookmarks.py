"""Comparison of bookmarks on cases made by hand."""

from __future__ import annotations

from foliolens.operators.bookmarks import compare_bookmarks


def test_titles_match_by_key_or_ordered_terms_and_are_split(spark):
    rows = [
        (1, ["Part 2: Don't", "Annual Report", "Lost Title", "Out of Order", "Higher Lost"], ["PART2 DONT\nmore", "annual  (draft) report", "order out of", None],
         ["see part 2 don t", "the lost title.", "annual x report", None]),
        (2, [], ["a"], None), (3, None, None, None), (4, ["Z", "...", None], ["z"], ["z"]), (5, [f"t{i}" for i in range(12)], [], []),
    ]
    got = {r["doc"]: r for r in compare_bookmarks(spark.createDataFrame(rows, "doc int, gold array<string>, candidate array<string>, sources array<string>")).collect()}
    one = got[1]
    assert (one["gold_total"], one["candidate_total"], one["matched_titles"], one["match_rate"]) == (5, 4, 2, 0.4)
    assert one["missing_titles"] == ["Lost Title", "Out of Order", "Higher Lost"]
    assert (one["recoverable_gold_total"], one["recoverable_matched_titles"], one["recoverable_match_rate"], one["missing_recoverable_titles"]) == (2, 1, 0.5, ["Lost Title"])
    assert (one["higher_order_gold_total"], one["higher_order_matched_titles"], one["higher_order_match_rate"]) == (3, 1, 0.3333)
    assert got[2]["match_rate"] is None and got[3]["gold_total"] == 0 and got[3]["recoverable_match_rate"] is None
    assert (got[4]["matched_titles"], got[4]["missing_titles"]) == (1, ["...", None])
    assert got[5]["missing_titles"] == [f"t{i}" for i in range(10)]
