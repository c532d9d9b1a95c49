"""Font diagnostics on cases made by hand."""

from __future__ import annotations

from foliolens.operators.fonts import font_profiles, font_summary

FONTS = "doc int, font int, name string, subtype string, embedded boolean, has_map boolean, policy string, invalid_entries int, missing_codes int, unresolved_codes int, embed_support string, program_available boolean"


def test_issues_order_and_counts(spark):
    fonts = spark.createDataFrame([
        (1, 1, "Fine", "/Type0", True, True, "", 0, 0, 0, None, None),
        (1, 2, "b", "/Type1", False, False, "blocked", 1, 2, 1, "simple", False),
        (1, 3, "A", "/TrueType", False, True, "safe", 0, 0, 0, "simple", True),
        (1, 4, "a", "/Type3", None, True, None, None, None, None, "", True),
    ], FONTS)
    got = [(r["font"], r["issues"]) for r in sorted(font_profiles(fonts).collect(), key=lambda r: r["rank"])]
    assert got == [
        (2, ["unembedded", "local_font_program_missing", "missing_tounicode", "invalid_tounicode", "missing_used_codes", "unresolved_used_codes", "blocked_auto_unicode"]),
        (4, ["unembedded", "local_embed_unsupported"]), (3, ["unembedded"]), (1, [])]
    assert [r["font"] for r in font_profiles(fonts, 1).collect()] == [2]
    faults = spark.createDataFrame([(1, "error", "x 7.21.7-2"), (2, "warning", "7.21.7-2"), (2, "error", None)], "doc int, severity string, rule_id string")
    one, two = sorted((r.asDict() for r in font_summary(fonts, faults).collect()), key=lambda r: r["doc"])
    assert (one["fonts_total"], one["simple_fonts"], one["type0_fonts"], one["embedded_fonts"], one["unembedded_fonts"]) == (4, 2, 1, 1, 3)
    assert (one["local_embed_candidate_count"], one["local_embed_missing_program_count"], one["unsupported_unembedded_fonts"], one["invalid_unicode_rule_present"]) == (1, 1, 1, True)
    assert two["fonts_total"] == 0 and two["invalid_unicode_rule_present"] is False


def test_no_fonts(spark):
    assert font_profiles(spark.createDataFrame([], FONTS)).count() == 0
