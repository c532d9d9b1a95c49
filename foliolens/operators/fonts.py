"""Diagnostics of the fonts of a document: what is wrong with each, the worst first, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# Subtypes of simple and composite fonts, the rule of invalid characters, the profiles shown.
SIMPLE_SUBTYPES = ("/Type1", "/MMType1", "/TrueType")
COMPOSITE_SUBTYPE = "/Type0"
INVALID_UNICODE_RULE = "7.21.7-2"
MOST_PROFILES = 24


def _supported() -> Column:
    return F.coalesce(c("embed_support"), F.lit("")) != ""


def with_issues(fonts: DataFrame) -> DataFrame:
    """``fonts`` with ``issues``, the names of what is wrong with each in a fixed order.

    A row is (doc, font, name, subtype, embedded, has_map, policy, invalid_entries,
    missing_codes, unresolved_codes, embed_support, program_available). Null flags count as
    false, null counts as 0, an ``embed_support`` of null or no letters as none.
    """
    yes = lambda name: F.coalesce(c(name), F.lit(False))
    # Names of the issues.
    issues = F.array(
        F.when(~yes("embedded"), "unembedded"),
        F.when(~yes("embedded") & _supported() & ~yes("program_available"), "local_font_program_missing"),
        F.when(~yes("embedded") & ~_supported(), "local_embed_unsupported"),
        F.when(~yes("has_map"), "missing_tounicode"),
        F.when(c("invalid_entries") > 0, "invalid_tounicode"),
        F.when(c("missing_codes") > 0, "missing_used_codes"),
        F.when(c("unresolved_codes") > 0, "unresolved_used_codes"),
        F.when(c("policy") == "blocked", "blocked_auto_unicode"))
    return fonts.withColumn("issues", F.array_compact(issues))


def font_profiles(fonts: DataFrame, most: int = MOST_PROFILES) -> DataFrame:
    """The ``most`` worst fonts of each document with their ``issues`` and ``rank`` (from 1).

    Most issues first, then unresolved codes, invalid entries, missing codes, name in small
    letters, and the font's id for those alike.
    """
    worse = [F.size("issues").desc(), *[F.coalesce(c(k), F.lit(0)).desc() for k in ("unresolved_codes", "invalid_entries", "missing_codes")], F.lower("name"), c("font")]
    ranked = with_issues(fonts).withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(*worse)))
    return ranked.where(c("rank") <= most)


def font_summary(fonts: DataFrame, violations: DataFrame) -> DataFrame:
    """Counts of the fonts of each document, and whether an error of ``violations`` (doc, severity, rule_id) names the rule of invalid characters.

    A document in either frame has a row. Both are reduced before they are shuffled.
    """
    has = lambda issue: F.array_contains("issues", issue)
    loose = has("unembedded")
    counts = {
        "fonts_total": F.lit(True),
        "simple_fonts": c("subtype").isin(*SIMPLE_SUBTYPES), "type0_fonts": c("subtype") == COMPOSITE_SUBTYPE,
        "embedded_fonts": ~loose, "unembedded_fonts": loose,
        "fonts_with_tounicode": ~has("missing_tounicode"), "fonts_missing_tounicode": has("missing_tounicode"),
        "fonts_with_invalid_tounicode": has("invalid_tounicode"), "fonts_with_missing_used_codes": has("missing_used_codes"),
        "fonts_with_unresolved_used_codes": has("unresolved_used_codes"), "blocked_auto_unicode_fonts": has("blocked_auto_unicode"),
        "local_embed_candidate_count": loose & ~has("local_font_program_missing") & ~has("local_embed_unsupported"),
        "local_embed_missing_program_count": has("local_font_program_missing"), "unsupported_unembedded_fonts": has("local_embed_unsupported"),
    }
    counted = with_issues(fonts).groupBy("doc").agg(*[F.count_if(x).alias(name) for name, x in counts.items()])
    named = violations.groupBy("doc").agg(F.max((c("severity") == "error") & F.contains(c("rule_id"), F.lit(INVALID_UNICODE_RULE))).alias("flag"))
    return counted.join(named, "doc", "full").select(
        "doc", *[F.coalesce(c(k), F.lit(0)).alias(k) for k in counts], F.coalesce("flag", F.lit(False)).alias("invalid_unicode_rule_present"))
