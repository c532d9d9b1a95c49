"""Queries of font diagnostics, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.operators import fonts as O
from foliolens.plans.registry import query
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames

c = F.col


# Parts as fonts, forty to a document.
def fonts(spark, folder) -> DataFrame:
    key = c("p_partkey")
    subtype = F.element_at(F.array(*map(F.lit, ("/Type0", "/Type1", "/MMType1", "/TrueType", "/Type3"))), (key % 5 + 1).cast("int"))
    above = lambda x, n: F.greatest(x - n, F.lit(0)).cast("int")
    return S.table(spark, folder, "part").select(
        F.floor(key / 40).alias("doc"), key.alias("font"), c("p_name").alias("name"), subtype.alias("subtype"), (c("p_size") % 3 != 0).alias("embedded"), (c("p_size") % 4 != 1).alias("has_map"),
        F.when(c("p_size") % 5 == 0, "blocked").otherwise("safe").alias("policy"), above(key % 7, 4).alias("invalid_entries"), above(c("p_size") % 11, 6).alias("missing_codes"),
        above(c("p_size") % 11, 8).alias("unresolved_codes"), F.when(key % 3 == 0, "").when(key % 3 == 1, "simple").alias("embed_support"), (key % 2 == 0).alias("program_available"))


def violations(spark, folder) -> DataFrame:
    rule = F.when(c("rule_id") == "error", "PDF/UA-1/7.21.7-2").otherwise(c("rule_id"))
    return S.violations(spark, folder).select("doc", "severity", rule.alias("rule_id"))


_FONTS = """fonts AS (SELECT p_partkey // 40 AS doc, p_partkey AS font, p_name AS name, ['/Type0', '/Type1', '/MMType1', '/TrueType', '/Type3'][p_partkey % 5 + 1] AS subtype, p_size % 3 <> 0 AS embedded, p_size % 4 <> 1 AS has_map,
    p_size % 5 = 0 AS blocked, greatest(p_partkey % 7 - 4, 0) AS invalid, greatest(p_size % 11 - 6, 0) AS missing, greatest(p_size % 11 - 8, 0) AS unresolved, p_partkey % 3 = 1 AS support, p_partkey % 2 = 0 AS program FROM part)"""


@query("g36_font_profiles", f"""WITH {_FONTS}, i AS (SELECT *, list_filter([CASE WHEN NOT embedded THEN 'unembedded' END, CASE WHEN NOT embedded AND support AND NOT program THEN 'local_font_program_missing' WHEN NOT embedded AND NOT support THEN 'local_embed_unsupported' END,
    CASE WHEN NOT has_map THEN 'missing_tounicode' END, CASE WHEN invalid > 0 THEN 'invalid_tounicode' END, CASE WHEN missing > 0 THEN 'missing_used_codes' END, CASE WHEN unresolved > 0 THEN 'unresolved_used_codes' END, CASE WHEN blocked THEN 'blocked_auto_unicode' END], lambda x: x IS NOT NULL) AS issues FROM fonts)
    SELECT doc, font, array_to_string(issues, ',') AS issues, (row_number() OVER (PARTITION BY doc ORDER BY len(issues) DESC, unresolved DESC, invalid DESC, missing DESC, lower(name), font))::INT AS rank FROM i QUALIFY rank <= 24""")
def g36_profiles(spark, folder):
    """The 24 worst of a document's fonts: the operator's own limit."""
    return O.font_profiles(fonts(spark, folder)).select("doc", "font", F.array_join("issues", ",").alias("issues"), "rank")


@query("g36_font_summary", with_frames("violations", f""", {_FONTS}, n AS (SELECT doc, count(*) AS fonts_total, count(*) FILTER (subtype IN ('/Type1', '/MMType1', '/TrueType')) AS simple_fonts, count(*) FILTER (subtype = '/Type0') AS type0_fonts,
    count(*) FILTER (embedded) AS embedded_fonts, count(*) FILTER (NOT embedded) AS unembedded_fonts, count(*) FILTER (has_map) AS fonts_with_tounicode, count(*) FILTER (NOT has_map) AS fonts_missing_tounicode,
    count(*) FILTER (invalid > 0) AS fonts_with_invalid_tounicode, count(*) FILTER (missing > 0) AS fonts_with_missing_used_codes, count(*) FILTER (unresolved > 0) AS fonts_with_unresolved_used_codes, count(*) FILTER (blocked) AS blocked_auto_unicode_fonts,
    count(*) FILTER (NOT embedded AND support AND program) AS local_embed_candidate_count, count(*) FILTER (NOT embedded AND support AND NOT program) AS local_embed_missing_program_count, count(*) FILTER (NOT embedded AND NOT support) AS unsupported_unembedded_fonts FROM fonts GROUP BY doc),
    v AS (SELECT doc, bool_or(severity = 'error' AND rule_id = 'error') AS flag FROM violations GROUP BY doc)
    SELECT doc, coalesce(COLUMNS(n.* EXCLUDE (doc)), 0), coalesce(flag, false) AS invalid_unicode_rule_present FROM n FULL JOIN v USING (doc)"""))
def g36_summary(spark, folder):
    return O.font_summary(fonts(spark, folder), violations(spark, folder))
