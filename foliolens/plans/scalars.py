"""Queries of predicates, classification rules, text, numeric and nested functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.functions import geometry as G
from foliolens.functions import text as T
from foliolens.plans.registry import query
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames

# SQL of the text functions, written apart from the Column expressions.


def _c(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[ \t\n\v\f\r]+', ' ', 'g'))"


def _n(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _split(x: str) -> str:
    once = rf"regexp_replace({x}, '(\p{{L}})(\p{{Nd}})', '\1 \2', 'g')"
    return rf"regexp_replace({once}, '(\p{{Nd}})(\p{{L}})', '\1 \2', 'g')"


def _loose(x: str, by: str = " ") -> str:
    return rf"trim(regexp_replace(regexp_replace({_split(f'lower({_c(x)})')}, '[^\p{{L}}\p{{N}}_\s]', '{by}', 'g'), '\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"CASE WHEN {_c(x)} = '' THEN 0 ELSE len(string_split({_c(x)}, ' ')) END"


_TOC = r"(?i)((\.{2,}\s*|(\.\s*){2,})(\d+|[ivxlcdm]+)\s*$|\s+\d+\s*$)"


def _label(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({_c(x)}, '{_TOC}', ''), '[ .\t]+$', ''))"


def _section(x: str) -> str:
    appendix = rf"regexp_replace(lower(regexp_extract({_label(x)}, '(?i)^(appendix\s+[a-z0-9]+(\.\d+)*)\b', 1)), '\s+', ' ', 'g')"
    return rf"CASE WHEN {appendix} <> '' THEN {appendix} ELSE regexp_extract({_label(x)}, '^(\d+(\.\d+)*)\b', 1) END"


def _technical(x: str) -> str:
    c = _c(x)
    return (rf"({c} <> '' AND (starts_with(lower({c}), 'topmostsubform') OR regexp_matches(lower({c}), '\[0\]|\.page|\.subform|textfield') OR regexp_matches({c}, '[_\[\]]')"
            rf" OR (contains({c}, '.') AND NOT contains({c}, ' ')) OR regexp_matches({c}, '^[\p{{L}}\p{{N}}]*\p{{Nd}}[\p{{L}}\p{{N}}]*$')))")


def scalar(name: str, frame, keys: list[str], columns: Callable[[], dict[str, Column]], sql: dict[str, str], source: str, where: str | None = None) -> None:
    """Register a query that adds columns to a frame, and the same columns in SQL.

    Columns are made when the query runs: names and SQL can be read without a session.
    """
    body = f"SELECT {', '.join([*keys, *(f'{s} AS {k}' for k, s in sql.items())])} FROM {source}" + (f" WHERE {where}" if where else "")

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = frame(spark, folder)
        return (df.where(where) if where else df).select(*keys, *[x.alias(k) for k, x in columns().items()])

    query(name, with_frames(source, body) if source in S.SQL else body)(run)


def tbl(name: str):
    return lambda spark, folder: S.table(spark, folder, name)


c = F.col
# A label that exercises the contents rules: a section number, the name, dots and a page number.
_ENTRY = lambda: F.concat(c("p_partkey").cast("string"), F.lit("."), (c("p_size") % 7).cast("string"), F.lit(" "), c("p_name"),
                  F.when(c("p_partkey") % 3 == 0, F.lit(" ..... ")).when(c("p_partkey") % 3 == 1, F.lit("  ")).otherwise(F.lit("")),
                  F.when(c("p_partkey") % 3 == 2, F.lit("")).when(c("p_partkey") % 2 == 0, F.lit("xii")).otherwise(c("p_size").cast("string")))
_ENTRY_SQL = """(p_partkey::VARCHAR || '.' || (p_size % 7)::VARCHAR || ' ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ..... ' WHEN p_partkey % 3 = 1 THEN '  ' ELSE '' END
    || CASE WHEN p_partkey % 3 = 2 THEN '' WHEN p_partkey % 2 = 0 THEN 'xii' ELSE p_size::VARCHAR END)"""
_APPENDIX = lambda: F.when(c("p_partkey") % 5 == 0, F.concat(F.lit("Appendix  A."), c("p_size").cast("string"), F.lit(" "), c("p_name"))).otherwise(_ENTRY())
_APPENDIX_SQL = f"(CASE WHEN p_partkey % 5 = 0 THEN 'Appendix  A.' || p_size::VARCHAR || ' ' || p_name ELSE {_ENTRY_SQL} END)"

scalar("f1_normalize_text", tbl("documents"), ["doc_id"], lambda: {"normalized": T.normalized(c("text"))}, {"normalized": _n("text")}, "documents")
scalar("f2_dense_text", tbl("documents"), ["doc_id"], lambda: {"dense": T.dense(c("text"))}, {"dense": "regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g')"}, "documents")
scalar("f3_visible_text", tbl("documents"), ["doc_id"], lambda: {"visible": T.collapsed(c("text"))}, {"visible": _c("text")}, "documents")
scalar("f5_split_alpha_digit", tbl("part"), ["p_partkey"], lambda: {"split": T.split_alpha_digit(F.concat(c("p_brand"), c("p_type"), c("p_size").cast("string"), c("p_name")))}, {"split": _split("p_brand || p_type || p_size::VARCHAR || p_name")}, "part")
scalar("f6_loose_text", tbl("documents"), ["doc_id"], lambda: {"loose": T.loose(c("text"))}, {"loose": _loose("text")}, "documents")
scalar("f7_title_text", tbl("documents"), ["doc_id"], lambda: {"title": T.title_key(c("text"))}, {"title": _loose("text", "")}, "documents")
scalar("f8_matches_text", tbl("part"), ["p_partkey"], lambda: {"contains_type": T.matches_text(F.concat(c("p_type"), F.lit(" "), c("p_name")), F.concat(F.lit("small "), F.lit("ring")), False), "equals_name": T.matches_text(c("p_name"), F.lit("Small  RING"), True)}, {"contains_type": f"({_n(chr(39) + chr(39) + ' || p_type || chr(32) || p_name')} <> '' AND contains({_n('p_type || chr(32) || p_name')}, 'small ring'))", "equals_name": f"({_n('p_name')} = 'small ring')"}, "part")
scalar("f9_ordered_terms", tbl("documents"), ["doc_id"], lambda: {"ordered": T.matches_ordered_terms(c("text"), F.lit("the of in"))}, {"ordered": f"(len(string_split({_loose('text')}, ' ')) > 0 AND regexp_matches({_loose('text')}, '(^| )the( .*)? of( .*)? in( |$)'))"}, "documents")
scalar("f10_contiguous_terms", tbl("documents"), ["doc_id"], lambda: {"contiguous": T.matches_contiguous_terms(c("text"), F.lit("of the"))}, {"contiguous": f"({_loose('text')} <> '' AND contains(' ' || {_loose('text')} || ' ', ' of the '))"}, "documents")
scalar("f13_primary_subtag", tbl("documents"), ["doc_id"], lambda: {"primary_tag": T.primary_subtag(F.concat(F.upper("lang"), F.lit("-XX")))}, {"primary_tag": "string_split(lower(upper(lang) || '-XX'), '-')[1]"}, "documents")
scalar("f14_language_match", tbl("documents"), ["doc_id"], lambda: {"same": (T.primary_subtag(c("lang")) != "") & (T.primary_subtag(c("lang")) == T.primary_subtag(F.lit("EN-us")))}, {"same": "(string_split(lower(lang), '-')[1] = 'en')"}, "documents")
_OCR = {"en": "eng", "es": "spa", "fr": "fra", "de": "deu"}  # Fixed values: language tags and an OCR engine's codes.
scalar("f16_ocr_language", tbl("documents"), ["doc_id"], lambda: {"code": F.coalesce(F.create_map(*[F.lit(x) for kv in _OCR.items() for x in kv])[T.primary_subtag(c("lang"))], F.lit("eng"))}, {"code": "CASE lang WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' ELSE 'eng' END"}, "documents")
_is_toc_sql = rf"(length({_c(_ENTRY_SQL)}) >= 4 AND regexp_matches({_c(_ENTRY_SQL)}, '[A-Za-z]') AND regexp_matches({_c(_ENTRY_SQL)}, '{_TOC}') AND regexp_replace(regexp_replace({_c(_ENTRY_SQL)}, '{_TOC}', ''), '[ .\t]+$', '') <> '')"
scalar("f18_toc_entry", tbl("part"), ["p_partkey"], lambda: {"entry": _ENTRY(), "is_entry": T.is_toc_entry(_ENTRY())}, {"entry": _ENTRY_SQL, "is_entry": _is_toc_sql}, "part")
scalar("f20_toc_group_heading", tbl("part"), ["p_partkey"], lambda: {"is_heading": ~T.is_toc_entry(_ENTRY()) & (F.length(T.collapsed(_ENTRY())) <= 80) & T.word_count(_ENTRY()).between(1, 4) & F.rlike(T.collapsed(_ENTRY()), F.lit("[A-Za-z]")) & ~F.lower(T.collapsed(_ENTRY())).isin("page", "lists")}, {"is_heading": f"(NOT {_is_toc_sql} AND length({_c(_ENTRY_SQL)}) <= 80 AND {_words(_ENTRY_SQL)} BETWEEN 1 AND 4 AND regexp_matches({_c(_ENTRY_SQL)}, '[A-Za-z]'))"}, "part")
scalar("f21_toc_section", tbl("part"), ["p_partkey"], lambda: {"is_section": F.rlike(T.collapsed(_APPENDIX()), F.lit(r"(?i)^(?:appendix\s+[a-z0-9]+|\d+(?:\.\d+)*)\b"))}, {"is_section": rf"regexp_matches({_c(_APPENDIX_SQL)}, '(?i)^(appendix\s+[a-z0-9]+|\d+(\.\d+)*)\b')"}, "part")
scalar("f23_title_fingerprint", tbl("customer"), ["c_custkey"], lambda: {"fingerprint": T.fingerprint(c("c_name"))}, {"fingerprint": "lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '', 'g'))"}, "customer")
scalar("f25_bookmark_label", tbl("part"), ["p_partkey"], lambda: {"label": T.bookmark_label(_ENTRY())}, {"label": _label(_ENTRY_SQL)}, "part")
scalar("f26_section_key", tbl("part"), ["p_partkey"], lambda: {"section": T.section_key(_APPENDIX())}, {"section": _section(_APPENDIX_SQL)}, "part")
scalar("f27_parent_section_key", tbl("part"), ["p_partkey"], lambda: {"parent": T.parent_section_key(_APPENDIX())}, {"parent": rf"regexp_replace({_section(_APPENDIX_SQL)}, '\.[^. ]*$', '')"}, "part")
_title_like_sql = rf"trim(regexp_replace(regexp_replace(lower({_c('p_name || chr(33)')}), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))"
scalar("f28_merge_key", tbl("part"), ["p_partkey"], lambda: {"merge_key": T.merge_key(F.when(c("p_partkey") % 2 == 0, _APPENDIX()).otherwise(F.concat(c("p_name"), F.lit("!"))))}, {"merge_key": f"CASE WHEN p_partkey % 2 = 0 THEN 'section:' || {_section(_APPENDIX_SQL)} ELSE 'text:' || {_title_like_sql} END"}, "part")
scalar("f29_title_like", tbl("part"), ["p_partkey"], lambda: {"title": T.title_like(F.concat(c("p_name"), F.lit("!")))}, {"title": _title_like_sql}, "part")
scalar("f35_table_summary", tbl("part"), ["p_partkey"], lambda: {"summary": F.concat(F.lit("Table with "), c("p_size").cast("string"), F.when(c("p_size") == 1, " row").otherwise(" rows"), F.lit(" and "), (c("p_partkey") % 3 + 1).cast("string"), F.when(c("p_partkey") % 3 == 0, " column. ").otherwise(" columns. "), T.collapsed(c("p_name")))}, {"summary": "printf('Table with %d %s and %d %s %s', p_size, CASE WHEN p_size = 1 THEN 'row' ELSE 'rows' END, p_partkey % 3 + 1, CASE WHEN p_partkey % 3 = 0 THEN 'column.' ELSE 'columns.' END, p_name)"}, "part")
scalar("f36_accessible_text", tbl("conversations"), ["conv_id", "turn"], lambda: {"accessible": F.trim(F.coalesce(F.nullif(F.when(c("role") == "system", "").otherwise(c("text")), F.lit("")), F.nullif(c("role"), F.lit("")), F.lit("")))}, {"accessible": "CASE WHEN role = 'system' OR text = '' THEN role ELSE trim(text) END"}, "conversations")
scalar("f37_join_messages", tbl("part"), ["p_partkey"], lambda: {"message": F.concat_ws(" | ", F.when(c("p_size") > 20, c("p_brand")), F.when(c("p_size") < 40, c("p_type")))}, {"message": "concat_ws(' | ', CASE WHEN p_size > 20 THEN p_brand END, CASE WHEN p_size < 40 THEN p_type END)"}, "part")
scalar("f38_font_name", tbl("part"), ["p_partkey"], lambda: {"font": T.font_name(F.concat(F.lit("ABCDEF+"), c("p_brand")))}, {"font": "lower(regexp_replace(regexp_replace('ABCDEF+' || p_brand, '^[A-Z]{6}\\+', ''), '[^A-Za-z0-9]+', '', 'g'))"}, "part")
scalar("f39_valid_unicode", tbl("documents"), ["doc_id"], lambda: {"valid": (T.text_of(c("text")) != "") & ~F.rlike("text", F.lit("[\\x00\\uFFFE\\uFEFF]"))}, {"valid": "(coalesce(text, '') <> '' AND NOT contains(text, chr(65279)) AND NOT contains(text, chr(65534)))"}, "documents")
scalar("f41_strip_line_numbers", tbl("part"), ["p_partkey"], lambda: {"code": T.code_without_line_numbers(F.concat(c("p_size").cast("string"), F.lit(": "), c("p_name"), F.lit("\n 7| "), c("p_type")))}, {"code": "p_name || chr(10) || p_type"}, "part")
scalar("f43_word_count", tbl("documents"), ["doc_id"], lambda: {"words": T.word_count(c("text"))}, {"words": f"({_words('text')})::INT"}, "documents")
scalar("u3_strip_subset_prefix", tbl("part"), ["p_partkey"], lambda: {"font": F.regexp_replace(F.concat(F.when(c("p_size") % 2 == 0, "ABCDEF+").otherwise("abc+"), c("p_brand")), r"^[A-Z]{6}\+", "")}, {"font": "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'abc+' || p_brand END"}, "part")

# Predicates and rules.
scalar("p1_parse_json", tbl("events"), ["event_id"], lambda: {"k": F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))}, {"k": "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0)"}, "events")
_RANK = lambda: F.coalesce(F.create_map(*[F.lit(x) for x in ("high", 3, "medium", 2, "low", 1)])[c("severity")], F.lit(0))
_RANK_SQL = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
scalar("p4_severity_rank", S.review_tasks, ["task_id"], lambda: {"severity_rank": _RANK()}, {"severity_rank": _RANK_SQL}, "review_tasks")
_BLANK_BRAND = lambda: F.when(c("p_size") % 9 == 0, F.lit(" ")).otherwise(c("p_brand"))
scalar("p6_rule_key", tbl("part"), ["p_partkey"], lambda: {"rule_key": F.when((F.trim(_BLANK_BRAND()) != "") & (F.trim("p_type") != ""), F.concat_ws("-", F.trim(_BLANK_BRAND()), F.trim("p_type"))).otherwise("")}, {"rule_key": "CASE WHEN p_size % 9 = 0 THEN '' ELSE p_brand || '-' || p_type END"}, "part")
scalar("p7_rule_id", tbl("part"), ["p_partkey"], lambda: {"rule_id": F.when(F.trim(_BLANK_BRAND()) != "", F.concat_ws("-", F.lit("S"), F.trim(_BLANK_BRAND()), c("p_size").cast("string"))).otherwise("")}, {"rule_id": "CASE WHEN p_size % 9 = 0 THEN '' ELSE 'S-' || p_brand || '-' || p_size::VARCHAR END"}, "part")
_text_ratio = lambda: (c("p_size") / 50.0)
scalar("p8_classify", tbl("part"), ["p_partkey"], lambda: {"kind": F.when(_text_ratio() < 0.1, "scanned").when((c("p_type") == "ECONOMY") & (_text_ratio() >= 0.9) & (c("p_partkey") % 4 > 2), "ocr_scan").when(_text_ratio() > 0.9, "digital").otherwise("mixed")}, {"kind": "CASE WHEN p_size / 50.0 < 0.1 THEN 'scanned' WHEN p_type = 'ECONOMY' AND p_size / 50.0 >= 0.9 AND p_partkey % 4 > 2 THEN 'ocr_scan' WHEN p_size / 50.0 > 0.9 THEN 'digital' ELSE 'mixed' END"}, "part")
scalar("p11_preflight", tbl("documents"), ["doc_id"], lambda: {"reasons": F.array_join(F.filter(F.array(F.when(c("n_chars") > 5000, F.concat(c("n_chars").cast("string"), F.lit(" characters exceeds the limit"))), F.when(F.size(F.split("text", "\n")) > 20, F.lit("too many lines"))), lambda x: x.isNotNull()), "; ")}, {"reasons": "concat_ws('; ', CASE WHEN n_chars > 5000 THEN n_chars::VARCHAR || ' characters exceeds the limit' END, CASE WHEN len(string_split(text, chr(10))) > 20 THEN 'too many lines' END)"}, "documents", "n_chars > 5000 OR length(text) - length(replace(text, '\n', '')) > 19")
_POOR_SQL = "(lower(trim(contents)) IN (" + ", ".join(f"'{x}'" for x in T.POOR_LINK_LABELS) + r") OR regexp_matches(lower(trim(contents)), '^https?://\S+$|^.{0,1}$|^[\d\s]+$|^link\s*to\s+https?://'))"
scalar("p18_poor_link_text", S.page_links, ["page", "pos"], lambda: {"poor": T.is_poor_link_text(c("contents"))}, {"poor": _POOR_SQL}, "page_links")
scalar("p19_implausible_link_text", tbl("conversations"), ["conv_id", "turn"], lambda: {"implausible": T.is_implausible_link_text(c("text"))}, {"implausible": rf"({_c('text')} <> '' AND (length({_c('text')}) > 160 OR {_words('text')} > 18 OR regexp_matches({_c('text')}, '[.!?]\s+[A-Z]')))"}, "conversations")
scalar("p20_generated_link", S.page_links, ["page", "pos"], lambda: {"generated": T.is_generated_link(F.when(c("pos") % 2 == 0, F.concat(F.lit("Link to "), c("uri"))).otherwise(c("contents")), c("uri"))}, {"generated": r"(CASE WHEN pos % 2 = 0 THEN uri <> '' ELSE lower(contents) = 'link' OR lower(contents) = 'link to ' || lower(uri) OR regexp_matches(lower(contents), '^(jump|go)\s+to\s+(destination|bibitem|cite|section|subsection|appendix|figure|table|equation|eqn|footnote|endnote|page)\b') END)"}, "page_links")
scalar("p21_technical_name", tbl("customer"), ["c_custkey"], lambda: {"technical": T.is_technical_name(F.when(c("c_custkey") % 2 == 0, F.regexp_replace("c_name", "#", "")).otherwise(c("c_mktsegment")))}, {"technical": _technical("(CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', '') ELSE c_mktsegment END)")}, "customer")
scalar("p22_label_quality", tbl("customer"), ["c_custkey"], lambda: {"quality": T.label_quality(F.when(c("c_custkey") % 3 == 0, F.lit("")).when(c("c_custkey") % 3 == 1, F.lit("f_1")).otherwise(c("c_mktsegment")), c("c_name"))}, {"quality": "CASE c_custkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'weak' ELSE 'good' END"}, "customer")
_flags = lambda: c("p_partkey") * 8192
scalar("p23_field_type", tbl("part"), ["p_partkey"], lambda: {"field_type": F.when(c("p_size") % 4 == 0, "text").when(c("p_size") % 4 == 1, F.when(_flags().bitwiseAND(1 << 16) != 0, "push_button").when(_flags().bitwiseAND(1 << 15) != 0, "radio_button").otherwise("checkbox"))
    .when(c("p_size") % 4 == 2, F.when(_flags().bitwiseAND(1 << 17) != 0, "combo_box").otherwise("list_box")).otherwise("signature")}, {"field_type": "CASE p_size % 4 WHEN 0 THEN 'text' WHEN 1 THEN CASE WHEN (p_partkey * 8192) & 65536 <> 0 THEN 'push_button' WHEN (p_partkey * 8192) & 32768 <> 0 THEN 'radio_button' ELSE 'checkbox' END WHEN 2 THEN CASE WHEN (p_partkey * 8192) & 131072 <> 0 THEN 'combo_box' ELSE 'list_box' END ELSE 'signature' END"}, "part")
_act = lambda: F.element_at(F.array(*map(F.lit, ["reclassify_region", "manual_only", "set_alt_text", "mark_decorative"])), (c("p_partkey") % 4 + 1).cast("int"))
_conf = lambda: F.element_at(F.array(*map(F.lit, ["high", "medium", "low"])), (c("p_size") % 3 + 1).cast("int"))
_P24 = "CASE WHEN p_partkey % 4 = 0 THEN 'false/high' WHEN p_partkey % 4 = 1 THEN 'true/high' WHEN p_partkey % 4 = 3 THEN (CASE WHEN p_size % 3 <> 0 THEN 'true/medium' ELSE 'false/medium' END) WHEN p_size % 3 <> 0 THEN 'true/medium' ELSE 'false/low' END"
scalar("p24_reviewability", tbl("part"), ["p_partkey"], lambda: {"verdict": F.when(_act() == "reclassify_region", "false/high").when(_act() == "manual_only", "true/high").when(_act() == "mark_decorative", F.when(_conf() != "high", "true/medium").otherwise("false/medium")).when(_conf() != "high", "true/medium").otherwise("false/low")}, {"verdict": _P24}, "part")
scalar("p25_visible_tasks", S.review_tasks, ["task_id", "task_type"], lambda: {"severity": c("severity")}, {"severity": "severity"}, "review_tasks", "task_type IN ('alt_text', 'annotation_description', 'content_fidelity', 'table_semantics')")
scalar("p28_removable_widgets", tbl("part"), ["p_partkey"], lambda: {"removable": (_conf() == "high") & (_act() == "set_alt_text") & (F.trim("p_name") != "")}, {"removable": "(p_size % 3 = 0 AND p_partkey % 4 = 2 AND trim(p_name) <> '')"}, "part")
_reasons = lambda: F.filter(F.array(F.when(c("p_size") > 10, F.lit("large table matrix")), F.when(c("p_size") > 30, F.lit("very dense table")), F.when(c("p_partkey") % 5 == 0, F.lit("weak header signal"))), lambda x: x.isNotNull())
scalar("p29_retry_tables", tbl("part"), ["p_partkey"], lambda: {"retry": (F.size(_reasons()) > 0) & (F.size(F.array_except(_reasons(), F.array(*map(F.lit, ["merged cells or spans present", "large table matrix", "very dense table", "multi-level header pattern"])))) == 0)}, {"retry": "(p_size > 10 AND p_partkey % 5 <> 0)"}, "part")
scalar("p31_suspicious_widgets", tbl("part"), ["p_partkey"], lambda: {"p_name2": c("p_name")}, {"p_name2": "p_name"}, "part", "1 = 0")
scalar("p37_fragmentary", tbl("conversations"), ["conv_id", "turn"], lambda: {"fragmentary": T.is_fragmentary(c("text"))}, {"fragmentary": rf"({_c('text')} = '' OR length({_c('text')}) <= 42 OR length(regexp_replace({_c('text')}, '[^A-Za-z]+', '', 'g')) < 12 OR ({_words('text')} <= 8 AND length(regexp_replace({_c('text')}, '[^0-9]+', '', 'g')) >= greatest(length(regexp_replace({_c('text')}, '[^A-Za-z]+', '', 'g')), 1)))"}, "conversations")
scalar("p46_confidence_score", tbl("part"), ["p_partkey"], lambda: {"score": F.coalesce(F.create_map(*[F.lit(x) for kv in (("high", 0.9), ("medium", 0.7), ("low", 0.4)) for x in kv])[F.when(c("p_size") % 4 < 3, F.lower(F.upper(_conf())))], F.lit(0.5))}, {"score": "CASE WHEN p_size % 4 = 3 THEN 0.5::DOUBLE WHEN p_size % 3 = 0 THEN 0.9::DOUBLE WHEN p_size % 3 = 1 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END"}, "part")
scalar("p47_confidence_label", tbl("part"), ["p_partkey"], lambda: {"label": F.when(F.lower("p_type").isin("high", "medium", "low"), F.lower("p_type")).otherwise("low")}, {"label": "CASE WHEN lower(p_type) IN ('high', 'medium', 'low') THEN lower(p_type) ELSE 'low' END"}, "part")
_SUB = ["/Highlight", "/StrikeOut", "/Underline", "/Squiggly", "/Text", "/FreeText", "/FileAttachment", "/Stamp", "/Caret", "/Ink", "/Polygon"]
_SUBTEXT = ["Highlighted text", "Strikethrough text", "Underlined text", "Squiggly-underlined text", "Text note", "Free text annotation", "File attachment", "Stamp annotation", "Insertion mark", "Freehand drawing"]
_sub = lambda: F.element_at(F.array(*map(F.lit, _SUB)), (c("p_partkey") % 11 + 1).cast("int"))
scalar("p49_annotation_contents", tbl("part"), ["p_partkey"], lambda: {"contents": F.coalesce(F.create_map(*[F.lit(x) for kv in zip(_SUB, _SUBTEXT, strict=False) for x in kv])[_sub()], F.concat(F.substring(_sub(), 2, 99), F.lit(" annotation")))}, {"contents": "coalesce([" + ", ".join(f"'{x}'" for x in _SUBTEXT) + "][(p_partkey % 11 + 1)::INT], 'Polygon annotation')"}, "part")
_MARK = ["1.", "(iv)", "IX.", "b)", "C.", "-", "•", "◦", "▪", "§"]
_MARKS = ["Decimal", "LowerRoman", "UpperRoman", "LowerAlpha", "UpperRoman", "Disc", "Disc", "Circle", "Square", None]
scalar("p51_list_numbering", tbl("part"), ["p_partkey"], lambda: {"numbering": T.list_numbering(F.element_at(F.array(*map(F.lit, _MARK)), (c("p_partkey") % 10 + 1).cast("int")))}, {"numbering": "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in _MARKS) + "][(p_partkey % 10 + 1)::INT]"}, "part")
scalar("p52_weak_alt", tbl("part"), ["p_partkey"], lambda: {"weak": T.is_weak_alt(F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("Figure  "), c("p_size").cast("string"))).when(c("p_partkey") % 3 == 1, F.concat(F.lit("["), c("p_name"), F.lit("]"))).otherwise(c("p_name")))}, {"weak": "(p_partkey % 3 <> 2)"}, "part")
scalar("p54_overlay_font", tbl("part"), ["p_partkey"], lambda: {"overlay": F.rlike(T.font_name(F.concat(c("p_brand"), F.when(c("p_size") % 5 == 0, "-Glyph Less").otherwise("-Sans"))), F.lit("ocr|glyphless|hidden"))}, {"overlay": "(p_size % 5 = 0)"}, "part")
scalar("s3_skip_path", tbl("pages"), ["page_id"], lambda: {"skip": F.exists(F.split(F.lower("url"), "/"), lambda x: x.isin(".git", "node_modules", "fr")) | F.element_at(F.split("url", "/"), -1).startswith("accessible_") | F.rlike("url", F.lit(r"(_tagged|\.repaired)\.pdf$"))}, {"skip": "(list_has_any(string_split(lower(url), '/'), ['.git', 'node_modules', 'fr']) OR starts_with(string_split(url, '/')[-1], 'accessible_') OR regexp_matches(url, '(_tagged|\\.repaired)\\.pdf$'))"}, "pages")
scalar("s16_source_features", tbl("pages"), ["page_id"], lambda: {"links": F.regexp_count("html", F.lit("<a href=")), "has_forms": F.contains(c("html"), F.lit("<form"))}, {"links": "len(regexp_extract_all(html, '<a href='))::INT", "has_forms": "contains(html, '<form')"}, "pages")
scalar("s19_link_entries", S.page_links, ["page", "pos", "uri", "contents"], lambda: {"descriptive": (F.trim("contents") != "") & ~T.is_poor_link_text(c("contents"))}, {"descriptive": f"(trim(contents) <> '' AND NOT {_POOR_SQL})"}, "page_links")
scalar("s21_first_lines", tbl("documents"), ["doc_id"], lambda: {"lines": F.array_join(F.slice(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 5), "|")}, {"lines": "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:5], '|')"}, "documents")
scalar("s22_text_sample", tbl("documents"), ["doc_id"], lambda: {"sample": F.substring(T.normalized(c("text")), 1, 20000)}, {"sample": f"substring({_n('text')}, 1, 20000)"}, "documents")
scalar("x20_retry_delay", tbl("part"), ["p_partkey"], lambda: {"delay": F.least(F.coalesce(F.when(c("p_partkey") % 3 == 0, c("p_size").cast("double")), F.pow(F.lit(2.0), F.greatest(c("p_size") - 1, F.lit(0)))), F.lit(30.0))}, {"delay": "least(coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END, pow(2.0::DOUBLE, greatest(p_size - 1, 0))), 30.0::DOUBLE)"}, "part")

# Geometry of a box and the same box moved.
_a = lambda: G.box()
_b = lambda: {"l": c("l") + 7.0, "b": c("b") - 3.0, "r": c("r") + 11.0, "t": c("t") + 2.0}
_IX = "(greatest(0.0, least(r, r + 11) - greatest(l, l + 7)) * greatest(0.0, least(t, t + 2) - greatest(b, b - 3)))"
_AR, _BR = "(greatest(0.0, r - l) * greatest(0.0, t - b))", "(greatest(0.0, (r + 11) - (l + 7)) * greatest(0.0, (t + 2) - (b - 3)))"
_r6 = lambda x: F.round(x, 6)
scalar("x5_iou", S.boxes, ["box"], lambda: {"iou": _r6(G.iou(_a(), _b()))}, {"iou": f"round({_IX} / ({_AR} + {_BR} - {_IX}), 6)"}, "boxes")
scalar("x6_intersection", S.boxes, ["box"], lambda: {"both": _r6(G.intersection(_a(), _b()))}, {"both": f"round({_IX}, 6)"}, "boxes")
scalar("x7_containment", S.boxes, ["box"], lambda: {"contained": _r6(G.containment(_a(), _b()))}, {"contained": f"round({_IX} / {_AR}, 6)"}, "boxes")
scalar("x8_area", S.boxes, ["box"], lambda: {"area": _r6(G.area(_a()))}, {"area": f"round({_AR}, 6)"}, "boxes")
scalar("x9_expand", S.boxes, ["box"], lambda: {"l": G.expanded(_a(), 6.0)["l"], "b": G.expanded(_a(), 6.0)["b"], "r": G.expanded(_a(), 6.0)["r"], "t": G.expanded(_a(), 6.0)["t"]}, {"l": "l - 6.0", "b": "b - 6.0", "r": "r + 6.0", "t": "t + 6.0"}, "boxes")
scalar("x10_distance_score", S.boxes, ["box"], lambda: {"score": _r6(G.distance_score(_a(), _b()))}, {"score": "round(greatest(0.0, 1.0 - sqrt(9.0 * 9.0 + 0.5 * 0.5) / greatest(2 * sqrt((r - l + 4) * (r - l + 4) + (t - b + 5) * (t - b + 5)), 1.0)), 6)"}, "boxes")
_m = lambda: G.affine_product([F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(3.0), c("l"), c("b")], [F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(5.0), F.lit(6.0)])
scalar("x12_affine", S.boxes, ["box"], lambda: {"x": _r6(G.affine_point(_m(), c("r"), c("t"))[0]), "y": _r6(G.affine_point(_m(), c("r"), c("t"))[1])}, {"x": "round(2 * r + l + 5, 6)", "y": "round(2 * r + 3 * t + l + b + 6, 6)"}, "boxes")
scalar("x14_box_of_points", S.boxes, ["box"], lambda: {"low": F.array_min(F.array("l", "b", "r")), "high": F.array_max(F.array("l", "b", "r"))}, {"low": "least(l, b, r)", "high": "greatest(l, b, r)"}, "boxes")

# Nested values.
_ARR = lambda: F.sequence(F.lit(0), c("p_size"))
scalar("n13_header_rows", tbl("part"), ["p_partkey"], lambda: {"rows": F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(c("p_size") - 5, c("p_size") % 3, c("p_size") % 2, F.lit(-1)), lambda x: x >= 0))), ",")}, {"rows": "array_to_string(list_sort(list_distinct(list_filter([p_size - 5, p_size % 3, p_size % 2, -1], lambda x: x >= 0))), ',')"}, "part")
scalar("n14_chunks", tbl("part"), ["p_partkey"], lambda: {"chunks": F.array_join(F.transform(F.sequence(F.lit(1), F.size(_ARR()), F.lit(18)), lambda i: F.array_join(F.slice(_ARR(), i, 18), ",")), ";")}, {"chunks": "array_to_string(list_transform(range(0, p_size + 1, 18), lambda i: array_to_string(list_transform(range(i, least(i + 18, p_size + 1)), lambda v: v::VARCHAR), ',')), ';')"}, "part")
scalar("n16_compact_map", tbl("part"), ["p_partkey"], lambda: {"kept": F.array_join(F.array_sort(F.map_keys(F.map_filter(F.create_map(F.lit("brand"), F.when(c("p_size") > 25, c("p_brand")).otherwise(""), F.lit("name"), c("p_name")), lambda k, v: v.isNotNull() & (v != "")))), ",")}, {"kept": "CASE WHEN p_size > 25 THEN 'brand,name' ELSE 'name' END"}, "part")
scalar("n10_parse_or_empty", tbl("events"), ["event_id"], lambda: {"keys": F.coalesce(F.array_join(F.array_sort(F.json_object_keys("props")), ","), F.lit(""))}, {"keys": "array_to_string(list_sort(json_keys(props)), ',')"}, "events")
scalar("u4_merge_maps", tbl("part"), ["p_partkey"], lambda: {"merged": F.size(F.map_from_entries(F.array_distinct(F.array(F.struct(F.lit("a"), F.lit(1)), F.struct(F.lit("b"), F.lit(2)))))), "overwritten": F.size(F.array_intersect(F.array(c("p_size") % 2, F.lit(5)), F.array(c("p_partkey") % 2, F.lit(6))))}, {"merged": "2", "overwritten": "CASE WHEN p_size % 2 = p_partkey % 2 THEN 1 ELSE 0 END"}, "part")
scalar("u5_code_sets", tbl("part"), ["p_partkey"], lambda: {"repairable": F.size(F.array_intersect(_ARR(), F.sequence(F.lit(0), F.lit(20)))), "unresolved": F.size(F.array_except(_ARR(), F.sequence(F.lit(0), F.lit(20))))}, {"repairable": "least(p_size, 20) + 1", "unresolved": "greatest(p_size - 20, 0)"}, "part")
