"""Rules over violations: what kind of task one asks for, and the guidance of known rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Clause and test number, the rule's category, how to mend it.
GUIDANCE = (
    ("7.4.2-1", "headings", "Ensure the first heading is H1 and heading levels do not skip."),
    ("7.5-1", "tables", "Set TH scope (Row/Column) or provide explicit Headers/IDs relationships."),
    ("7.18.1-1", "annotations", "Add /Contents or equivalent alternate text for non-widget annotations."),
    ("7.18.1-2", "annotations", "Add /Contents or alternate text for visible annotations inside crop box."),
    ("7.18.3-1", "annotations", "Set page /Tabs to /S when annotations are present."),
    ("7.18.4-1", "forms", "Nest widget annotations under /Form structure elements via OBJR."),
    ("7.18.5-1", "links", "Tag link annotations as /Link elements and connect via ParentTree."),
    ("7.18.5-2", "links", "Provide descriptive /Contents for link annotations."),
    ("5-1", "metadata", "Set PDF/UA identification metadata (pdfuaid:part) in valid XMP."),
    ("7.21.4.1-1", "fonts", "Embed all fonts used by the document."),
    ("7.21.4.2-2", "fonts", "Ensure CIDSet covers all CIDs present in embedded CID fonts."),
    ("7.21.7-1", "fonts", "Ensure fonts map used character codes to Unicode via ToUnicode or equivalent."),
    ("7.21.7-2", "fonts", "Ensure every ToUnicode CMap mapping resolves to a valid Unicode value (not 0, U+FEFF, or U+FFFE)."),
    ("7.21.8-1", "fonts", "Eliminate .notdef glyph references in text-showing operators by fixing font subsets/encoding."),
    ("7.21.3.2-1", "fonts", "Provide CIDToGIDMap for Type 2 CIDFonts (or Identity where applicable)."),
)
# Words of a description that point at tables.
TABLE_WORDS = ("table", "thead", "tbody", "tfoot", "tr", "th", "td")
#: Marks of a font rule and of a figure rule in a rule id, and the rule on form field labels.
FONT_MARK, FIGURE_START, FORM_RULE = "-7.21.", "ISO 14289-1:2014-7.3-", "ISO 14289-1:2014-7.18.1-3"


def guidance(spark: SparkSession) -> DataFrame:
    """(rule_key, category, fix_hint) of the known rules: a fixed list, small enough to broadcast always."""
    return F.broadcast(spark.createDataFrame(list(GUIDANCE), "rule_key string, category string, fix_hint string"))


def task_type(rule_id: Column, category: Column, description: Column) -> Column:
    """The kind of review task a violation asks for; the first rule that holds decides, nulls count as empty."""
    rule, kind, text = F.coalesce(rule_id, F.lit("")), F.lower(F.trim(F.coalesce(category, F.lit("")))), F.lower(F.coalesce(description, F.lit("")))
    says = lambda *words: F.rlike(text, F.lit("|".join(words)))
    return (
        F.when((rule == FORM_RULE) | says("form field", "widget annotation"), "form_semantics")
        .when((kind == "fonts") | F.contains(rule, F.lit(FONT_MARK)), "font_text_fidelity")
        .when((kind == "figures") | rule.startswith(FIGURE_START) | says("figure tag", "replacement text", "alternate text"), "alt_text")
        .when(kind.isin("annotations", "links"), "annotation_description")
        .when((kind == "tables") | says(*TABLE_WORDS), "table_semantics")
        .otherwise("reading_order")
    )
