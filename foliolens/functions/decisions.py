"""Verdicts of a describing service, read from JSON to one row of fixed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXTS = ["chosen_source", "resolved_text", "issue_type", "accessible_label", "alt_text", "resolved_kind", "caption_text_override"]
_INDICES = ["header_rows", "row_header_columns", "entry_indexes"]
_FLAGS = ["should_block_accessibility", "is_decorative", "is_toc"]
_MAPS = ["entry_types", "entry_text_overrides"]
_SCHEMA = ", ".join(
    [f"{n} string" for n in ("summary", "confidence", "suggested_action", "reason", *_TEXTS)]
    + [f"{n} array<string>" for n in _INDICES] + [f"{n} boolean" for n in _FLAGS] + [f"{n} map<string,string>" for n in _MAPS])


def decision(unit_id: Column, unit_type: Column, verdict: Column) -> Column:
    """A struct of 22 fields; what the JSON lacks, or all of it if it can't be read, has its default.

    Indices are the distinct whole numbers from 0 on, in order; entries of maps with a blank
    key or value are left out.
    """
    v = F.from_json(verdict, _SCHEMA)
    text = lambda n: F.trim(F.coalesce(v[n], F.lit("")))
    label = F.lower(text("confidence"))
    known = label.isin("high", "medium", "low")
    score = F.when(label == "high", 0.9).when(label == "medium", 0.7).when(label == "low", 0.4).otherwise(0.5)
    numbers = lambda n: F.array_sort(F.array_distinct(F.transform(
        F.filter(F.coalesce(v[n], F.expr("cast(array() as array<string>)")), lambda x: F.rlike(x, F.lit(r"^\d{1,9}$"))), lambda x: x.cast("int"))))
    entries = lambda n: F.map_entries(F.coalesce(v[n], F.expr("cast(map() as map<string,string>)")))

    def mapped(name: str, collapse: bool) -> Column:
        tidy = (lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))) if collapse else F.trim
        pairs = F.transform(F.filter(entries(name), lambda e: e["value"].isNotNull()), lambda e: F.struct(F.trim(e["key"]).alias("key"), tidy(e["value"]).alias("value")))
        return F.map_from_entries(F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != "")))

    return F.struct(
        unit_id.alias("unit_id"), unit_type.alias("unit_type"), text("summary").alias("summary"),
        F.when(known, label).otherwise("low").alias("confidence"), score.alias("confidence_score"),
        F.coalesce(F.nullif(text("suggested_action"), F.lit("")), F.lit("manual_only")).alias("suggested_action"), text("reason").alias("reason"),
        *[F.nullif(text(n), F.lit("")).alias(n) for n in _TEXTS], *[numbers(n).alias(n) for n in _INDICES],
        *[F.coalesce(v[n], F.lit(False)).alias(n) for n in _FLAGS], mapped("entry_types", False).alias("entry_types"), mapped("entry_text_overrides", True).alias("entry_text_overrides"))
