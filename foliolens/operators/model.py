"""The pages of a document with their blocks, tables and fields, put together from its elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import text as T

c = F.col

# The type of a table, the type of elements without one, limits of texts.
TABLE, DEFAULT_ROLE = "table", "paragraph"
MOST_CHARS, MOST_CELL_CHARS = 240, 120


def _short(column: Column, most: int = MOST_CHARS) -> Column:
    return F.substring(T.collapsed(column), 1, most)


def _first_said(*columns: str) -> Column:
    """The first text that isn't empty, its blanks collapsed; null if that leaves nothing."""
    return F.nullif(_short(F.coalesce(*[F.nullif(c(k), F.lit("")) for k in columns])), F.lit(""))


def _listed(*columns: str | Column) -> Column:
    return F.array_sort(F.collect_list(F.struct(*columns)))


def document_pages(elements: DataFrame, cells: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc, page from 1, blocks, tables, fields): each list in order, empty where there is none.

    ``elements`` is (doc, pos, page from 0, review_id, type, text, resolved_text, actual_text,
    hint, level); those without a page or of a negative one are left out. An element without
    an id is named by its place. ``ord`` counts a page's blocks and tables together.
    ``cells`` is (doc, tbl, pos, row, col, text, is_header, column_header, row_header), where
    ``tbl`` is a table's id; ``fields`` (doc, page from 1, ord, field_id, kind, name, label,
    value) may be on pages without elements. Groups are a page or a table of one document.
    """
    yes = lambda name: F.coalesce(c(name), F.lit(False))
    role = F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit(DEFAULT_ROLE))
    named = F.coalesce(F.nullif(c("review_id"), F.lit("")), F.concat(F.lit("review-"), c("pos").cast("string")))
    rows = elements.where("page >= 0").select(
        "doc", (c("page") + 1).alias("page"), F.row_number().over(Window.partitionBy("doc", "page").orderBy("pos")).alias("ord"), named.alias("id"), role.alias("role"),
        _short(c("text")).alias("text"), _first_said("resolved_text", "actual_text", "hint").alias("resolved"), "level")
    cell = cells.select(
        "doc", c("tbl").alias("id"), "pos", F.coalesce("row", F.lit(0)).alias("row"), F.coalesce("col", F.lit(0)).alias("col"), _short(c("text"), MOST_CELL_CHARS).alias("text"),
        (yes("is_header") | yes("column_header") | yes("row_header")).alias("is_header"), yes("column_header").alias("column_header"), yes("row_header").alias("row_header"))
    grids = cell.groupBy("doc", "id").agg(
        F.array_sort(F.collect_set(F.when(c("column_header"), c("row")))).alias("header_rows"), F.array_sort(F.collect_set(F.when(c("row_header"), c("col")))).alias("header_cols"),
        _listed("pos", "row", "col", "text", "is_header", "column_header", "row_header").alias("cells"))
    is_table = c("role") == TABLE
    whole = rows.withColumn("_tbl", F.when(is_table, c("id"))).join(grids.withColumnRenamed("id", "_tbl"), ["doc", "_tbl"], "left")
    pages = whole.groupBy("doc", "page").agg(
        _listed_where(~is_table, "ord", "id", "role", "text", "resolved", "level").alias("blocks"),
        _listed_where(is_table, "ord", "id", c("text").alias("excerpt"), "header_rows", "header_cols", "cells").alias("tables"))
    field = fields.select("doc", "page", "ord", "field_id", "kind", *[_short(c(k)).alias(k) for k in ("name", "label", "value")])
    listed = field.groupBy("doc", "page").agg(_listed("ord", "field_id", "kind", "name", "label", "value").alias("fields"))
    joined = pages.join(listed, ["doc", "page"], "full")
    return joined.select("doc", "page", *[F.coalesce(c(k), F.array()).alias(k) for k in ("blocks", "tables", "fields")])


def _listed_where(where: Column, *columns: str | Column) -> Column:
    return F.array_sort(F.collect_list(F.when(where, F.struct(*columns))))
