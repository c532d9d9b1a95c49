"""Answers of a reviewing service laid over stored tables and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

# The action that sets headers, a decision's confidence where it names none.
SET_HEADERS, DEFAULT_CONFIDENCE = "set_table_headers", 0.5
# The task that flagged texts wait in, its title once they are confirmed, the issue counted apart.
TEXT_TASK, TEXT_SOURCE, TEXT_TITLE, ENCODING = "content_fidelity", "fidelity", "Verify readable text on flagged blocks", "encoding_problem"


def table_decisions(tables: DataFrame, decisions: DataFrame) -> DataFrame:
    """``tables`` (doc, page, tbl, header_rows, header_cols, confidence) after all ``decisions``, with ``reviewed``.

    A decision is (doc, place, page, tbl, action, header_rows, header_cols, confidence). Those
    of a page below 1 or without a table are void. The last that sets headers counts, without
    negative numbers, sorted and each once; null lists are empty. Confidence is the greatest
    of the table's own and all decisions' (0.5 where null or 0).
    """
    tbl = F.trim(c("tbl").cast("string"))
    kept = lambda k: F.array_sort(F.array_distinct(F.filter(F.coalesce(k, F.array().cast("array<int>")), lambda x: x >= 0)))
    sets = F.trim("action") == SET_HEADERS
    valid = decisions.where((c("page") >= 1) & (tbl != "")).withColumn("_tbl", tbl)
    last = valid.groupBy("doc", "page", "_tbl").agg(
        F.max_by(F.struct(kept(c("header_rows")).alias("r"), kept(c("header_cols")).alias("k")), F.when(sets, c("place"))).alias("_set"),
        F.max(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(DEFAULT_CONFIDENCE))).alias("_sure"))
    rows = tables.withColumn("_tbl", tbl).join(last, ["doc", "page", "_tbl"], "left")
    return rows.select(
        "doc", "page", "tbl", F.coalesce("_set.r", "header_rows").alias("header_rows"), F.coalesce("_set.k", "header_cols").alias("header_cols"),
        F.greatest("confidence", "_sure").alias("confidence"), c("_set").isNotNull().alias("headers_set"), c("_sure").isNotNull().alias("reviewed"))


def with_headers(cells: DataFrame, decided: DataFrame) -> DataFrame:
    """``cells`` (doc, page, tbl, row, col, column_header, row_header) with the headers of ``table_decisions`` where those were set, and ``is_header``."""
    rules = decided.where("headers_set").select("doc", "page", "tbl", c("header_rows").alias("_r"), c("header_cols").alias("_k"))
    rows = cells.join(rules, ["doc", "page", "tbl"], "left")
    own = {"column_header": ("_r", "row"), "row_header": ("_k", "col")}
    marked = rows.withColumns({name: F.when(c(a).isNotNull(), F.array_contains(a, c(b))).otherwise(c(name)) for name, (a, b) in own.items()})
    return marked.withColumn("is_header", F.coalesce(c("column_header") | c("row_header"), F.lit(False))).drop("_r", "_k")


def adjudicated_tasks(tasks: DataFrame, blocks: DataFrame) -> DataFrame:
    """``tasks`` (doc, place, task_type, source, candidate, title, severity, blocking) after the answers about flagged texts.

    ``blocks`` is (doc, page, issue_type, blocks_access). Of each document the first task
    about flagged texts goes if no block is confirmed, else it blocks with high severity and
    names issues, pages and counts; the others stay, with nulls there. A null source reads as "fidelity".
    """
    asked = (c("task_type") == TEXT_TASK) & (F.coalesce("source", F.lit(TEXT_SOURCE)) == TEXT_SOURCE) & F.coalesce("candidate", F.lit(False))
    first = tasks.where(asked).groupBy("doc").agg(F.min("place").alias("_first"))
    issue = F.trim(F.coalesce("issue_type", F.lit("")))
    confirmed = blocks.where("blocks_access").groupBy("doc").agg(
        F.array_sort(F.collect_set(F.nullif(issue, F.lit("")))).alias("issue_types"), F.array_sort(F.collect_set("page")).alias("pages_to_check"),
        F.count(F.lit(1)).alias("confirmed"), F.count_if(c("issue_type") == ENCODING).alias("encoding_problems"))
    found = first.join(confirmed, "doc", "left").withColumnRenamed("_first", "place").withColumn("_hit", F.lit(True))
    rows = tasks.join(found, ["doc", "place"], "left").where(c("_hit").isNull() | c("confirmed").isNotNull())
    hit = c("_hit").isNotNull()
    return rows.withColumns({"title": F.when(hit, TEXT_TITLE).otherwise(c("title")), "severity": F.when(hit, "high").otherwise(c("severity")), "blocking": hit | c("blocking")}).drop("_hit")
