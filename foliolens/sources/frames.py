"""Frames derived from the stored tables: violations, steps, links, elements, cells, boxes.

Each frame is a function of (spark, folder) and stays lazy, so filters and column
choices of a query reach the Parquet scan. ``SQL`` has the same frames as common table
expressions for an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINK = r'<a href="([^"]*)">([^<]*)</a>'
TAGS = r"<(title|h1|p|li)>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan of fewer splits than cores dealt over them by a key, for work that costs far more than moving its rows; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, key) if df.rdd.getNumPartitions() < cores else df


def violations(spark: SparkSession, folder: str) -> DataFrame:
    """Events as rule violations; a count below 1 is 1."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, folder, "events").select(
        "event_id", "ts", F.col("event_type").alias("rule_id"), F.col("user_id").alias("doc"),
        F.greatest(F.coalesce(k, F.lit(1)), F.lit(1)).cast("bigint").alias("count"),
        F.when(F.col("event_type").isin("error", "purchase"), "error").otherwise("warning").alias("severity"),
        F.concat("event_type", F.lit(" event")).alias("description"),
    )


def job_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user in order as steps of a job; a step ends where the next begins."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("step"), F.col("ts").alias("started"),
        F.lead("ts").over(w).alias("completed"), F.row_number().over(w).alias("pos"))


def usage(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("model"), k.cast("bigint").alias("tokens"), F.round(F.col("value") * 100).cast("bigint").alias("cost_cents"))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their verdicts: compliant, blocking, or failed where there is no label."""
    return table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars").join(
        table(spark, folder, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("compliant"), (F.col("toxic") == 1).alias("blocking"),
        F.col("quality").isNull().alias("failed"))


def review_tasks(spark: SparkSession, folder: str) -> DataFrame:
    severity = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    kind = F.element_at(F.array(*map(F.lit, ["alt_text", "table_semantics", "reading_order", "font_text_fidelity", "content_fidelity"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("job_id"), kind.alias("task_type"), severity.alias("severity"),
        (F.col("o_orderstatus") == "F").alias("blocking"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("source"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of pages in order (from 0): address and anchor text."""
    html = F.col("html")
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)).alias("uri"), F.regexp_extract_all(html, F.lit(LINK), F.lit(2)).alias("contents"))
    return table(spark, folder, "pages").select(F.col("page_id").alias("page"), F.posexplode(pairs).alias("pos", "link")).select("page", "pos", "link.uri", "link.contents")


def page_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of pages in order (from 0) as document elements."""
    kind = F.create_map(*[F.lit(x) for x in ("title", "title", "h1", "heading", "p", "paragraph", "li", "list_item")])
    return table(spark, folder, "pages").select(F.col("page_id").alias("doc"), F.posexplode(F.regexp_extract_all("html", F.lit(TAGS), F.lit(1))).alias("pos", "tag")).select(
        "doc", "pos", "tag", kind[F.col("tag")].alias("type"))


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents that hold more than blanks, with their places (from 0) among all lines."""
    return table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")


def table_cells(spark: SparkSession, folder: str) -> DataFrame:
    """One cell for each (order, line number): the row is the return flag's rank."""
    cells = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").alias("col")).agg(
        F.min(F.struct("l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag")).alias("x"))
    row = F.when(F.col("x.l_returnflag") == "A", 0).when(F.col("x.l_returnflag") == "N", 1).otherwise(2)
    return cells.select("tbl", "col", row.alias("row"), F.concat(F.lit("p"), F.col("x.l_partkey").cast("string")).alias("text"), F.col("x.q").alias("q"), (F.col("x.q") % 3 + 1).alias("col_span"))


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("pos"), "role", "text")


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """A box around a point of the plane for each vector, on the page of its label."""
    x, y = (F.round(F.element_at("embedding", i).cast("double") * 1000) for i in (1, 2))
    half = (F.col("vec_id") % 40 + 10).cast("double")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("box"), F.col("label").alias("page"), (x - half).alias("l"), (y - half / 2).alias("b"), (x + half).alias("r"), (y + half / 2).alias("t"))


# The same frames for the independent engine.
SQL = {
    "violations": """violations AS (SELECT event_id, ts, event_type AS rule_id, user_id AS doc,
        greatest(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 1), 1)::BIGINT AS count,
        CASE WHEN event_type IN ('error', 'purchase') THEN 'error' ELSE 'warning' END AS severity,
        event_type || ' event' AS description FROM events)""",
    "job_steps": """job_steps AS (SELECT event_id, user_id AS job_id, event_type AS step, ts AS started,
        lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS completed,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)""",
    "usage": """usage AS (SELECT event_id, ts, user_id, event_type AS model, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
        round(value * 100)::BIGINT AS cost_cents FROM events)""",
    "jobs": """jobs AS (SELECT doc_id, lang, source, n_chars, quality = 1 AS compliant, toxic = 1 AS blocking, quality IS NULL AS failed
        FROM documents LEFT JOIN labels USING (doc_id))""",
    "review_tasks": """review_tasks AS (SELECT o_orderkey AS task_id, o_custkey AS job_id,
        ['alt_text', 'table_semantics', 'reading_order', 'font_text_fidelity', 'content_fidelity'][(o_orderkey % 5 + 1)::INT] AS task_type,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
        o_orderstatus = 'F' AS blocking, o_orderdate AS created, o_orderpriority AS source FROM orders)""",
    "page_links": f"""page_links AS (SELECT page_id AS page, (pos - 1)::INT AS pos, u[pos] AS uri, c[pos] AS contents FROM (
        SELECT page_id, u, c, unnest(range(1, len(u) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS u, regexp_extract_all(html, '{LINK}', 2) AS c FROM pages)))""",
    "page_elements": f"""page_elements AS (SELECT page_id AS doc, (pos - 1)::INT AS pos, g[pos] AS tag,
        CASE g[pos] WHEN 'title' THEN 'title' WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' ELSE 'list_item' END AS type FROM (
        SELECT page_id, g, unnest(range(1, len(g) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{TAGS}', 1) AS g FROM pages)))""",
    "doc_lines": """doc_lines AS (SELECT doc_id, (pos - 1)::INT AS pos, s[pos] AS line FROM (
        SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(s[pos], ' ') <> '')""",
    "table_cells": """table_cells AS (SELECT tbl, col, CASE x.f WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS "row", 'p' || x.p AS text, x.q AS q, x.q % 3 + 1 AS col_span FROM (
        SELECT l_orderkey AS tbl, l_linenumber AS col, min({'p': l_partkey, 's': l_suppkey, 'q': l_quantity::INT, 'f': l_returnflag}) AS x FROM lineitem GROUP BY ALL))""",
    "blocks": "blocks AS (SELECT conv_id AS page, turn AS pos, role, text FROM conversations)",
    "boxes": """boxes AS (SELECT vec_id AS box, label AS page, x - h AS l, y - h / 2 AS b, x + h AS r, y + h / 2 AS t FROM (
        SELECT vec_id, label, round(embedding[1]::DOUBLE * 1000) AS x, round(embedding[2]::DOUBLE * 1000) AS y, (vec_id % 40 + 10)::DOUBLE AS h FROM embeddings))""",
}


def with_frames(names: str, body: str) -> str:
    """SQL of ``body`` over the named frames (comma-separated)."""
    return f"WITH {', '.join(SQL[n.strip()] for n in names.split(','))} {body}"
