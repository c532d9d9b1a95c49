"""Queries of contents, headings, table decisions and flagged texts as whole operators, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.operators import contents as O
from foliolens.operators import overlays as V
from foliolens.plans.registry import query
from foliolens.plans.scalars import _label, _n, _section
from foliolens.plans.whole import _ELEMENTS, _like, elements
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames

c = F.col


# Elements whose second to seventh lines are contents, but in every fourth document, and headings that these name.
def contents(spark, folder) -> DataFrame:
    e = elements(spark, folder)
    pos, toc, head = c("pos"), (c("doc") % 4 != 3) & c("pos").between(1, 6), c("type") == "heading"
    s = lambda x: x.cast("string")
    text = F.when(toc & pos.between(2, 4), F.concat(F.lit("Part "), s(pos % 3), F.lit(" .... "), s(pos))).when(toc & (pos > 4), F.concat(F.lit("2."), s(pos % 5), F.lit(" Missing  "), s(pos)))
    text = text.when(head & (pos % 3 == 1), F.concat(F.lit("Part "), s(pos % 4))).when(head & (pos % 3 == 2), F.concat(F.lit("2."), s(pos % 5), F.lit(" "), c("text"))).otherwise(c("text"))
    kind = F.when(toc & (pos == 1), "toc_caption").when(toc, "toc_item").otherwise(c("type"))
    return e.select("doc", "pos", "page", kind.alias("type"), text.alias("text"), F.floor(pos / 4).alias("grp"), (pos % 8).alias("level"))


_CONTENTS = f"""{_ELEMENTS}, toc AS (SELECT doc, pos, page, CASE WHEN doc % 4 <> 3 AND pos = 1 THEN 'toc_caption' WHEN doc % 4 <> 3 AND pos BETWEEN 2 AND 6 THEN 'toc_item' ELSE type END AS type,
    CASE WHEN doc % 4 <> 3 AND pos BETWEEN 2 AND 4 THEN 'Part ' || pos % 3 || ' .... ' || pos WHEN doc % 4 <> 3 AND pos BETWEEN 5 AND 6 THEN '2.' || pos % 5 || ' Missing  ' || pos WHEN type = 'heading' AND pos % 3 = 1 THEN 'Part ' || pos % 4
    WHEN type = 'heading' AND pos % 3 = 2 THEN '2.' || pos % 5 || ' ' || text ELSE text END AS text, pos // 4 AS grp, pos % 8 AS level FROM elements),
    lab AS (SELECT *, {_label('text')} AS label FROM toc)"""
_IS_ENTRY = "type IN ('toc_caption', 'toc_item') AND label <> ''"


@query("t13_contents_bookmarks", with_frames("doc_lines", f""", {_CONTENTS}, h AS (SELECT doc, {_like('text')} AS key, arg_min({{'page': page, 'level': level}}, pos) AS go FROM toc WHERE type = 'heading' AND {_like('text')} <> '' GROUP BY ALL),
    n AS (SELECT doc, max(page) AS pages FROM toc GROUP BY doc),
    r AS (SELECT l.doc, l.pos, label, go, CASE WHEN l.page < pages THEN l.page END AS own, CASE WHEN type = 'toc_caption' THEN 1 ELSE least(6, CASE WHEN go.level > 0 THEN least(go.level, 6) ELSE 1 END + EXISTS (SELECT 1 FROM toc k WHERE k.doc = l.doc AND k.grp = l.grp AND k.type = 'toc_caption')::INT) END AS level
        FROM lab l JOIN n USING (doc) LEFT JOIN h ON h.doc = l.doc AND h.key = {_like('label')} AND type <> 'toc_caption' WHERE {_IS_ENTRY} AND regexp_matches(label, '[A-Za-z]'))
    SELECT doc, pos, label AS text, coalesce(go.page, own, 0) AS page, coalesce(own, go.page, 0) AS source_page, level, {_section('label')} AS section FROM r QUALIFY row_number() OVER (PARTITION BY doc, {_n('label')}, coalesce(go.page, own, 0) ORDER BY pos) = 1"""))
def t13_whole(spark, folder):
    rows = contents(spark, folder)
    return O.contents_bookmarks(rows, rows.where("type = 'heading'"), rows.groupBy("doc").agg(F.max("page").alias("pages")))


@query("w14_contents_targets", with_frames("doc_lines", f""", {_CONTENTS}, h AS (SELECT doc, pos, {_like('substr(label, 1, 240)')} AS key, {_section('label')} AS sec FROM lab WHERE type = 'heading' AND label <> '')
    SELECT doc, pos, substr(label, 1, 240) AS text, coalesce((SELECT min(h.pos) FROM h WHERE h.doc = l.doc AND h.key = {_like('label')}), (SELECT min(h.pos) FROM h WHERE h.doc = l.doc AND h.sec <> '' AND h.sec = {_section('label')})) AS target
    FROM lab l WHERE {_IS_ENTRY} AND {_like('label')} <> '' QUALIFY row_number() OVER (PARTITION BY doc ORDER BY pos) <= 80
    UNION ALL SELECT doc, pos, substr(label, 1, 240), NULL FROM lab WHERE {_IS_ENTRY} AND {_like('label')} = ''"""))
def w14_targets(spark, folder):
    return O.contents_targets(contents(spark, folder))


@query("w14_bookmark_candidates", with_frames("doc_lines", f""", {_CONTENTS}, z AS (SELECT doc, max(page) + 1 AS last FROM lab WHERE {_IS_ENTRY} GROUP BY doc),
    a AS (SELECT l.*, substr(label, 1, 240) AS cut, last, page + 1 > last AND label <> '' AND type IN ('heading', 'paragraph', 'list_item', 'note') AS shown, CASE WHEN type = 'heading' THEN '' WHEN label <> '' AND type IN ('paragraph', 'list_item', 'note') THEN substr(label, 1, 240) END AS body FROM lab l JOIN z USING (doc)),
    b AS (SELECT *, last_value(body IGNORE NULLS) OVER up AS b0, first_value(body IGNORE NULLS) OVER down AS b1, last_value(CASE WHEN type = 'heading' AND label <> '' THEN cut END IGNORE NULLS) OVER up AS h0, first_value(CASE WHEN type = 'heading' AND label <> '' THEN cut END IGNORE NULLS) OVER down AS h1,
        last_value(CASE WHEN shown THEN cut END IGNORE NULLS) OVER up AS v0, first_value(CASE WHEN shown THEN cut END IGNORE NULLS) OVER down AS v1 FROM a
        WINDOW up AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), down AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT doc, pos, CASE WHEN type = 'heading' THEN 'heading' ELSE 'landmark' END AS kind, page + 1 AS page, cut AS text, {_section('label')} AS section, regexp_replace({_section('label')}, '\\.[^. ]*$', '') AS parent,
    coalesce(CASE WHEN type = 'heading' THEN h0 ELSE v0 END, '') AS before, coalesce(CASE WHEN type = 'heading' THEN h1 ELSE v1 END, '') AS after, coalesce(b0, '') AS body_before, coalesce(b1, '') AS body_after FROM b WHERE shown"""))
def w14_candidates(spark, folder):
    return O.bookmark_candidates(contents(spark, folder))


# Two decisions a table, but none for every fifth; the earlier sets no headers in a third of them.
def _decisions(cells: DataFrame) -> DataFrame:
    tables = cells.select("doc", "page", "tbl").distinct().where("tbl % 5 <> 0")
    t, i = c("tbl"), c("place")
    rows = F.array((t % 4 - 1).cast("int"), i, i).cast("array<int>")
    return tables.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("place")).select(
        "doc", (c("page") - F.when(t % 7 == 0, 1).otherwise(0)).alias("page"), "tbl", "place", F.when((t + i) % 3 == 0, "keep").otherwise(" set_table_headers").alias("action"), rows.alias("header_rows"),
        F.when(t % 2 == 0, F.array((t % 3).cast("int"))).alias("header_cols"), F.when(i == 0, (t % 10) / 10.0).alias("confidence"))


@query("j13_table_headers", with_frames("table_cells", """, c AS (SELECT tbl, "row", col, col = 1 AS ch, "row" = 2 AS rh FROM table_cells),
    i AS (SELECT tbl, place, CASE WHEN (tbl + place) % 3 <> 0 THEN place END AS nth, list_filter([tbl % 4 - 1, place], lambda x: x >= 0) AS r, CASE WHEN tbl % 2 = 0 THEN [tbl % 3] ELSE [] END AS k, CASE WHEN place = 0 AND tbl % 10 > 0 THEN (tbl % 10) / 10.0 ELSE 0.5 END::DOUBLE AS sure FROM (SELECT DISTINCT tbl FROM c) CROSS JOIN (SELECT unnest([0, 1]) AS place) WHERE tbl % 5 <> 0 AND tbl % 7 <> 0),
    d AS (SELECT tbl, arg_max(r, nth) AS r, arg_max(k, nth) AS k, max(sure) AS sure, count(nth) > 0 AS done FROM i GROUP BY tbl)
    SELECT c.tbl, c."row", c.col, CASE WHEN done THEN list_contains(r, c."row") ELSE ch END AS column_header, CASE WHEN done THEN list_contains(k, c.col) ELSE rh END AS row_header, CASE WHEN done THEN list_contains(r, c."row") OR list_contains(k, c.col) ELSE ch OR rh END AS is_header, greatest(0.3, coalesce(sure, 0.3))::DOUBLE AS confidence FROM c LEFT JOIN d USING (tbl)"""))
def j13_whole(spark, folder):
    cells = S.table_cells(spark, folder).select(F.floor(c("tbl") / 100).alias("doc"), F.lit(1).alias("page"), "tbl", "row", "col", (c("col") == 1).alias("column_header"), (c("row") == 2).alias("row_header"))
    none = F.array().cast("array<int>")
    tables = cells.select("doc", "page", "tbl").distinct().select("*", none.alias("header_rows"), none.alias("header_cols"), F.lit(0.3).alias("confidence"))
    decided = V.table_decisions(tables, _decisions(cells))
    return V.with_headers(cells, decided).join(decided.select("tbl", "confidence"), "tbl").select("tbl", "row", "col", "column_header", "row_header", "is_header", "confidence")


@query("g21_adjudicated_tasks", with_frames("review_tasks", """, t AS (SELECT job_id AS doc, task_id AS place, task_type, severity, blocking, task_type = 'content_fidelity' AND source <> '4-NOT SPECIFIED' AND task_id % 3 <> 0 AS asked, source FROM review_tasks),
    b AS (SELECT user_id AS doc, event_id % 9 AS page, event_type AS issue FROM events WHERE event_type IN ('error', 'purchase') AND event_id % 4 = 0),
    k AS (SELECT doc, string_agg(DISTINCT CASE WHEN issue = 'error' THEN 'encoding_problem' ELSE issue END, ',' ORDER BY CASE WHEN issue = 'error' THEN 'encoding_problem' ELSE issue END) AS issues, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, count(*) AS confirmed, count(*) FILTER (issue = 'error') AS encoding_problems FROM b GROUP BY doc),
    r AS (SELECT t.*, asked AND row_number() OVER (PARTITION BY doc, asked ORDER BY place) = 1 AS hit FROM t)
    SELECT r.doc, place, CASE WHEN hit THEN 'Verify readable text on flagged blocks' ELSE task_type END AS title, CASE WHEN hit THEN 'high' ELSE severity END AS severity, hit OR blocking AS blocking, CASE WHEN hit THEN issues END AS issues, CASE WHEN hit THEN pages END AS pages, CASE WHEN hit THEN confirmed END AS confirmed, CASE WHEN hit THEN encoding_problems END AS encoding_problems
    FROM r LEFT JOIN k USING (doc) WHERE NOT hit OR confirmed IS NOT NULL"""))
def g21_whole(spark, folder):
    source = F.when(c("source") == "4-NOT SPECIFIED", "other").when(c("source") == "1-URGENT", F.lit(None)).otherwise("fidelity")
    tasks = S.review_tasks(spark, folder).select(c("job_id").alias("doc"), c("task_id").alias("place"), "task_type", source.alias("source"), (c("task_id") % 3 != 0).alias("candidate"), c("task_type").alias("title"), "severity", "blocking")
    e = S.table(spark, folder, "events")
    kind = F.when(c("event_type") == "error", "encoding_problem").otherwise(c("event_type"))
    blocks = e.select(c("user_id").alias("doc"), (c("event_id") % 9).alias("page"), kind.alias("issue_type"), (c("event_type").isin("error", "purchase") & (c("event_id") % 4 == 0)).alias("blocks_access"))
    return V.adjudicated_tasks(tasks, blocks).select("doc", "place", "title", "severity", "blocking", F.array_join("issue_types", ",").alias("issues"), F.array_join("pages_to_check", ",").alias("pages"), "confirmed", "encoding_problems")
