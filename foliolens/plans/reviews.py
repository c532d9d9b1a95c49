"""Queries of figure context, answers to table tasks, proposed changes and tag coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.operators.reviews import figure_context, merged_chunks, order_fits, order_summary, repair_gate, table_summary, updates_fit
from foliolens.plans.registry import query
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames

c = F.col


@query("g13_semantic_summary", with_frames("page_elements", """SELECT doc, count(*) AS total, count(*) FILTER (regexp_full_match(t, 'H[1-6]?')) AS headings, count(*) FILTER (regexp_full_match(t, 'H([7-9]|[0-9]{2,})')) AS illegal, count(*) FILTER (t IN ('LI', 'P')) AS interesting
    FROM (SELECT doc, CASE WHEN tag = 'h1' THEN 'H' || pos % 12 ELSE upper(tag) END AS t FROM page_elements) GROUP BY doc"""))
def g13(spark, folder):
    tag = F.when(c("tag") == "h1", F.concat(F.lit("H"), (c("pos") % 12).cast("string"))).otherwise(F.upper("tag"))
    return S.page_elements(spark, folder).select("doc", tag.alias("t")).groupBy("doc").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.rlike("t", F.lit("^H[1-6]?$"))).alias("headings"),
        F.count_if(F.rlike("t", F.lit("^H([7-9]|[0-9]{2,})$"))).alias("illegal"), F.count_if(c("t").isin("LI", "P")).alias("interesting"))


@query("g28_figure_context", with_frames("boxes", """, f AS (SELECT page, box, (r - l) * (t - b) AS a, CASE WHEN box % 3 = 0 THEN 'caption' ELSE '' END AS caption FROM boxes),
    m AS (SELECT f.page, f.box, f.a, f.caption, max(g.a) AS most, coalesce(list(g.box ORDER BY g.box) FILTER (g.box <> f.box AND g.a > f.a * 8), []) AS far FROM f JOIN f g ON g.page = f.page GROUP BY ALL)
    SELECT page, box, round(a, 2) AS area, round(a / most, 4) AS relative, caption = '' AND a > 0 AND a / most <= 0.02 AND len(far) > 0 AS child, array_to_string(far[1:4], ',') AS siblings FROM m"""))
def g28(spark, folder):
    figures = S.boxes(spark, folder).withColumn("caption", F.when(c("box") % 3 == 0, "caption"))
    return figure_context(figures).withColumn("siblings", F.array_join(F.transform("siblings", lambda x: x.cast("string")), ","))


_ITEMS = """items AS (SELECT job_id, task_id AS pos, task_id % 7 AS table_id, CASE severity WHEN 'high' THEN ' High' ELSE severity END AS confidence,
    ['manual_only', 'confirm_current_headers', 'set_table_headers', 'reclassify_region', 'confirm_current_headers'][(job_id + task_id % 3) % 5 + 1] AS action, CASE WHEN blocking THEN source || '  seen' END AS reason FROM review_tasks)"""


def _items(spark, folder):
    actions = F.array(*map(F.lit, ["manual_only", "confirm_current_headers", "set_table_headers", "reclassify_region", "confirm_current_headers"]))
    return S.review_tasks(spark, folder).select(
        "job_id", c("task_id").alias("pos"), (c("task_id") % 7).cast("string").alias("table_id"), F.when(c("severity") == "high", " High").otherwise(c("severity")).alias("confidence"),
        F.element_at(actions, ((c("job_id") + c("task_id") % 3) % 5 + 1).cast("int")).alias("action"), F.when(c("blocking"), F.concat("source", F.lit("  seen"))).alias("reason"))


@query("g29_table_summary", with_frames("review_tasks", f""", {_ITEMS}, firsts AS (SELECT job_id, table_id, arg_min(action, pos) AS first FROM items WHERE action IN ('set_table_headers', 'reclassify_region') GROUP BY ALL),
    f AS (SELECT job_id, count(*) FILTER (first = 'set_table_headers') AS p, count(*) FILTER (first = 'reclassify_region') AS q FROM firsts GROUP BY job_id),
    rs AS (SELECT job_id, string_agg(x, ' ' ORDER BY first_pos) AS reason FROM (SELECT job_id, replace(reason, '  ', ' ') AS x, min(pos) AS first_pos FROM items WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY job_id),
    i AS (SELECT job_id, count(*) AS n, min(CASE lower(trim(confidence)) WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS k, count(*) FILTER (action = 'manual_only') AS m, count(*) FILTER (action = 'confirm_current_headers') AS cf, count(*) FILTER (action = 'reclassify_region') AS mv FROM items GROUP BY job_id),
    j AS (SELECT job_id, n, k, m, cf, mv, coalesce(p, 0) AS p, coalesce(q, 0) AS q, coalesce(reason, '') AS reason, greatest(n - coalesce(p, 0) - cf, 0, m) AS u FROM i LEFT JOIN f USING (job_id) LEFT JOIN rs USING (job_id))
    SELECT job_id, n AS total, p AS proposed, q AS reclassified, ['low', 'medium', 'high'][k + 1] AS confidence, CASE WHEN p > 0 THEN 'set_table_headers' WHEN q > 0 OR mv > 0 THEN 'reclassify_region' WHEN m > 0 THEN 'manual_only' ELSE 'confirm_current_headers' END AS action,
    'Reviewed ' || n || ' tables; ' || CASE WHEN p > 0 AND u > 0 THEN 'proposed header updates for ' || p || ' and left ' || u || ' needing manual follow-up.' WHEN p > 0 THEN 'proposed header updates for ' || p || '.'
    WHEN mv > 0 THEN mv || CASE WHEN mv = 1 THEN ' region was' ELSE ' regions were' END || ' identified as not actually being data tables.' WHEN cf = n THEN 'current header flags look acceptable.' ELSE 'manual follow-up is still required.' END AS summary, substring(reason, 1, 1000) AS reason FROM j"""))
def g29(spark, folder):
    return table_summary(_items(spark, folder), "job_id")


@query("g30_table_decisions", with_frames("review_tasks", f""", {_ITEMS}, a AS (SELECT job_id, CASE WHEN count(*) FILTER (action = 'set_table_headers') > 0 THEN 'set_table_headers' WHEN count(*) FILTER (action = 'reclassify_region') > 0 THEN 'reclassify_region' WHEN count(*) FILTER (action = 'manual_only') > 0 THEN 'manual_only' ELSE 'confirm_current_headers' END AS set_first,
    arg_min(action, pos) FILTER (action IN ('set_table_headers', 'reclassify_region')) AS f FROM items WHERE table_id = 3 GROUP BY job_id)
    SELECT CASE WHEN f IS NULL THEN set_first ELSE f END AS action, count(*) AS jobs FROM a GROUP BY ALL"""))
def g30(spark, folder):
    """What tasks about one table come to, over all jobs."""
    return table_summary(_items(spark, folder).where("table_id = '3'"), "job_id").groupBy("action").agg(F.count(F.lit(1)).alias("jobs"))


@query("p44_valid_permutation", with_frames("blocks", "SELECT page, page % 4 IN (0, 1) OR (page % 4 = 2 AND n = 1) AS valid FROM (SELECT page, count(*) AS n FROM blocks GROUP BY page)"))
def p44(spark, folder):
    """Orders of pages: the same, the reverse, one id over and over, and an id that isn't there."""
    rows = S.blocks(spark, folder).groupBy("page").agg(F.sort_array(F.collect_list("pos")).alias("ids"))
    first = F.element_at("ids", 1)
    proposed = F.when(c("page") % 4 == 0, c("ids")).when(c("page") % 4 == 1, F.reverse("ids")).when(c("page") % 4 == 2, F.transform("ids", lambda x: first)).otherwise(F.transform("ids", lambda x: -x - 1))
    return rows.select("page", order_fits(c("ids"), proposed).alias("valid"))


@query("p45_valid_table_updates", "SELECT o_custkey, bool_and(o_orderkey % 5 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)) AS valid FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey")
def p45(spark, folder):
    action = F.when(c("o_orderkey") % 5 == 0, "manual_only").when(c("o_orderkey") % 5 < 3, "set_table_headers")
    updates = S.table(spark, folder, "orders").where("o_orderstatus <> 'O'").select("o_custkey", c("o_orderkey").alias("table_id"), action.alias("action"))
    tables = S.table(spark, folder, "lineitem").where("l_quantity > 30").select(c("l_orderkey").alias("table_id"))
    return updates_fit(updates, tables, "o_custkey")


@query("g31_order_decisions", with_frames("review_tasks", """, x AS (SELECT job_id, min(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS k, bool_or(task_id % 7 = 0) AS o, bool_or(task_id % 7 = 1) AS h, bool_or(task_id % 7 = 2) AS m,
    count(*) FILTER (task_id % 7 = 0) AS orders, count(*) FILTER (task_id % 3 > 0) AS focus FROM review_tasks GROUP BY job_id),
    r AS (SELECT job_id, string_agg(source, ' ' ORDER BY p) AS reason FROM (SELECT job_id, source, min(task_id) AS p FROM review_tasks WHERE blocking GROUP BY ALL) GROUP BY job_id)
    SELECT job_id, a AS action, ['low', 'medium', 'high'][k + 1] AS confidence, CASE a WHEN 'confirm_current_order' THEN 'Current reading order looks acceptable on the reviewed pages.' WHEN 'manual_only' THEN 'Reading order still needs manual follow-up.' ELSE 'Review the proposed reading order changes.' END AS summary,
    coalesce(reason, '') AS reason, o2 AS orders, focus FROM (SELECT *, CASE WHEN o THEN 'reorder_review' WHEN h THEN 'artifact_headers_footers' WHEN m THEN 'manual_only' ELSE 'confirm_current_order' END AS a, n.c AS o2 FROM x
    JOIN (SELECT job_id, count(*) FILTER (task_id % 7 = 0 AND task_id % 3 > 0) AS c FROM review_tasks GROUP BY job_id) n USING (job_id)) LEFT JOIN r USING (job_id)"""))
def g31(spark, folder):
    k = c("task_id")
    rows = S.review_tasks(spark, folder).select(
        "job_id", k.alias("pos"), (k % 3).alias("page"), c("severity").alias("confidence"), F.element_at(F.array(*map(F.lit, ["reorder_review", "artifact_headers_footers", " manual_only", "", "", "", ""])), (k % 7 + 1).cast("int")).alias("action"),
        F.when(c("blocking"), c("source")).alias("reason"), F.lit(" ").alias("summary"), F.when(k % 7 == 0, F.array(F.lit("a"), F.lit(" "))).when(k % 7 == 1, F.array(F.lit(" "))).alias("ids"))
    return order_summary(rows, "job_id")


@query("g32_merge_chunks", with_frames("blocks", """, x AS (SELECT page, pos, pos % 2 = 0 AS is_toc, CASE page % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, role FROM blocks)
    SELECT page, bool_or(is_toc AND confidence <> 'low') AS is_toc, any_value(confidence) AS confidence, coalesce(array_to_string((list(role ORDER BY pos) FILTER (is_toc AND confidence <> 'low'))[1:3], ' '), '') AS reason,
    coalesce(array_to_string(list_sort(list(DISTINCT pos % 4) FILTER (is_toc AND confidence <> 'low')), ','), '') AS entry_indexes, arg_max(role, pos) FILTER (is_toc AND confidence <> 'low') AS last_type,
    coalesce(arg_min('c' || pos, pos) FILTER (is_toc AND confidence <> 'low' AND pos > 0), '') AS caption, count(*) AS chunk_count FROM x GROUP BY page"""))
def g32(spark, folder):
    """Each turn as a chunk: even ones are contents; the type of the one shared entry is the last turn's."""
    label = F.element_at(F.array(F.lit("high"), F.lit(" Medium"), F.lit("low")), (c("page") % 3 + 1).cast("int"))
    rows = S.blocks(spark, folder).select(
        "page", "pos", (c("pos") % 2 == 0).alias("is_toc"), label.alias("confidence"), c("role").alias("reason"), F.when(c("pos") > 0, F.concat(F.lit("c"), c("pos").cast("string"))).alias("caption"),
        F.array((c("pos") % 4).cast("int")).alias("entry_indexes"), F.create_map(F.lit("e"), "role").alias("entry_types"))
    found = merged_chunks(rows, "page")
    return found.select("page", "is_toc", "confidence", "reason", F.array_join(F.transform("entry_indexes", lambda x: x.cast("string")), ",").alias("entry_indexes"), c("entry_types")["e"].alias("last_type"), "caption", "chunk_count")


@query("g35_repair_gate", """WITH f AS (SELECT p_partkey // 7 AS doc, p_partkey AS pos, CASE WHEN p_partkey % 4 = 0 THEN '0' WHEN p_partkey % 4 < 3 THEN 's' ELSE 'x' END AS s, p_size % 2 = 0 AS mapped, p_size % 5 = 0 AS unread, p_partkey % 3 = 0 AS explicit, p_brand AS base, p_partkey // 7 % 2 = 0 AS uni FROM part),
    g AS (SELECT *, s = '0' AND (uni OR NOT mapped) AS t0, s = 's' AND (NOT mapped OR unread) AS need FROM f), h AS (SELECT doc, count(*) FILTER (t0) AS safe_type0, count(*) FILTER (need AND explicit AND unread) AS safe_simple, count(*) FILTER (need AND NOT (explicit AND unread)) AS blocked FROM g GROUP BY doc),
    e AS (SELECT doc, array_to_string((list(base ORDER BY p))[1:5], ', ') AS examples FROM (SELECT doc, base, min(pos) AS p FROM g WHERE need AND NOT (explicit AND unread) GROUP BY ALL) GROUP BY doc)
    SELECT doc, safe_type0 + safe_simple > 0 AS automatic, safe_type0, safe_simple, blocked, coalesce(examples, '') AS examples, CASE WHEN safe_type0 + safe_simple > 0 THEN 'deterministic font candidates available'
    WHEN blocked > 0 THEN 'unicode issues appear tied to simple fonts without explicit encoding (' || examples || ')' ELSE 'no deterministic ToUnicode candidates found' END AS reason FROM h LEFT JOIN e USING (doc)""")
def g35(spark, folder):
    k, doc = c("p_partkey"), F.floor(c("p_partkey") / 7)
    fonts = S.table(spark, folder, "part").select(
        doc.alias("doc"), k.alias("pos"), F.when(k % 4 == 0, "/Type0").when(k % 4 == 1, "/Type1").when(k % 4 == 2, "/TrueType").otherwise("/Type3").alias("subtype"), F.lit("/CIDFontType2").alias("descendant"), F.lit(True).alias("embedded"),
        (c("p_size") % 2 == 0).alias("mapped"), (c("p_size") % 5 == 0).cast("int").alias("unread"), F.lit(0).alias("missing"), F.lit(None).cast("int").alias("repairable"), F.when(k % 3 == 0, "explicit").alias("policy"),
        c("p_brand").alias("base_font"), (doc % 2 == 0).alias("unicode_rules"), F.lit(False).alias("invalid_rules"))
    return repair_gate(fonts, "doc")
