"""Queries of best-of selection, top-k, ordered distinct and nested values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliolens.plans.registry import query
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames

c = F.col


@query("t1_best_validation", with_frames("violations", """SELECT rule_id, arg_max(doc, {'c': ok, 'e': -e, 'w': -w, 'd': -doc}) AS best FROM (SELECT rule_id, doc, count(*) FILTER (count > 90) = 0 AS ok, count(*) FILTER (count > 50) AS e, count(*) AS w FROM violations GROUP BY ALL) GROUP BY rule_id"""))
def t1(spark, folder):
    per = S.violations(spark, folder).groupBy("rule_id", "doc").agg((F.count_if(c("count") > 90) == 0).alias("ok"), F.count_if(c("count") > 50).alias("e"), F.count(F.lit(1)).alias("w"))
    return per.groupBy("rule_id").agg(F.max_by("doc", F.struct("ok", -c("e"), -c("w"), -c("doc"))).alias("best"))


@query("t2_best_weighted", with_frames("violations", """SELECT rule_id, arg_max(doc, {'e': -e, 'd': -doc}) AS best FROM (SELECT rule_id, doc, sum(count)::BIGINT AS e FROM violations GROUP BY ALL) GROUP BY rule_id"""))
def t2(spark, folder):
    per = S.violations(spark, folder).groupBy("rule_id", "doc").agg(F.sum("count").alias("e"))
    return per.groupBy("rule_id").agg(F.max_by("doc", F.struct(-c("e"), -c("doc"))).alias("best"))


@query("t3_regressions", "SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 10 AND p_partkey % 5 = 0 THEN 'to_zero' END, CASE WHEN p_size >= 5 AND (p_partkey % 5) * 10 < p_size * 0.8 THEN 'dropped' END) AS regressions FROM part")
def t3(spark, folder):
    now = c("p_partkey") % 5
    return S.table(spark, folder, "part").select("p_partkey", F.concat_ws(",", F.when((c("p_size") > 10) & (now == 0), "to_zero"), F.when((c("p_size") >= 5) & (now * 10 < c("p_size") * 0.8), "dropped")).alias("regressions"))


@query("t5_not_worse", "SELECT p_partkey, p_size % 7 <= p_partkey % 7 AS not_worse FROM part")
def t5(spark, folder):
    return S.table(spark, folder, "part").select("p_partkey", (c("p_size") % 7 <= c("p_partkey") % 7).alias("not_worse"))


@query("t7_sorted_entries", with_frames("boxes", "SELECT page, box, (row_number() OVER (PARTITION BY page ORDER BY t DESC, l, box))::INT AS place FROM boxes"))
def t7(spark, folder):
    return S.boxes(spark, folder).select("page", "box", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("t"), "l", "box")).alias("place"))


@query("t9_upsert", """SELECT n_nationkey AS id, coalesce(CASE WHEN s_name IS NOT NULL AND n_nationkey % 2 = 0 THEN s_name END, n_name) AS label FROM nation LEFT JOIN supplier ON s_suppkey = n_nationkey
    UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey NOT IN (SELECT n_nationkey FROM nation)""")
def t9(spark, folder):
    """Later fields overwrite: one union, and per id the last label that isn't null."""
    first = S.table(spark, folder, "nation").select(c("n_nationkey").cast("bigint").alias("id"), F.lit(0).alias("age"), c("n_name").alias("label"))
    later = S.table(spark, folder, "supplier").where("s_suppkey % 2 = 0").select(c("s_suppkey").alias("id"), F.lit(1).alias("age"), c("s_name").alias("label"))
    return first.unionByName(later).groupBy("id").agg(F.max_by("label", F.when(c("label").isNotNull(), c("age"))).alias("label"))


@query("t10_ordered_union", with_frames("blocks", "SELECT page, role, min(pos) AS pos FROM (SELECT page, role, pos FROM blocks WHERE pos % 2 = 0 UNION ALL SELECT page, role, pos + 100 FROM blocks WHERE pos % 2 = 1) GROUP BY ALL"))
def t10(spark, folder):
    return S.blocks(spark, folder).withColumn("pos", F.when(c("pos") % 2 == 0, c("pos")).otherwise(c("pos") + 100)).groupBy("page", "role").agg(F.min("pos").alias("pos"))


@query("t11_first_tables", with_frames("table_cells", "SELECT tbl, count(*) AS cells FROM table_cells GROUP BY tbl ORDER BY tbl LIMIT 3"))
def t11(spark, folder):
    return S.table_cells(spark, folder).groupBy("tbl").agg(F.count(F.lit(1)).alias("cells")).orderBy("tbl").limit(3)


@query("t12_ordered_distinct", with_frames("blocks", "SELECT page, string_agg(role, ',' ORDER BY pos) AS roles FROM (SELECT page, role, min(pos) AS pos FROM blocks GROUP BY ALL) GROUP BY page"))
def t12(spark, folder):
    rows = S.blocks(spark, folder).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"]).alias("a"))
    return rows.select("page", F.array_join(F.array_distinct("a"), ",").alias("roles"))


@query("t15_heading_bookmarks", "SELECT p_partkey, least(greatest(p_size % 9, 1), 6) AS level FROM part WHERE p_size BETWEEN 1 AND 40")
def t15(spark, folder):
    return S.table(spark, folder, "part").where("p_size between 1 and 40").select("p_partkey", F.least(F.greatest(c("p_size") % 9, F.lit(1)), F.lit(6)).alias("level"))


@query("f44_table_preview", with_frames("table_cells", """SELECT tbl, "row", string_agg(text, ' | ' ORDER BY col) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY tbl, "row" ORDER BY col) AS k FROM table_cells) WHERE k <= 4 GROUP BY ALL"""))
def f44(spark, folder):
    cells = S.table_cells(spark, folder).groupBy("tbl", "row").agg(F.slice(F.array_sort(F.collect_list(F.struct("col", "text"))), 1, 4).alias("a"))
    return cells.select("tbl", "row", F.array_join(F.transform("a", lambda x: x["text"]), " | ").alias("preview"))


@query("f45_preview_grid", with_frames("table_cells", """SELECT tbl, "row", max(text) FILTER (col = 1) AS c1, max(text) FILTER (col = 2) AS c2, max(text) FILTER (col = 3) AS c3, max(text) FILTER (col = 4) AS c4 FROM table_cells WHERE col <= 4 GROUP BY ALL"""))
def f45(spark, folder):
    grid = S.table_cells(spark, folder).where("col <= 4").groupBy("tbl", "row").pivot("col", [1, 2, 3, 4]).agg(F.max("text"))
    return grid.select("tbl", "row", *[c(str(i)).alias(f"c{i}") for i in range(1, 5)])


@query("f19_toc_table", with_frames("table_cells", "SELECT tbl, count(*) FILTER (q % 10 < 5) * 2 >= count(*) AS is_toc FROM table_cells GROUP BY tbl"))
def f19(spark, folder):
    return S.table_cells(spark, folder).groupBy("tbl").agg((F.count_if(c("q") % 10 < 5) * 2 >= F.count(F.lit(1))).alias("is_toc"))


@query("n1_document_model", with_frames("blocks", "SELECT page, count(*) AS blocks, string_agg(pos::VARCHAR || ':' || role, ',' ORDER BY pos) AS layout FROM blocks GROUP BY page"))
def n1(spark, folder):
    rows = S.blocks(spark, folder).groupBy("page").agg(F.count(F.lit(1)).alias("blocks"), F.array_sort(F.collect_list(F.struct("pos", "role"))).alias("a"))
    return rows.select("page", "blocks", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["pos"].cast("string"), x["role"])), ",").alias("layout"))


@query("n2_normalize_elements", with_frames("page_elements", "SELECT doc, pos, type, CASE WHEN type = 'heading' THEN 1 END AS level, (sum((type = 'paragraph')::INT) OVER (PARTITION BY doc ORDER BY pos))::BIGINT AS paragraph_index FROM page_elements"))
def n2(spark, folder):
    w = Window.partitionBy("doc").orderBy("pos")
    return S.page_elements(spark, folder).select("doc", "pos", "type", F.when(c("type") == "heading", 1).alias("level"), F.sum((c("type") == "paragraph").cast("int")).over(w).alias("paragraph_index"))


@query("n5_cells", with_frames("table_cells", 'SELECT tbl, "row", col, text, "row" = 0 OR col = 1 AS is_header FROM table_cells'))
def n5(spark, folder):
    return S.table_cells(spark, folder).select("tbl", "row", "col", "text", ((c("row") == 0) | (c("col") == 1)).alias("is_header"))


@query("n18_review_ids", with_frames("page_elements", "SELECT doc, pos, 'review-' || pos::VARCHAR AS review_id FROM page_elements"))
def n18(spark, folder):
    return S.page_elements(spark, folder).select("doc", "pos", F.concat(F.lit("review-"), c("pos").cast("string")).alias("review_id"))


@query("n19_header_flags", with_frames("table_cells", 'SELECT tbl, count(*) FILTER (("row" = 0) <> (q > 25)) AS changed FROM table_cells GROUP BY tbl'))
def n19(spark, folder):
    return S.table_cells(spark, folder).groupBy("tbl").agg(F.count_if((c("row") == 0) != (c("q") > 25)).alias("changed"))


@query("n26_expected_pages", with_frames("blocks", "SELECT page, pos FROM blocks WHERE page IN (1, 3, 5, 7) AND trim(text) <> ''"))
def n26(spark, folder):
    return S.blocks(spark, folder).where("page in (1, 3, 5, 7) and trim(text) <> ''").select("page", "pos")


@query("frontend_partition", with_frames("review_tasks", "SELECT CASE WHEN blocking THEN 'blocking' WHEN severity = 'low' THEN 'optional' ELSE 'open' END AS list, count(*) AS n FROM review_tasks GROUP BY ALL"))
def front(spark, folder):
    kind = F.when(c("blocking"), "blocking").when(c("severity") == "low", "optional").otherwise("open")
    return S.review_tasks(spark, folder).groupBy(kind.alias("list")).agg(F.count(F.lit(1)).alias("n"))


# How urgent a change's status is.
_STATUS_RANK = {"needs_remediation": 0, "manual_remediated": 1, "auto_remediated": 2}


@query("frontend_status_order", with_frames("violations", """, s AS (SELECT doc, event_id, ['auto_remediated', 'needs_remediation', 'manual_remediated'][event_id % 3 + 1] AS status FROM violations)
    SELECT doc, event_id, status, (row_number() OVER (PARTITION BY doc ORDER BY CASE status WHEN 'needs_remediation' THEN 0 WHEN 'manual_remediated' THEN 1 ELSE 2 END, event_id))::INT AS place FROM s"""))
def front_order(spark, folder):
    """Changes of a document, those that need work first, in their own order among equals."""
    kind = F.element_at(F.array(*map(F.lit, ("auto_remediated", "needs_remediation", "manual_remediated"))), (c("event_id") % 3 + 1).cast("int"))
    rank = F.create_map(*[F.lit(x) for kv in _STATUS_RANK.items() for x in kv])[c("status")]
    rows = S.violations(spark, folder).select("doc", "event_id", kind.alias("status"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(rank, "event_id")))


@query("frontend_pending", with_frames("review_tasks", "SELECT task_id, job_id, task_type FROM review_tasks t WHERE NOT blocking AND NOT EXISTS (SELECT 1 FROM review_tasks p WHERE p.blocking AND p.job_id = t.job_id AND p.task_type = t.task_type)"))
def front_pending(spark, folder):
    """Changes of a kind that no pending task of the job holds already: one scan of the tasks on either side of an anti join."""
    tasks = S.review_tasks(spark, folder)
    pending = tasks.where("blocking").select("job_id", "task_type")
    return tasks.where("not blocking").join(pending, ["job_id", "task_type"], "left_anti").select("task_id", "job_id", "task_type")
