"""Queries of lane plans, overlays, reconciliations, trees, folds and compositions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliolens.functions import geometry as G
from foliolens.functions import text as T
from foliolens.functions.similarity import with_similarity
from foliolens.operators.assignment import best_assignment
from foliolens.operators.clusters import greedy_rows
from foliolens.operators.places import with_places
from foliolens.operators.spatial import overlapping
from foliolens.plans.joins import _A, _O, _SCORE, _boxed
from foliolens.plans.registry import query
from foliolens.plans.scalars import _c, _n, _words
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames

c = F.col


def joined_when(*parts):
    """The texts of the conditions that hold, in order."""
    return F.array_join(F.filter(F.array(*[F.when(p, F.lit(t)) for p, t in parts]), lambda x: x.isNotNull()), ",")


def text_signals(x):
    """What makes a block's text look wrong, comma-joined; empty if nothing does."""
    tokens = F.regexp_count(x, F.lit("[A-Za-z]+"))
    letters = F.length(F.regexp_replace(x, "[^A-Za-z]+", ""))
    return joined_when(
        (F.rlike(x, F.lit(r"(^|\s)([A-Za-z]\s){4,}[A-Za-z](\s|$)")), "spaced letters"), ((tokens >= 6) & (letters <= 1.6 * tokens), "short tokens"),
        (F.rlike(x, F.lit(r"\p{IsLatin}")) & F.rlike(x, F.lit(r"[\p{IsCyrillic}\p{IsHan}\p{IsArabic}]")), "mixed scripts"))


@query("p2_job_projection", with_frames("job_steps", "SELECT job_id, string_agg(step, '>' ORDER BY CASE step WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END, step) AS steps FROM (SELECT DISTINCT job_id, step FROM job_steps) GROUP BY job_id"))
def p2(spark, folder):
    order = F.create_map(*[F.lit(x) for kv in (("view", 1), ("click", 2), ("signup", 3), ("purchase", 4)) for x in kv])
    steps = S.table(spark, folder, "events").select(c("user_id").alias("job_id"), F.struct(F.coalesce(order[c("event_type")], F.lit(5)).alias("o"), c("event_type").alias("s")).alias("x"))
    return steps.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("x")), lambda x: x["s"]), ">").alias("steps"))


@query("p9_ocr_scan", "SELECT p_partkey, (p_type = 'ECONOMY' AND p_size / 50.0 >= 0.9 AND (p_partkey % 5) / 4.0 >= 0.75) AS ocr_scan FROM part")
def p9(spark, folder):
    return S.table(spark, folder, "part").select("p_partkey", ((c("p_type") == "ECONOMY") & (c("p_size") / 50.0 >= 0.9) & ((c("p_partkey") % 5) / 4.0 >= 0.75)).alias("ocr_scan"))


@query("p26_table_auto_apply", "SELECT p_partkey FROM part WHERE p_size % 3 = 0 AND p_partkey % 4 IN (1, 2)")
def p26(spark, folder):
    confidence = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), c("p_size") % 3 + 1)
    action = F.element_at(F.array(*map(F.lit, ["manual_only", "set_table_headers", "confirm_current_headers", "none"])), (c("p_partkey") % 4 + 1).cast("int"))
    return S.table(spark, folder, "part").where((confidence == "high") & action.isin("set_table_headers", "confirm_current_headers")).select("p_partkey")


@query("p27_form_auto_apply", "SELECT p_partkey FROM part WHERE p_size % 3 = 0 AND contains(p_name, ' ') AND p_partkey % 4 <> 0")
def p27(spark, folder):
    current = F.when(c("p_partkey") % 4 == 0, c("p_name")).otherwise("")
    good = T.label_quality(c("p_name"), c("p_brand")) == "good"
    return S.table(spark, folder, "part").where((c("p_size") % 3 == 0) & (T.collapsed(c("p_name")) != "") & (F.length("p_name") <= 400) & good & (current != c("p_name"))).select("p_partkey")


@query("p30_confirm_existing", "SELECT p_partkey, (p_size % 2 = 0 AND p_size > 10 AND p_partkey % 5 <> 0) AS retry FROM part")
def p30(spark, folder):
    reasons = F.filter(F.array(F.when(c("p_size") > 10, F.lit("large table matrix")), F.when(c("p_partkey") % 5 == 0, F.lit("weak header signal"))), lambda x: x.isNotNull())
    allowed = F.array(*map(F.lit, ["merged cells or spans present", "large table matrix", "very dense table", "multi-level header pattern"]))
    headers = F.when(c("p_size") % 2 == 0, F.array(F.lit(0))).otherwise(F.expr("cast(array() as array<int>)"))
    return S.table(spark, folder, "part").select("p_partkey", ((F.size(headers) > 0) & (F.size(reasons) > 0) & (F.size(F.array_except(reasons, allowed)) == 0)).alias("retry"))


@query("p32_spacing_only", "SELECT p_partkey, (p_partkey % 3 <> 2 AND length(p_name) <= 64) AS apply FROM part")
def p32(spark, folder):
    tight = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    other = F.when(c("p_partkey") % 3 == 0, F.upper(F.regexp_replace("p_name", " ", "  "))).when(c("p_partkey") % 3 == 1, c("p_name")).otherwise(F.concat("p_name", F.lit("x")))
    return S.table(spark, folder, "part").select("p_partkey", ((F.length("p_name") <= 64) & (tight(c("p_name")) != "") & (tight(c("p_name")) == tight(other))).alias("apply"))


@query("p41_suppress_child_ui", "SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND regexp_matches(lower(p_name), '\\b(ring|widget)\\b') AND length(p_name) <= 80")
def p41(spark, folder):
    return S.table(spark, folder, "part").where((c("p_size") % 2 == 0) & F.rlike(F.lower("p_name"), F.lit(r"\b(ring|widget)\b")) & (F.length("p_name") <= 80)).select("p_partkey")


@query("p42_single_followup", "SELECT p_partkey, (p_size % 3 = 2 OR p_partkey % 4 = 1 OR (p_partkey % 4 = 2 AND p_size % 5 = 0)) AS followup FROM part")
def p42(spark, folder):
    alt = F.when(c("p_size") % 5 == 0, " ").otherwise(c("p_name"))
    return S.table(spark, folder, "part").select("p_partkey", ((c("p_size") % 3 == 2) | (c("p_partkey") % 4 == 1) | ((c("p_partkey") % 4 == 2) & (F.trim(alt) == ""))).alias("followup"))


@query("p48_task_defaults", with_frames("review_tasks", "SELECT task_id, CASE WHEN severity = 'low' THEN 'medium' ELSE severity END AS severity, coalesce(CASE WHEN task_id % 2 = 0 THEN blocking END, true) AS blocking FROM review_tasks"))
def p48(spark, folder):
    return S.review_tasks(spark, folder).select("task_id", F.coalesce(F.nullif(c("severity"), F.lit("low")), F.lit("medium")).alias("severity"), F.coalesce(F.when(c("task_id") % 2 == 0, c("blocking")), F.lit(True)).alias("blocking"))


@query("p50_safe_label", "SELECT conv_id, turn, " + rf"({_c('text')} <> '' AND length({_c('text')}) <= 160 AND {_words('text')} <= 18 AND NOT regexp_matches({_c('text')}, '[.!?]\s+[A-Z]') AND regexp_matches({_c('text')}, '\p{{L}}')) AS safe FROM conversations")
def p50(spark, folder):
    x = T.collapsed(c("text"))
    return S.table(spark, folder, "conversations").select("conv_id", "turn", ((x != "") & (F.length(x) <= 160) & (T.word_count(c("text")) <= 18) & ~F.rlike(x, F.lit(r"[.!?]\s+[A-Z]")) & F.rlike(x, F.lit(r"\p{L}"))).alias("safe"))


# Joins.
@query("j8_update_cells", with_frames("table_cells", """SELECT tbl, string_agg(text || CASE WHEN "row" = h THEN '*' ELSE '' END, ',' ORDER BY col) AS cells FROM table_cells LEFT JOIN (SELECT o_orderkey, (o_orderkey % 3)::INT AS h FROM orders WHERE o_orderstatus = 'F') ON tbl = o_orderkey GROUP BY tbl"""))
def j8(spark, folder):
    headers = S.table(spark, folder, "orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("tbl"), (c("o_orderkey") % 3).cast("int").alias("h"))
    tables = S.table_cells(spark, folder).groupBy("tbl").agg(F.array_sort(F.collect_list(F.struct("col", "row", "text"))).alias("cells"))
    marked = F.transform("cells", lambda x: F.concat(x["text"], F.when(x["row"] == c("h"), "*").otherwise("")))
    return tables.join(headers, "tbl", "left").select("tbl", F.array_join(marked, ",").alias("cells"))


@query("j11_order_overlay", with_frames("blocks", "SELECT page, CASE WHEN page % 3 = 0 THEN string_agg(role, ',' ORDER BY pos DESC) ELSE string_agg(role, ',' ORDER BY pos) END AS roles FROM blocks GROUP BY page"))
def j11(spark, folder):
    """An overlay reorders a page only where it names exactly the page's blocks."""
    rows = S.blocks(spark, folder).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "role"))).alias("a"))
    overlay = F.when(c("page") % 3 == 0, F.reverse(F.transform("a", lambda x: x["pos"]))).otherwise(F.array(F.lit(-1).cast("bigint")))
    same = F.array_sort(overlay) == F.transform("a", lambda x: x["pos"])
    return rows.select("page", F.array_join(F.transform(F.when(same, F.reverse("a")).otherwise(c("a")), lambda x: x["role"]), ",").alias("roles"))


@query("j12_table_overlay", with_frames("table_cells", "SELECT tbl, count(*) AS cells, count(*) FILTER (p_size > 25) AS headers FROM table_cells LEFT JOIN part ON p_partkey = tbl GROUP BY tbl"))
def j12(spark, folder):
    cells = S.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber").distinct().groupBy(c("l_orderkey").alias("tbl")).agg(F.count(F.lit(1)).alias("cells"))
    size = S.table(spark, folder, "part").select(c("p_partkey").alias("tbl"), "p_size")
    return cells.join(size, "tbl", "left").select("tbl", "cells", F.when(c("p_size") > 25, c("cells")).otherwise(0).alias("headers"))


@query("j13_table_decisions", with_frames("table_cells", "SELECT tbl, count(*) FILTER (\"row\" = 0 AND tbl % 2 = 0) AS header_cells FROM table_cells GROUP BY tbl HAVING count(*) > 1"))
def j13(spark, folder):
    return S.table_cells(spark, folder).groupBy("tbl").agg(F.count_if((c("row") == 0) & (c("tbl") % 2 == 0)).alias("header_cells"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


@query("j14_text_hints", "SELECT conv_id, turn, coalesce(i.text, '') AS hint FROM conversations LEFT JOIN benchmark i ON i.item_id = conv_id AND turn = 0")
def j14(spark, folder):
    hints = S.table(spark, folder, "benchmark").select(c("item_id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), c("text").alias("hint"))
    return S.table(spark, folder, "conversations").join(hints, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("hint", F.lit("")).alias("hint"))


@query("j16_heading_lookup", "SELECT p_partkey, k AS target FROM part LEFT JOIN (SELECT lower(p_name) AS n, min(p_partkey) AS k FROM part WHERE p_size > 30 GROUP BY 1) ON lower(p_name) = n")
def j16(spark, folder):
    part = S.table(spark, folder, "part").select("p_partkey", T.title_like(c("p_name")).alias("n"), "p_size")
    return part.join(part.where("p_size > 30").groupBy("n").agg(F.min("p_partkey").alias("target")), "n", "left").select("p_partkey", "target")


@query("j19_interleave", "SELECT kind, id, (row_number() OVER (ORDER BY anchor, kind_rank, id))::INT AS place FROM (SELECT 'region' AS kind, r_regionkey AS id, r_regionkey AS anchor, 0 AS kind_rank FROM region UNION ALL SELECT 'nation', n_nationkey, n_regionkey, 1 FROM nation)")
def j19(spark, folder):
    """Children after their anchor, in order; places are counted within an anchor and added to the anchors' sizes before, so no task sorts all rows."""
    rows = S.table(spark, folder, "region").select(F.lit("region").alias("kind"), c("r_regionkey").alias("id"), c("r_regionkey").alias("anchor"), F.lit(0).alias("k")).unionByName(
        S.table(spark, folder, "nation").select(F.lit("nation").alias("kind"), c("n_nationkey").alias("id"), c("n_regionkey").alias("anchor"), F.lit(1).alias("k")))
    before = with_places(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "anchor", "n").select("anchor", c("place").alias("before"))
    w = Window.partitionBy("anchor").orderBy("k", "id")
    return rows.withColumn("r", F.row_number().over(w)).join(before, "anchor").select("kind", "id", (c("before") + c("r")).cast("int").alias("place"))


@query("j22_probe_margins", with_frames("boxes", f"SELECT a.box, count(o.box) AS hits FROM boxes a LEFT JOIN boxes o ON a.page = o.page AND a.box <> o.box AND {_boxed} > 0 GROUP BY a.box"))
def j22(spark, folder):
    b = S.boxes(spark, folder)
    return b.select("box").join(overlapping(b).groupBy("box").agg(F.count(F.lit(1)).alias("hits")), "box", "left").select("box", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("j23_runs_to_elements", with_frames("boxes", f"SELECT target, arg_max(box, {{'s': score, 'i': -box}}) AS box FROM (SELECT a.box AS target, o.box, {_SCORE} AS score FROM boxes a JOIN boxes o ON a.page = o.page AND a.box % 2 = 0 AND o.box % 2 = 1 WHERE {_boxed} > 0) GROUP BY target"))
def j23(spark, folder):
    a, o = G.box(), G.box("o_")
    score = F.greatest(G.iou(a, o), G.containment(a, o), G.containment(o, a))
    pairs = overlapping(S.boxes(spark, folder)).where("box % 2 = 0 and o_box % 2 = 1").select(c("box").alias("target"), c("o_box").alias("box"), score.alias("score"))
    return pairs.groupBy("target").agg(F.max_by("box", F.struct("score", -c("box"))).alias("box"))


@query("j24_runs_to_cells", with_frames("boxes", f"SELECT target, arg_max(box, {{'s': score, 'i': -box}}) AS box FROM (SELECT a.box AS target, o.box, {_boxed} / {_A} AS score FROM boxes a JOIN boxes o ON a.page = o.page AND a.box % 3 = 0 AND o.box % 3 <> 0 WHERE {_boxed} > 0) GROUP BY target"))
def j24(spark, folder):
    a, o = G.box(), G.box("o_")
    pairs = overlapping(S.boxes(spark, folder)).where("box % 3 = 0 and o_box % 3 <> 0").select(c("box").alias("target"), c("o_box").alias("box"), G.containment(a, o).alias("score"))
    return pairs.groupBy("target").agg(F.max_by("box", F.struct("score", -c("box"))).alias("box"))


@query("j26_link_words", with_frames("boxes", f"SELECT a.box, string_agg(o.box::VARCHAR, ' ' ORDER BY o.t DESC, o.l, o.box) AS words, min(o.l) AS l, max(o.r) AS r FROM boxes a JOIN boxes o ON a.page = o.page AND a.box <> o.box WHERE {_boxed} > 0 GROUP BY a.box"))
def j26(spark, folder):
    lists = overlapping(S.boxes(spark, folder)).groupBy("box").agg(F.array_sort(F.collect_list(F.struct((-c("o_t")).alias("t"), "o_l", "o_box"))).alias("a"), F.min("o_l").alias("l"), F.max("o_r").alias("r"))
    return lists.select("box", F.array_join(F.transform("a", lambda x: x["o_box"].cast("string")), " ").alias("words"), "l", "r")


@query("j29_close_fields", with_frames("boxes", """SELECT box, near FROM (SELECT a.box, o.box AS near, row_number() OVER (PARTITION BY a.box ORDER BY (a.l - o.l) * (a.l - o.l) + (a.b - o.b) * (a.b - o.b), o.box) AS k FROM boxes a JOIN boxes o ON a.page = o.page AND a.box <> o.box AND abs(a.box - o.box) <= 30) WHERE k <= 6"""))
def j29(spark, folder):
    a = S.boxes(spark, folder).select("page", "box", "l", "b")
    # Orders within 30: an equi-join on bands of 31, each box also probing its neighbours.
    probe = a.withColumn("band", F.explode(F.array(*[F.floor(c("box") / 31) + i for i in (-1, 0, 1)])))
    other = a.select("page", c("box").alias("near"), c("l").alias("ol"), c("b").alias("ob"), F.floor(c("box") / 31).alias("band"))
    pairs = probe.join(other, ["page", "band"]).where("box <> near and abs(box - near) <= 30")
    rank = F.row_number().over(Window.partitionBy("box").orderBy((c("l") - c("ol")) * (c("l") - c("ol")) + (c("b") - c("ob")) * (c("b") - c("ob")), "near"))
    return pairs.withColumn("k", rank).where("k <= 6").select("box", "near")


@query("j30_widget_targets", "SELECT p_partkey, p_size AS page FROM part WHERE 1 = 0")
def j30(spark, folder):
    """The heuristic that proposes candidates is switched off in this contract, so there are none to join."""
    return S.table(spark, folder, "part").where(F.lit(False)).select("p_partkey", c("p_size").alias("page"))


@query("j31_missing_figures", with_frames("boxes, blocks", """SELECT page, biggest, n_blocks FROM (SELECT page FROM boxes UNION SELECT page FROM blocks) LEFT JOIN (SELECT page, max((r - l) * (t - b)) AS biggest FROM boxes GROUP BY 1) USING (page) LEFT JOIN (SELECT page, count(*) AS n_blocks FROM blocks GROUP BY 1) USING (page) WHERE page NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')"""))
def j31(spark, folder):
    boxes = S.boxes(spark, folder).groupBy(c("page").cast("bigint").alias("page")).agg(F.max((c("r") - c("l")) * (c("t") - c("b"))).alias("biggest"))
    blocks = S.blocks(spark, folder).groupBy("page").agg(F.count(F.lit(1)).alias("n_blocks"), F.bool_or(c("role") == "system").alias("ignored"))
    return boxes.join(blocks, "page", "full_outer").where(~F.coalesce("ignored", F.lit(False))).select("page", "biggest", "n_blocks")


@query("j32_requested_tables", with_frames("table_cells", "SELECT place, tbl, count(*) AS cells FROM (SELECT unnest(range(1, 9))::INT AS place, unnest([7, 3, 1000, 3, 11, 4, 99999999, 5])::BIGINT AS tbl) JOIN table_cells USING (tbl) GROUP BY ALL ORDER BY place LIMIT 5"))
def j32(spark, folder):
    asked = spark.createDataFrame([(i + 1, t) for i, t in enumerate([7, 3, 1000, 3, 11, 4, 99999999, 5])], "place int, tbl bigint")
    return S.table_cells(spark, folder).join(F.broadcast(asked), "tbl").groupBy("place", "tbl").agg(F.count(F.lit(1)).alias("cells")).orderBy("place").limit(5)


@query("j33_reconcile", with_frames("violations", "SELECT doc, count(DISTINCT rule_id) FILTER (event_id % 2 = 0) = 5 AND count(DISTINCT rule_id) FILTER (event_id % 2 = 1) = 5 AS complete, count(DISTINCT rule_id) AS rules FROM violations GROUP BY doc"))
def j33(spark, folder):
    per = S.violations(spark, folder).groupBy("doc", "rule_id").agg(F.bool_or(c("event_id") % 2 == 0).alias("a"), F.bool_or(c("event_id") % 2 == 1).alias("b"))
    return per.groupBy("doc").agg(((F.count_if("a") == 5) & (F.count_if("b") == 5)).alias("complete"), F.count(F.lit(1)).alias("rules"))


@query("j34_applicable", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 50 = p_size AND (s_nationkey % 2 = 0 OR s_nationkey % 25 = p_partkey % 25))")
def j34(spark, folder):
    """A null in a candidate matches any font: two equi semi joins, one on the page alone, one on page and font."""
    part = S.table(spark, folder, "part").select("p_partkey", c("p_size").cast("bigint").alias("page"), (c("p_partkey") % 25).alias("font"))
    cand = S.table(spark, folder, "supplier").select((c("s_suppkey") % 50).alias("page"), F.when(c("s_nationkey") % 2 != 0, c("s_nationkey") % 25).cast("bigint").alias("font"))
    anywhere = part.join(cand.where("font is null").select("page"), "page", "left_semi")
    exact = part.join(cand.where("font is not null"), ["page", "font"], "left_semi")
    return anywhere.select("p_partkey").union(exact.select("p_partkey")).distinct()


# Trees, folds, aggregates.
@query("g11_tree_histogram", "WITH RECURSIVE tree AS (SELECT r_regionkey AS id, 0 AS depth, 'region' AS kind FROM region UNION ALL SELECT n_nationkey, depth + 1, 'nation' FROM nation JOIN tree ON n_regionkey = id AND kind = 'region') SELECT kind, depth, count(*) AS n FROM tree GROUP BY ALL")
def g11(spark, folder):
    S.table(spark, folder, "region").createOrReplaceTempView("_tree_region")
    S.table(spark, folder, "nation").createOrReplaceTempView("_tree_nation")
    return spark.sql("""WITH RECURSIVE tree AS (SELECT r_regionkey AS id, 0 AS depth, 'region' AS kind FROM _tree_region
        UNION ALL SELECT n_nationkey, depth + 1, 'nation' FROM _tree_nation JOIN tree ON n_regionkey = id AND kind = 'region') SELECT kind, depth, count(*) AS n FROM tree GROUP BY kind, depth""")


@query("n3_walk_tree", "SELECT n_nationkey AS node, '/' || r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def n3(spark, folder):
    S.table(spark, folder, "region").createOrReplaceTempView("_walk_region")
    S.table(spark, folder, "nation").createOrReplaceTempView("_walk_nation")
    return spark.sql("""WITH RECURSIVE walk AS (SELECT r_regionkey AS node, concat('/', r_name) AS path, 0 AS depth FROM _walk_region
        UNION ALL SELECT n_nationkey, concat(path, '/', n_name), depth + 1 FROM _walk_nation JOIN walk ON n_regionkey = node AND depth = 0) SELECT node, path FROM walk WHERE depth = 1""")


@query("s20_outline_titles", "SELECT r_name || ' > ' || string_agg(n_name, ',' ORDER BY n_nationkey) AS outline FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def s20(spark, folder):
    children = S.table(spark, folder, "nation").groupBy(c("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a"))
    return S.table(spark, folder, "region").join(children, "r_regionkey").select(F.concat("r_name", F.lit(" > "), F.array_join(F.transform("a", lambda x: x["n_name"]), ",")).alias("outline"))


@query("g12_tag_coverage", with_frames("page_elements", "SELECT tag, count(*) AS n, count(DISTINCT doc) AS docs FROM page_elements GROUP BY tag"))
def g12(spark, folder):
    per = S.page_elements(spark, folder).groupBy("tag", "doc").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("tag").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("g21_adjudication", with_frames("review_tasks", "SELECT job_id, CASE WHEN count(*) FILTER (blocking) = 0 THEN 'removed' ELSE 'upgraded' END AS outcome, array_to_string(list_sort(coalesce(list(DISTINCT task_type) FILTER (blocking), [])), ',') AS issues FROM review_tasks GROUP BY job_id"))
def g21(spark, folder):
    return S.review_tasks(spark, folder).groupBy("job_id").agg(
        F.when(F.count_if("blocking") == 0, "removed").otherwise("upgraded").alias("outcome"), F.array_join(F.array_sort(F.collect_set(F.when(c("blocking"), c("task_type")))), ",").alias("issues"))


@query("g36_font_ranking", with_frames("violations", "SELECT doc, count(*) FILTER (severity = 'error') AS errors, sum(count)::BIGINT AS weight FROM violations GROUP BY doc ORDER BY errors DESC, weight DESC, doc LIMIT 24"))
def g36(spark, folder):
    return S.violations(spark, folder).groupBy("doc").agg(F.count_if(c("severity") == "error").alias("errors"), F.sum("count").alias("weight")).orderBy(F.desc("errors"), F.desc("weight"), "doc").limit(24)


@query("g42_kind_histogram", with_frames("blocks", "SELECT role AS kind, count(*) AS n FROM blocks GROUP BY role"))
def g42(spark, folder):
    return S.blocks(spark, folder).groupBy(c("role").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("w26_title_candidates", with_frames("doc_lines", "SELECT doc_id, pos FROM doc_lines WHERE length(line) BETWEEN 4 AND 80 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 3"))
def w26(spark, folder):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return S.doc_lines(spark, folder).where(F.length("line").between(4, 80)).withColumn("k", F.row_number().over(w)).where("k <= 3").select("doc_id", "pos")


@query("w10_rebuild_rows")
def w10(spark, folder):
    """Rows of words rebuilt page by page by the greedy machine; rows only: each choice depends on those before."""
    words = S.boxes(spark, folder).select("page", c("box").cast("int").alias("pos"), ((c("t") + c("b")) / 2).alias("y"), c("l").alias("x"), c("box").cast("string").alias("text"))
    return greedy_rows(words, 12.0)


@query("w11_cluster_words")
def w11(spark, folder):
    words = S.boxes(spark, folder).select("page", c("box").cast("int").alias("pos"), ((c("t") + c("b")) / 2).alias("y"), c("l").alias("x"), c("box").cast("string").alias("text"))
    return greedy_rows(words)


@query("j21_optimal_match")
def j21(spark, folder):
    """One-to-one assignment of even boxes to odd ones of a page by overlap."""
    pairs = overlapping(S.boxes(spark, folder)).where("box % 2 = 0 and o_box % 2 = 1").select("page", c("box").alias("a"), c("o_box").alias("b"), G.iou(G.box(), G.box("o_")).alias("score"))
    return best_assignment(pairs)


@query("x4_text_similarity")
def x4(spark, folder):
    """Indel and matching-blocks ratios of passages and the turns of their conversations."""
    gold = S.table(spark, folder, "benchmark").select(c("item_id").alias("conv_id"), c("text").alias("a"))
    pairs = S.table(spark, folder, "conversations").select("conv_id", "turn", c("text").alias("b")).join(gold, "conv_id")
    return with_similarity(pairs, "a", "b").select("conv_id", "turn", F.round("indel", 6).alias("indel"), F.round("sequence", 6).alias("sequence"))


@query("t6_retry_improved", with_frames("review_tasks", "SELECT job_id, count(*) FILTER (blocking AND task_id % 2 = 0) < count(*) FILTER (blocking AND task_id % 2 = 1) AS improved FROM review_tasks GROUP BY job_id"))
def t6(spark, folder):
    return S.review_tasks(spark, folder).groupBy("job_id").agg((F.count_if(c("blocking") & (c("task_id") % 2 == 0)) < F.count_if(c("blocking") & (c("task_id") % 2 == 1))).alias("improved"))


@query("t13_toc_bookmarks", with_frames("page_elements", "SELECT e.doc, e.pos, h.pos AS heading, 2 AS level FROM page_elements e LEFT JOIN (SELECT doc, min(pos) AS pos FROM page_elements WHERE type = 'heading' GROUP BY doc) h USING (doc) WHERE e.type = 'list_item'"))
def t13(spark, folder):
    e = S.page_elements(spark, folder)
    heads = e.groupBy("doc").agg(F.min(F.when(c("type") == "heading", c("pos"))).alias("heading"))
    return e.where("type = 'list_item'").join(heads, "doc", "left").select("doc", "pos", "heading", F.lit(2).alias("level"))


# Text and nested values.
@query("f11_ordered_parts", f"SELECT doc_id, regexp_matches({_n('text')}, 'the.*of.*in') AS present FROM documents")
def f11(spark, folder):
    """Parts found one after the other, by a fold whose state is where the next may begin (0: none left)."""
    docs, text = S.table(spark, folder, "documents").select("doc_id", T.normalized(c("text")).alias("n")), c("n")
    at = F.aggregate(F.array(F.lit("the"), F.lit("of"), F.lit("in")), F.lit(1), lambda k, p: F.when((k > 0) & (F.position(p, text, k) > 0), F.position(p, text, k) + F.length(p)).otherwise(0))
    return docs.select("doc_id", (at > 0).alias("present"))


@query("f12_normalize_terms", "SELECT p_partkey, array_to_string(list_filter(list_transform([p_name, ' ', p_brand], lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> ''), '|') AS terms FROM part")
def f12(spark, folder):
    return S.table(spark, folder, "part").select("p_partkey", F.array_join(F.filter(F.transform(F.array("p_name", F.lit(" "), "p_brand"), T.normalized), lambda x: x != ""), "|").alias("terms"))


_TAGS = ["en_us", "DE", "zh-hans-cn", "fra", "x1", "pt-br", ""]
_NORMAL = ["en-US", "de", "zh-Hans-CN", "fr", None, "pt-BR", None]


@query("f15_language_tag", "SELECT p_partkey, [" + ", ".join("NULL" if x is None else f"'{x}'" for x in _NORMAL) + "][(p_partkey % 7 + 1)::INT] AS tag FROM part")
def f15(spark, folder):
    """Primary subtag in lower case (three-letter codes mapped), scripts in title case, regions in upper case; null where malformed."""
    raw = F.regexp_replace(F.element_at(F.array(*map(F.lit, _TAGS)), (c("p_partkey") % 7 + 1).cast("int")), "_", "-")
    three = F.create_map(*[F.lit(x) for kv in (("fra", "fr"), ("deu", "de"), ("eng", "en"), ("spa", "es")) for x in kv])
    parts = F.split(F.lower(raw), "-")
    head = F.coalesce(three[F.element_at(parts, 1)], F.element_at(parts, 1))
    rest = F.transform(F.slice(parts, 2, 9), lambda x: F.when(F.length(x) == 4, F.initcap(x)).when(F.length(x) == 2, F.upper(x)).otherwise(x))
    tag = F.array_join(F.concat(F.array(head), rest), "-")
    return S.table(spark, folder, "part").select("p_partkey", F.when(F.rlike(tag, F.lit("^[a-z]{2,3}(-[A-Za-z0-9]{2,8})*$")), tag).alias("tag"))


@query("f24_title_prefix", "SELECT doc_id, lower(regexp_replace(string_split(text, chr(10))[1], '[^A-Za-z0-9]+', '', 'g')) AS first_line FROM documents")
def f24(spark, folder):
    return S.table(spark, folder, "documents").select("doc_id", T.fingerprint(F.element_at(F.split("text", "\n"), 1)).alias("first_line"))


@query("f31_supported_labels", "SELECT p_partkey, CASE WHEN lower(p_name) = lower(p_brand) THEN p_name ELSE p_name || '|' || p_brand END AS labels FROM part")
def f31(spark, folder):
    labels = F.array("p_name", F.upper("p_name"), "p_brand")
    distinct = F.filter(labels, lambda x, i: F.array_position(F.transform(labels, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return S.table(spark, folder, "part").select("p_partkey", F.array_join(distinct, "|").alias("labels"))


@query("f32_text_signals", rf"""SELECT conv_id, turn, concat_ws(',', CASE WHEN regexp_matches({_c('text')}, '(^|\s)([A-Za-z]\s){{4,}}[A-Za-z](\s|$)') THEN 'spaced letters' END,
    CASE WHEN len(regexp_extract_all({_c('text')}, '[A-Za-z]+')) >= 6 AND length(regexp_replace({_c('text')}, '[^A-Za-z]+', '', 'g')) <= 1.6 * len(regexp_extract_all({_c('text')}, '[A-Za-z]+')) THEN 'short tokens' END,
    CASE WHEN regexp_matches({_c('text')}, '\p{{Latin}}') AND regexp_matches({_c('text')}, '[\p{{Cyrillic}}\p{{Han}}\p{{Arabic}}]') THEN 'mixed scripts' END) AS signals FROM conversations""")
def f32(spark, folder):
    return S.table(spark, folder, "conversations").select("conv_id", "turn", text_signals(T.collapsed(c("text"))).alias("signals"))


@query("f40_context_path", "SELECT p_partkey, (p_size + 1)::INT AS page, CASE WHEN p_size % 2 = 0 THEN (p_partkey % 9)::INT END AS annotation, (p_partkey % 17)::INT AS operator FROM part")
def f40(spark, folder):
    path = F.concat(F.lit("root/document[0]/pages["), c("p_size").cast("string"), F.lit("]/"), F.when(c("p_size") % 2 == 0, F.concat(F.lit("annots["), (c("p_partkey") % 9).cast("string"), F.lit("]/"))).otherwise(""), F.lit("contentStream[0]/operators["), (c("p_partkey") % 17).cast("string"), F.lit("]"))
    part = lambda name: F.nullif(F.regexp_extract(path, rf"{name}\[(\d+)\]", 1), F.lit("")).cast("int")
    return S.table(spark, folder, "part").select("p_partkey", (part("pages") + 1).alias("page"), part("annots").alias("annotation"), part("operators").alias("operator"))


@query("f42_code_resolution", "SELECT p_partkey, p_size % 3 = 0 AS is_code FROM part")
def f42(spark, folder):
    code = F.when(c("p_size") % 3 == 0, F.concat(F.lit("1: def "), c("p_type"), F.lit("():\n2:   return [1]"))).otherwise(c("p_name"))
    lines = F.filter(F.split(T.code_without_line_numbers(code), "\n"), lambda x: F.trim(x) != "")
    marked = F.filter(lines, lambda x: F.rlike(x, F.lit(r"\b(def|for|if|return|class|with|import)\b|[#=\[\](){}:]")))
    return S.table(spark, folder, "part").select("p_partkey", (F.size(lines).between(2, 40) & (F.size(marked) >= 2)).alias("is_code"))


@query("n8_rule_summaries", """SELECT event_id, event_type AS rule, (event_id % 3 + 1)::INT AS failed FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type, (event_id % 3 + 2)::INT FROM events""")
def n8(spark, folder):
    """A report whose result is an object or a list of objects, exploded to rule summaries."""
    rule = lambda k: F.concat(F.lit('{"rule":"'), c("event_type"), F.lit('","failed":'), (c("event_id") % 3 + k).cast("string"), F.lit("}"))
    report = F.when(c("event_id") % 2 == 0, F.concat(F.lit('{"result":['), rule(1), F.lit(","), rule(2), F.lit("]}"))).otherwise(F.concat(F.lit('{"result":'), rule(2), F.lit("}")))
    got = F.get_json_object(report, "$.result")
    listed = F.from_json(F.when(got.startswith("["), got).otherwise(F.concat(F.lit("["), got, F.lit("]"))), "array<struct<rule:string,failed:int>>")
    return S.table(spark, folder, "events").select("event_id", F.explode(listed).alias("x")).select("event_id", "x.rule", "x.failed")


@query("n11_change_payload", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS before, event_type AS after FROM events")
def n11(spark, folder):
    return S.table(spark, folder, "events").select("event_id", F.coalesce(F.from_json("props", "map<string,string>")["k"], F.lit("")).alias("before"), c("event_type").alias("after"))


@query("n12_order_decision", "SELECT p_partkey, array_to_string(list_filter([trim(p_name), trim(p_brand), ''], lambda x: x <> ''), ',') AS ids FROM part")
def n12(spark, folder):
    return S.table(spark, folder, "part").select("p_partkey", F.array_join(F.filter(F.transform(F.array("p_name", "p_brand", F.lit(" ")), lambda x: F.trim(x)), lambda x: x != ""), ",").alias("ids"))


@query("n15_page_batches", with_frames("blocks", "SELECT page, (pos // 3)::BIGINT AS batch, count(*) AS n FROM blocks GROUP BY ALL"))
def n15(spark, folder):
    return S.blocks(spark, folder).groupBy("page", F.floor(c("pos") / 3).alias("batch")).agg(F.count(F.lit(1)).alias("n"))


@query("n17_sanitized", "SELECT conv_id, turn, role FROM conversations")
def n17(spark, folder):
    whole = F.struct("conv_id", "turn", "role", "text").alias("s")
    return S.table(spark, folder, "conversations").select(whole).select(c("s").dropFields("text").alias("s")).select("s.*")


@query("n20_retype", with_frames("page_elements", "SELECT doc, pos, CASE WHEN pos % 4 = 0 AND type = 'list_item' THEN 'toc_item' ELSE type END AS type FROM page_elements"))
def n20(spark, folder):
    chosen = (c("pos") % 4 == 0) & (c("type") == "list_item")
    return S.page_elements(spark, folder).select("doc", "pos", F.when(chosen, "toc_item").otherwise(c("type")).alias("type"))


@query("n22_key_allow_list", "SELECT p_partkey, p_name AS label FROM part")
def n22(spark, folder):
    kept = F.map_filter(F.create_map(F.lit("label"), "p_name", F.lit("secret"), "p_brand"), lambda k, v: k.isin("label", "reason"))
    return S.table(spark, folder, "part").select("p_partkey", kept["label"].alias("label"))


@query("n7_first_box", "SELECT p_partkey, p_size::DOUBLE AS l, (p_size + 5)::DOUBLE AS r FROM part")
def n7(spark, folder):
    prov = F.array(F.struct(F.struct(c("p_size").cast("double").alias("l"), (c("p_size") + 5).cast("double").alias("r")).alias("bbox")))
    return S.table(spark, folder, "part").select("p_partkey", prov[0]["bbox"]["l"].alias("l"), prov[0]["bbox"]["r"].alias("r"))


@query("m14_insert_change", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'accepted' END AS review_status FROM orders")
def m14(spark, folder):
    return S.table(spark, folder, "orders").select("o_orderkey", F.when(c("o_orderstatus") == "O", "pending").otherwise("accepted").alias("review_status"))


@query("e3_validate", """SELECT 'long text' AS rule, count(*) FILTER (n_chars > 5000) AS failed, count(*) AS checked FROM documents UNION ALL SELECT 'no label', count(*) FILTER (quality IS NULL), count(*) FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT 'bad count', count(*) FILTER (length(text) <> n_chars), count(*) FROM documents""")
def e3(spark, folder):
    """The rule engine: every rule is a boolean of a row, all evaluated in one pass."""
    rows = S.table(spark, folder, "documents").join(S.table(spark, folder, "labels"), "doc_id", "left")
    rules = {"long text": c("n_chars") > 5000, "no label": c("quality").isNull(), "bad count": F.length("text") != c("n_chars")}
    one = rows.agg(*[F.count_if(v).alias(k) for k, v in rules.items()], F.count(F.lit(1)).alias("checked"))
    return one.unpivot("checked", list(rules), "rule", "failed")


@query("e15_benchmark_row", with_frames("jobs", "SELECT doc_id, n_chars > 2000 AS long, coalesce(compliant, false) AS compliant, CASE WHEN failed THEN 'failed' ELSE 'done' END AS status, (failed::INT + coalesce(blocking, false)::INT) AS gaps FROM jobs"))
def e15(spark, folder):
    no = F.lit(False)
    return S.jobs(spark, folder).select("doc_id", (c("n_chars") > 2000).alias("long"), F.coalesce("compliant", no).alias("compliant"), F.when(c("failed"), "failed").otherwise("done").alias("status"), (c("failed").cast("int") + F.coalesce("blocking", no).cast("int")).alias("gaps"))


@query("x13_transform_point", with_frames("boxes", "SELECT box, 2 * l + 3 * b + 1 AS x, l - b AS y FROM boxes"))
def x13(spark, folder):
    x, y = G.affine_point([F.lit(v) for v in (2.0, 1.0, 3.0, -1.0, 1.0, 0.0)], c("l"), c("b"))
    return S.boxes(spark, folder).select("box", x.alias("x"), y.alias("y"))
