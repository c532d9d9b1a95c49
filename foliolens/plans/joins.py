"""Queries of join operators: equi, semi, anti, outer, as-of, nearest and spatial."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import geometry as G
from foliolens.functions import rules as R
from foliolens.functions import text as T
from foliolens.operators.spatial import best_box_match, nearest_boxes
from foliolens.plans.aggregates import _CUT
from foliolens.plans.registry import query
from foliolens.plans.scalars import _POOR_SQL
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames

c = F.col


@query("j1_tasks_of_jobs", with_frames("review_tasks", "SELECT task_id, task_type, c_name, c_mktsegment FROM review_tasks JOIN customer ON job_id = c_custkey"))
def j1(spark, folder):
    return S.review_tasks(spark, folder).join(S.table(spark, folder, "customer"), c("job_id") == c("c_custkey")).select("task_id", "task_type", "c_name", "c_mktsegment")


def last_of(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each key, as an aggregate: a hot key is reduced before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


@query("j2_compare_fields", """WITH cand AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'),
    last_cand AS (SELECT l_orderkey, l_linenumber, arg_max(l_linestatus, {'f': l_returnflag, 's': l_linestatus}) AS status FROM cand GROUP BY ALL)
    SELECT o_orderstatus, count(*) AS gold, count(status) AS present, count(*) FILTER (status = o_orderstatus) AS same FROM orders LEFT JOIN last_cand ON o_orderkey = l_orderkey AND l_linenumber = 1 GROUP BY ALL""")
def j2(spark, folder):
    cand = S.table(spark, folder, "lineitem").where(c("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    last = cand.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_returnflag", "l_linestatus"))["l_linestatus"].alias("status")).where("l_linenumber = 1")
    joined = S.table(spark, folder, "orders").join(last, c("o_orderkey") == c("l_orderkey"), "left")
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("gold"), F.count("status").alias("present"), F.count_if(c("status") == c("o_orderstatus")).alias("same"))


@query("j3_compare_links", with_frames("page_links", f"""SELECT g.page, count(*) AS gold, count(k.uri) AS present, count(*) FILTER (g.contents = k.contents) AS same
    FROM (SELECT * FROM page_links WHERE trim(contents) <> '' AND NOT {_POOR_SQL}) g LEFT JOIN (SELECT * FROM page_links WHERE pos % 3 <> 0) k ON g.page = k.page AND g.pos = k.pos AND g.uri = k.uri GROUP BY g.page"""))
def j3(spark, folder):
    links = S.page_links(spark, folder)
    gold = links.where((F.trim("contents") != "") & ~T.is_poor_link_text(c("contents")))
    cand = links.where("pos % 3 <> 0").withColumnRenamed("contents", "other")
    return gold.join(cand, ["page", "pos", "uri"], "left").groupBy("page").agg(F.count(F.lit(1)).alias("gold"), F.count("other").alias("present"), F.count_if(c("other") == c("contents")).alias("same"))


#: Characters that key a short passage.
GRAM = 12


@query("j4_gold_passages", """SELECT item_id, EXISTS (SELECT 1 FROM documents WHERE contains(text, b.text)) AS present FROM benchmark b""")
def j4(spark, folder):
    """A passage is present where a document holds it: an equi-join on its second to ninth word, then a containment test.

    These words are whole wherever the passage stands, whatever touches its ends. Passages
    of fewer words are keyed by their first characters (``GRAM`` of them, or all of shorter
    ones), as many joins as there are key lengths among them; an empty one is in every text.
    Neither side is broadcast but by its measured size.
    """
    gold = S.table(spark, folder, "benchmark").select("item_id", c("text").alias("passage"), F.split("text", " ").alias("p"))
    docs = S.table(spark, folder, "documents").select("doc_id", "text")
    w = F.split("text", " ")
    shifted = F.arrays_zip(*[F.slice(w, i + 1, F.size(w)).alias(f"w{i}") for i in range(8)])  # the words and seven shifts of them
    runs = docs.where(F.size(w) >= 8).select("doc_id", F.explode(F.array_distinct(F.transform(shifted, lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(8)])))).alias("key"))
    keyed = gold.where(F.size("p") >= 10).select("item_id", F.xxhash64(*[F.element_at("p", i + 2) for i in range(8)]).alias("key"))
    pairs = runs.join(keyed, "key").select("doc_id", "item_id").distinct()
    short = gold.where(F.size("p") < 10).withColumn("n", F.least(F.length("passage"), F.lit(GRAM)))
    for (n,) in short.select("n").distinct().collect():  # GRAM + 1 values at the most
        grams = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))) if n else F.array(F.lit(""))
        found = docs.select("doc_id", F.explode(grams).alias("gram")).join(short.where(c("n") == n).select("item_id", F.substring("passage", 1, n).alias("gram")), "gram")
        pairs = pairs.unionByName(found.select("doc_id", "item_id"))
    held = pairs.join(docs, "doc_id").join(gold.select("item_id", "passage"), "item_id").where(F.contains(c("text"), c("passage"))).select("item_id").distinct().withColumn("hit", F.lit(True))
    return gold.select("item_id").join(held, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("present"))


@query("j5_validation_changes", with_frames("violations", f"""SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.doc, b.doc) AS doc, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after,
    CASE WHEN b.n IS NULL THEN 'resolved' WHEN a.n IS NULL THEN 'new' WHEN b.n < a.n THEN 'improved' WHEN b.n > a.n THEN 'worse' ELSE 'same' END AS status
    FROM (SELECT rule_id, doc, sum(count)::BIGINT AS n FROM violations WHERE ts < TIMESTAMP '{_CUT}' GROUP BY ALL) a FULL JOIN (SELECT rule_id, doc, sum(count)::BIGINT AS n FROM violations WHERE ts >= TIMESTAMP '{_CUT}' GROUP BY ALL) b ON a.rule_id = b.rule_id AND a.doc = b.doc"""))
def j5(spark, folder):
    # Both sides come from one table, so the outer join is one conditional aggregate: one scan, one shuffle.
    early = c("ts") < F.lit(_CUT).cast("timestamp_ntz")
    both = S.violations(spark, folder).groupBy("rule_id", "doc").agg(F.sum(F.when(early, c("count"))).alias("a"), F.sum(F.when(~early, c("count"))).alias("b"))
    status = F.when(c("b").isNull(), "resolved").when(c("a").isNull(), "new").when(c("b") < c("a"), "improved").when(c("b") > c("a"), "worse").otherwise("same")
    return both.select("rule_id", "doc", F.coalesce("a", F.lit(0)).alias("before"), F.coalesce("b", F.lit(0)).alias("after"), status.alias("status"))


@query("j6_applied_changes", "SELECT p_partkey, p_name, s_name FROM part JOIN supplier ON p_partkey = s_suppkey WHERE p_size % 4 <> 0")
def j6(spark, folder):
    return S.table(spark, folder, "part").where("p_size % 4 <> 0").join(S.table(spark, folder, "supplier"), c("p_partkey") == c("s_suppkey")).select("p_partkey", "p_name", "s_name")


@query("j7_reclassified", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j7(spark, folder):
    return S.table(spark, folder, "documents").select("doc_id", "lang").join(S.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j10_text_resolutions", "SELECT conv_id, turn, CASE WHEN i.text IS NULL THEN c.text WHEN conv_id % 3 = 0 THEN i.text WHEN conv_id % 3 = 1 THEN '' ELSE c.text || ' ' || i.text END AS text FROM conversations c LEFT JOIN benchmark i ON item_id = conv_id * 8 + turn")
def j10(spark, folder):
    fix = S.table(spark, folder, "benchmark").select("item_id", c("text").alias("fix"))
    joined = S.table(spark, folder, "conversations").join(fix, c("item_id") == c("conv_id") * 8 + c("turn"), "left")
    return joined.select("conv_id", "turn", F.when(c("fix").isNull(), c("text")).when(c("conv_id") % 3 == 0, c("fix")).when(c("conv_id") % 3 == 1, "").otherwise(F.concat_ws(" ", "text", "fix")).alias("text"))


@query("j9_reorder", with_frames("blocks", "SELECT page, pos, role, (row_number() OVER (PARTITION BY page ORDER BY (pos * 7) % 11, pos))::INT AS slot FROM blocks"))
def j9(spark, folder):
    return S.blocks(spark, folder).select("page", "pos", "role", F.row_number().over(Window.partitionBy("page").orderBy((c("pos") * 7) % 11, "pos")).alias("slot"))


@query("j15_heading_target", """SELECT p_partkey, coalesce(a.k, b.k) AS target FROM part LEFT JOIN (SELECT p_name AS n, min(p_partkey) AS k FROM part WHERE p_size > 40 GROUP BY 1) a ON p_name = a.n
    LEFT JOIN (SELECT p_brand AS n, min(p_partkey) AS k FROM part WHERE p_size > 40 GROUP BY 1) b ON p_brand = b.n""")
def j15(spark, folder):
    part = S.table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    heads = part.where("p_size > 40")
    by_name = heads.groupBy("p_name").agg(F.min("p_partkey").alias("a"))
    by_brand = heads.groupBy("p_brand").agg(F.min("p_partkey").alias("b"))
    return part.join(by_name, "p_name", "left").join(by_brand, "p_brand", "left").select("p_partkey", F.coalesce("a", "b").alias("target"))


@query("j17_as_of", """SELECT event_id, (SELECT max(e2.event_id) FROM events e2 WHERE e2.user_id = e.user_id AND e2.event_type = 'purchase' AND (e2.ts, e2.event_id) <= (e.ts, e.event_id)) AS before,
    (SELECT min(e2.event_id) FROM events e2 WHERE e2.user_id = e.user_id AND e2.event_type = 'purchase' AND (e2.ts, e2.event_id) > (e.ts, e.event_id)) AS after FROM events e WHERE event_type <> 'purchase'""")
def j17(spark, folder):
    """As-of both ways on one timeline: the last purchase before, the first after; no range join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bought = F.when(c("event_type") == "purchase", c("event_id"))
    lined = S.table(spark, folder, "events").select(
        "event_id", "event_type", F.last(bought, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("before"),
        F.first(bought, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    return lined.where("event_type <> 'purchase'").select("event_id", "before", "after")


@query("j18_landmarks", "SELECT g.page, g.pos, min(k.pos) AS hit FROM (SELECT conv_id AS page, turn AS pos, role FROM conversations) g JOIN (SELECT conv_id AS page, turn AS pos, role FROM conversations) k ON g.page = k.page AND g.role = k.role GROUP BY ALL")
def j18(spark, folder):
    w = Window.partitionBy("page", "role")
    return S.blocks(spark, folder).select("page", "pos", F.min("pos").over(w).alias("hit"))


_boxed = "(greatest(0.0, least(a.r, o.r) - greatest(a.l, o.l)) * greatest(0.0, least(a.t, o.t) - greatest(a.b, o.b)))"
_area = "((%s.r - %s.l) * (%s.t - %s.b))"
_A, _O = _area % (("a",) * 4), _area % (("o",) * 4)
_SCORE = f"greatest({_boxed} / ({_A} + {_O} - {_boxed}), {_boxed} / {_A}, {_boxed} / {_O})"


@query("j20_best_box", with_frames("boxes", f"""SELECT target, arg_max(box, {{'s': score, 'i': -box}}) AS box, round(max(score), 6) AS score FROM (SELECT a.box AS target, o.box, {_SCORE} AS score
    FROM boxes a JOIN boxes o ON a.page = o.page AND a.box <> o.box WHERE {_boxed} > 0) GROUP BY target"""))
def j20(spark, folder):
    return best_box_match(S.boxes(spark, folder))


@query("j27_nearest_blocks", with_frames("boxes", """SELECT box, near, rank FROM (SELECT a.box, o.box AS near, (row_number() OVER (PARTITION BY a.box ORDER BY abs((a.l + a.r) / 2 - (o.l + o.r) / 2) + abs((a.b + a.t) / 2 - (o.b + o.t) / 2), o.box))::INT AS rank
    FROM boxes a JOIN boxes o ON a.page = o.page AND a.box <> o.box) WHERE rank <= 6"""))
def j27(spark, folder):
    return nearest_boxes(S.boxes(spark, folder), 6)


@query("j28_enclosing", with_frames("boxes", """SELECT box, above, rank FROM (SELECT a.box, o.box AS above, (row_number() OVER (PARTITION BY a.box ORDER BY o.b - a.t, o.box))::INT AS rank
    FROM boxes a JOIN boxes o ON a.page = o.page AND a.box <> o.box AND o.b >= a.t AND o.b - a.t <= 180 AND o.r > a.l AND o.l < a.r) WHERE rank <= 4"""))
def j28(spark, folder):
    a = S.boxes(spark, folder)
    o = a.select(c("box").alias("above"), "page", *[c(k).alias(f"o{k}") for k in "lbrt"])
    # Rows within 180 above: an equi-join on 180-high bands, each box also probing the next.
    banded = a.withColumn("band", F.explode(F.array(F.floor(c("t") / 180), F.floor(c("t") / 180) + 1)))
    pairs = banded.join(o.withColumn("band", F.floor(c("ob") / 180)), ["page", "band"]).where("box <> above and ob >= t and ob - t <= 180 and `or` > l and ol < r")
    rank = F.row_number().over(Window.partitionBy("box").orderBy(c("ob") - c("t"), "above"))
    return pairs.select("box", "above", rank.alias("rank")).where("rank <= 4")


@query("j35_dangling_links", with_frames("page_links", "SELECT page, pos, uri FROM page_links WHERE uri NOT IN (SELECT '/' || p_name FROM part) AND uri NOT IN (SELECT uri FROM page_links WHERE page % 2 = 0)"))
def j35(spark, folder):
    links = S.page_links(spark, folder)
    named = S.table(spark, folder, "part").select(F.concat(F.lit("/"), c("p_name")).alias("uri")).union(links.where("page % 2 = 0").select("uri")).distinct()
    return links.select("page", "pos", "uri").join(named, "uri", "left_anti").select("page", "pos", "uri")


@query("j36_assertions", """SELECT kind, count(*) AS n, count(*) FILTER (gold) AS gold_passed, count(*) FILTER (cand) AS candidate_passed FROM (SELECT unnest(['long', 'has_lines', 'has_digits']) AS kind,
    unnest([length(text) > 1000, contains(text, chr(10)), regexp_matches(text, '[0-9]')]) AS gold, unnest([length(replace(text, ' ', '')) > 1000, contains(replace(text, ' ', ''), chr(10)), regexp_matches(regexp_replace(text, '[0-4]', '', 'g'), '[0-9]')]) AS cand FROM documents) GROUP BY kind""")
def j36(spark, folder):
    tight, fewer = F.replace(c("text"), F.lit(" "), F.lit("")), F.regexp_replace("text", "[0-4]", "")
    tests = lambda t, d: [F.length(t) > 1000, F.contains(t, F.lit("\n")), F.rlike(d, F.lit("[0-9]"))]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), g.alias("gold"), d.alias("cand")) for k, g, d in zip(["long", "has_lines", "has_digits"], tests(c("text"), c("text")), tests(tight, fewer), strict=True)])
    return S.table(spark, folder, "documents").select(F.explode(rows).alias("x")).groupBy("x.kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("x.gold").alias("gold_passed"), F.count_if("x.cand").alias("candidate_passed"))


@query("j37_wildcard_match", """SELECT n_nationkey, count(c_custkey) AS hits FROM nation LEFT JOIN customer ON (n_nationkey % 3 = 0 OR c_nationkey = n_nationkey) AND (n_nationkey % 2 = 1 OR c_mktsegment = 'BUILDING') GROUP BY ALL""")
def j37(spark, folder):
    """A null in an assertion matches anything. Customers are counted by what assertions can ask, so the theta join is over two small lists."""
    counts = S.table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    asked = S.table(spark, folder, "nation").select("n_nationkey", F.when(c("n_nationkey") % 3 != 0, c("n_nationkey")).alias("of_nation"), F.when(c("n_nationkey") % 2 == 0, F.lit("BUILDING")).alias("of_segment"))
    grouped = counts.cube("c_nationkey", "c_mktsegment").agg(F.sum("n").alias("n"))
    hit = asked.join(grouped, asked["of_nation"].eqNullSafe(grouped["c_nationkey"]) & asked["of_segment"].eqNullSafe(grouped["c_mktsegment"]), "left")
    return hit.select("n_nationkey", F.coalesce("n", F.lit(0)).alias("hits"))


@query("j38_benchmark_row", """SELECT c_custkey, coalesce(n, 0) AS tasks, coalesce(blocking, 0) AS blocking, coalesce(cents, 0) AS cents FROM customer LEFT JOIN (
    SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS blocking, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def j38(spark, folder):
    per = S.table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("o_orderstatus") == "F").alias("b"), F.sum(F.round(c("o_totalprice") * 100).cast("bigint")).alias("p"))
    joined = S.table(spark, folder, "customer").join(per, c("c_custkey") == c("o_custkey"), "left")
    zero = lambda k: F.coalesce(k, F.lit(0))
    return joined.select("c_custkey", zero("n").alias("tasks"), zero("b").alias("blocking"), zero("p").alias("cents"))


@query("j39_tasks_of_one_job", with_frames("review_tasks", "SELECT task_id, blocking, created FROM review_tasks WHERE job_id = 7 ORDER BY blocking DESC, created"))
def j39(spark, folder):
    return S.review_tasks(spark, folder).where("job_id = 7").select("task_id", "blocking", "created").orderBy(F.desc("blocking"), "created")


@query("j40_batch_report", """SELECT o_orderkey, count(l_orderkey) AS children, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'P') GROUP BY ALL""")
def j40(spark, folder):
    children = S.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(c("l_quantity").cast("bigint")).alias("q"))
    kept = S.table(spark, folder, "orders").where(c("o_orderstatus").isin("F", "P")).select("o_orderkey")
    return kept.join(children, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("children"), F.coalesce("q", F.lit(0)).alias("quantity"))


_KEYS = [k for k, _, _ in R.GUIDANCE] + ["9.9-9", "7.3-1", "7.18.1-3"]
_KEYS_SQL = "[" + ", ".join(f"'{k}'" for k in _KEYS) + "][(p_partkey % 18 + 1)::INT]"
_KNOWN_SQL = "(VALUES " + ", ".join(f"('{k}', '{g}', '{h}')" for k, g, h in R.GUIDANCE) + ") AS g(rule_key, category, fix_hint)"
_SAYS = ["A Widget annotation lacks a name", "No replacement text", "Header th is missing", "Nesting is off", "FIGURE TAG without bounds", ""]


def ruled_parts(spark, folder):
    """Parts as violations of numbered rules."""
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (c("p_partkey") % 18 + 1).cast("int"))
    says = F.element_at(F.array(*map(F.lit, _SAYS)), c("p_size") % 6 + 1)
    return S.table(spark, folder, "part").select("p_partkey", key.alias("rule_key"), says.alias("description"))


@query("p5_guidance", f"SELECT p_partkey, k AS rule_key, category, fix_hint FROM (SELECT p_partkey, {_KEYS_SQL} AS k FROM part) LEFT JOIN {_KNOWN_SQL} ON k = rule_key")
def p5(spark, folder):
    return ruled_parts(spark, folder).join(R.guidance(spark), "rule_key", "left").select("p_partkey", "rule_key", "category", "fix_hint")


@query("p3_task_for_violation", f"""SELECT p_partkey, CASE WHEN k = '7.18.1-3' OR p_size % 6 = 0 THEN 'form_semantics' WHEN k LIKE '7.21.%' THEN 'font_text_fidelity' WHEN k LIKE '7.3-%' OR p_size % 6 IN (1, 4) THEN 'alt_text'
    WHEN category IN ('annotations', 'links') THEN 'annotation_description' WHEN category = 'tables' OR p_size % 6 = 2 THEN 'table_semantics' ELSE 'reading_order' END AS task_type
    FROM (SELECT p_partkey, p_size, {_KEYS_SQL} AS k FROM part) LEFT JOIN {_KNOWN_SQL} ON k = rule_key""")
def p3(spark, folder):
    known = ruled_parts(spark, folder).join(R.guidance(spark), "rule_key", "left")
    return known.select("p_partkey", R.task_type(F.concat(F.lit("ISO 14289-1:2014-"), c("rule_key")), c("category"), c("description")).alias("task_type"))


@query("x11_matching_score", with_frames("boxes", f"SELECT a.box AS target, o.box, round(0.85 * ({_boxed} / ({_A} + {_O} - {_boxed})) + 0.15 * ({_boxed} / {_A}), 6) AS score FROM boxes a JOIN boxes o ON a.page = o.page AND a.box < o.box WHERE {_boxed} > 0"))
def x11(spark, folder):
    from foliolens.operators.spatial import overlapping

    a, o = G.box(), G.box("o_")
    return overlapping(S.boxes(spark, folder)).where("box < o_box").select(c("box").alias("target"), c("o_box").alias("box"), F.round(0.85 * G.iou(a, o) + 0.15 * G.containment(a, o), 6).alias("score"))
