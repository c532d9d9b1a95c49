"""Queries of order-dependent operators: folds over ordered lists, islands, neighbours, grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.functions.sequences import longest_nondecreasing
from foliolens.plans.oracles import LONGEST as _LNDS
from foliolens.plans.registry import query
from foliolens.plans.scalars import _n
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames

c = F.col


@query("w1_longest_order", f"SELECT user_id, {_LNDS.format(a='a')}::INT AS ordered FROM (SELECT user_id, list(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) ORDER BY ts, event_id) AS a FROM events GROUP BY user_id)")
def w1(spark, folder):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    lists = S.table(spark, folder, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", k.alias("k")))).alias("x"))
    return lists.select("user_id", longest_nondecreasing(F.transform("x", lambda s: s["k"])).alias("ordered"))


def fragments(spark, folder):
    """Of each document the first 24 distinct line beginnings of 18 letters and digits or more, at most 120, in order."""
    norm = T.normalized(c("line"))
    lines = S.doc_lines(spark, folder).select("doc_id", "pos", F.substring(norm, 1, 120).alias("fragment"), F.length(norm).alias("n")).where("n >= 18")
    first = lines.groupBy("doc_id", "fragment").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where("rank <= 24")


_FRAG = f"(SELECT doc_id, fragment, pos, rank FROM (SELECT doc_id, fragment, pos, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::INT AS rank FROM (SELECT doc_id, substring({_n('line')}, 1, 120) AS fragment, min(pos) AS pos FROM doc_lines WHERE length({_n('line')}) >= 18 GROUP BY ALL)) WHERE rank <= 24)"


@query("w4_fragments", with_frames("doc_lines", f"SELECT doc_id, fragment, pos, rank FROM {_FRAG}"))
def w4(spark, folder):
    return fragments(spark, folder).select("doc_id", "fragment", "pos", "rank")


_LOSSY = "replace({t}, ' of ', ' ')"


@query("w3_order_metrics", with_frames("doc_lines", f"""SELECT doc_id, considered, hits, CASE WHEN hits = 0 THEN 0 ELSE {_LNDS.format(a='p')} END::INT AS ordered, round(hits / considered::DOUBLE, 4) AS hit_rate FROM (
    SELECT doc_id, len(f)::INT AS considered, list_filter(list_transform(f, lambda x: strpos(cut, x)), lambda v: v > 0) AS p, len(list_filter(list_transform(f, lambda x: strpos(cut, x)), lambda v: v > 0))::INT AS hits FROM (
    SELECT doc_id, list(fragment ORDER BY rank) AS f FROM {_FRAG} GROUP BY doc_id) JOIN (SELECT doc_id, {_LOSSY.format(t=_n('text'))} AS cut FROM documents) USING (doc_id))"""))
def w3(spark, folder):
    norm = T.normalized(c("text"))
    texts = S.table(spark, folder, "documents").select("doc_id", F.replace(norm, F.lit(" of "), F.lit(" ")).alias("cut"))
    lists = fragments(spark, folder).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "fragment"))), lambda x: x["fragment"]).alias("f"))
    found = lists.join(texts, "doc_id").select("doc_id", F.size("f").alias("considered"), F.filter(F.transform("f", lambda x: F.instr(c("cut"), x)), lambda v: v > 0).alias("p"))
    hits = F.size("p")
    return found.select("doc_id", "considered", hits.alias("hits"), F.when(hits == 0, 0).otherwise(longest_nondecreasing(c("p"))).alias("ordered"), F.round(hits / c("considered"), 4).alias("hit_rate"))


@query("w2_fragment_positions", with_frames("doc_lines", f"SELECT doc_id, rank, strpos({_n('text')}, fragment)::INT - 1 AS at FROM {_FRAG} JOIN documents USING (doc_id)"))
def w2(spark, folder):
    texts = S.table(spark, folder, "documents").select("doc_id", T.normalized(c("text")).alias("n"))
    return fragments(spark, folder).join(texts, "doc_id").select("doc_id", "rank", (F.instr(c("n"), c("fragment")) - 1).alias("at"))


@query("w5_page_fragments", with_frames("blocks", "SELECT page, pos, role, fragment FROM (SELECT page, min(pos) AS pos, role, substring(text, 1, 40) AS fragment FROM blocks WHERE length(text) >= 16 GROUP BY page, role, substring(text, 1, 40)) QUALIFY row_number() OVER (PARTITION BY page ORDER BY pos) <= 3"))
def w5(spark, folder):
    first = S.blocks(spark, folder).where(F.length("text") >= 16).groupBy("page", "role", F.substring("text", 1, 40).alias("fragment")).agg(F.min("pos").alias("pos"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy("pos"))).where("r <= 3").select("page", "pos", "role", "fragment")


@query("w6_heading_levels", """SELECT user_id, list_reduce(list_concat([[1, s, 0]::BIGINT[]], list_transform(a, lambda v: [v])), lambda t, x: [
    least(6, greatest(1, CASE WHEN t[1] = 1 AND greatest(1, x[1] - t[2]) > 1 THEN 1 ELSE least(greatest(1, x[1] - t[2]), t[1] + 1) END)), t[2],
    t[3] + least(6, greatest(1, CASE WHEN t[1] = 1 AND greatest(1, x[1] - t[2]) > 1 THEN 1 ELSE least(greatest(1, x[1] - t[2]), t[1] + 1) END))])[3] AS total FROM (
    SELECT user_id, a, a[1] - 1 AS s FROM (SELECT user_id, list((value::BIGINT % 6) + 1 ORDER BY ts, event_id) AS a FROM (SELECT user_id, ts, event_id, floor(value) AS value FROM events) GROUP BY user_id))""")
def w6(spark, folder):
    """Levels start at 1 and never jump by more than one; the sum of the repaired levels of each list."""
    level = (F.floor("value").cast("bigint") % 6) + 1
    lists = S.table(spark, folder, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", level.alias("v")))), lambda x: x["v"]).alias("a"))
    shift = F.element_at("a", 1) - 1

    def repaired(t, x):
        want = F.greatest(F.lit(1), x - shift)
        return F.least(F.lit(6), F.greatest(F.lit(1), F.when((t["level"] == 1) & (want > 1), F.lit(1)).otherwise(F.least(want, t["level"] + 1)))).cast("bigint")

    start = F.struct(F.lit(1).cast("bigint").alias("level"), F.lit(0).cast("bigint").alias("total"))
    folded = F.aggregate("a", start, lambda t, x: F.struct(repaired(t, x).alias("level"), (t["total"] + repaired(t, x)).alias("total")))
    return lists.select("user_id", folded["total"].alias("total"))


@query("w7_toc_sequences", with_frames("page_elements", """SELECT doc, pos, grp FROM (SELECT doc, pos, type, sum((type <> 'list_item')::INT) OVER (PARTITION BY doc ORDER BY pos)::BIGINT AS grp FROM page_elements) WHERE type = 'list_item'"""))
def w7(spark, folder):
    w = Window.partitionBy("doc").orderBy("pos")
    return S.page_elements(spark, folder).withColumn("grp", F.sum((c("type") != "list_item").cast("int")).over(w)).where("type = 'list_item'").select("doc", "pos", "grp")


@query("w8_first_groups", with_frames("page_elements", """SELECT doc, grp, min(pos) AS first_pos, count(*) AS items FROM (SELECT doc, pos, type, sum((type = 'heading')::INT) OVER (PARTITION BY doc ORDER BY pos)::BIGINT AS grp FROM page_elements) WHERE grp BETWEEN 1 AND 3 GROUP BY ALL"""))
def w8(spark, folder):
    w = Window.partitionBy("doc").orderBy("pos")
    return S.page_elements(spark, folder).withColumn("grp", F.sum((c("type") == "heading").cast("int")).over(w)).where("grp between 1 and 3").groupBy("doc", "grp").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("items"))


@query("w9_candidate_span", with_frames("blocks", "SELECT b.page, b.pos, a.page AS anchor FROM (SELECT DISTINCT page FROM blocks WHERE role = 'system') a JOIN blocks b ON b.page BETWEEN a.page AND a.page + 2 WHERE b.role <> 'system'"))
def w9(spark, folder):
    anchors = S.blocks(spark, folder).where("role = 'system'").select(c("page").alias("anchor")).distinct()
    near = anchors.withColumn("page", F.explode(F.sequence("anchor", c("anchor") + 2)))  # an equi-join on the three pages
    return S.blocks(spark, folder).where("role <> 'system'").join(near, "page").select("page", "pos", "anchor")


@query("w12_expand_items", "SELECT p_partkey, unnest(range(1, p_size % 5 + 1))::INT AS item FROM part")
def w12(spark, folder):
    n = c("p_size") % 5
    return S.table(spark, folder, "part").where(n > 0).select("p_partkey", F.explode(F.sequence(F.lit(1), n)).alias("item"))


@query("w13_rows_from_cells", with_frames("table_cells", """SELECT tbl, "row", string_agg(text, ' ' ORDER BY col) AS text, count(*) AS cells FROM table_cells GROUP BY ALL"""))
def w13(spark, folder):
    return S.table_cells(spark, folder).groupBy("tbl", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " ").alias("text"), F.count(F.lit(1)).alias("cells"))


@query("w14_heading_context", with_frames("blocks", """SELECT page, pos, lag(role) OVER w AS before, lead(role) OVER w AS after, last_value(CASE WHEN role = 'user' THEN pos END IGNORE NULLS) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user FROM blocks WINDOW w AS (PARTITION BY page ORDER BY pos)"""))
def w14(spark, folder):
    w = Window.partitionBy("page").orderBy("pos")
    return S.blocks(spark, folder).select("page", "pos", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"),
        F.last(F.when(c("role") == "user", c("pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("last_user"))


@query("w15_next_body", with_frames("page_elements", """SELECT doc, pos, first_value(CASE WHEN type = 'paragraph' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc, grp ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS body FROM (SELECT *, sum((type = 'heading')::INT) OVER (PARTITION BY doc ORDER BY pos) AS grp FROM page_elements)"""))
def w15(spark, folder):
    w = Window.partitionBy("doc").orderBy("pos")
    islands = S.page_elements(spark, folder).withColumn("grp", F.sum((c("type") == "heading").cast("int")).over(w))
    v = Window.partitionBy("doc", "grp").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    return islands.select("doc", "pos", F.first(F.when(c("type") == "paragraph", c("pos")), ignorenulls=True).over(v).alias("body"))


@query("w16_next_page", with_frames("boxes", "SELECT box, page, lead(box) OVER (PARTITION BY page ORDER BY t DESC, l, box) AS next_box FROM boxes"))
def w16(spark, folder):
    return S.boxes(spark, folder).select("box", "page", F.lead("box").over(Window.partitionBy("page").orderBy(F.desc("t"), "l", "box")).alias("next_box"))


@query("w17_outline_candidates", with_frames("page_elements", """SELECT doc, kind, pos FROM (SELECT doc, 'heading' AS kind, pos FROM page_elements WHERE type = 'heading' UNION ALL SELECT doc, 'title', pos FROM page_elements WHERE type = 'title' UNION ALL SELECT doc, 'first_item', min(pos) FROM page_elements WHERE type = 'list_item' GROUP BY doc)"""))
def w17(spark, folder):
    e = S.page_elements(spark, folder)
    named = e.where(c("type").isin("heading", "title")).select("doc", c("type").alias("kind"), "pos")
    return named.unionByName(e.where("type = 'list_item'").groupBy("doc").agg(F.min("pos").alias("pos")).select("doc", F.lit("first_item").alias("kind"), "pos"))


@query("w19_suspicious_blocks", with_frames("blocks", "SELECT page, pos, length(lag(text) OVER (PARTITION BY page ORDER BY pos))::INT AS before_chars, length(lead(text) OVER (PARTITION BY page ORDER BY pos))::INT AS after_chars FROM blocks"))
def w19(spark, folder):
    w = Window.partitionBy("page").orderBy("pos")
    return S.blocks(spark, folder).select("page", "pos", F.length(F.lag("text").over(w)).alias("before_chars"), F.length(F.lead("text").over(w)).alias("after_chars"))


@query("w20_page_cap", with_frames("blocks", "SELECT page, pos, role FROM blocks QUALIFY row_number() OVER (PARTITION BY page ORDER BY pos) <= 3"))
def w20(spark, folder):
    w = Window.partitionBy("page").orderBy("pos")
    return S.blocks(spark, folder).withColumn("r", F.row_number().over(w)).where("r <= 3").select("page", "pos", "role")


@query("w21_latest_change", "SELECT conv_id, role, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY ALL")
def w21(spark, folder):
    """The latest row of each key as an aggregate, reduced before the shuffle."""
    return S.table(spark, folder, "conversations").groupBy("conv_id", "role").agg(F.max(F.struct("turn", "text")).alias("x")).select("conv_id", "role", "x.turn", "x.text")


@query("w22_nearby_text", with_frames("blocks", "SELECT page, pos, array_to_string(list(role) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ',') AS before, array_to_string(list(role) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ',') AS after FROM blocks"))
def w22(spark, folder):
    w = Window.partitionBy("page").orderBy("pos")
    near = lambda a, b: F.nullif(F.array_join(F.collect_list("role").over(w.rowsBetween(a, b)), ","), F.lit(""))
    return S.blocks(spark, folder).select("page", "pos", near(-2, -1).alias("before"), near(1, 2).alias("after"))


@query("w23_preview_sample", """SELECT source, array_to_string(list_transform(range(0, 4), lambda i: a[(round_even(i * (len(a) - 1) / 3.0, 0))::INT + 1]), ',') AS pages FROM (SELECT source, list_sort(list(DISTINCT doc_id)) AS a FROM documents GROUP BY source HAVING count(DISTINCT doc_id) > 4)""")
def w23(spark, folder):
    pages = S.table(spark, folder, "documents").groupBy("source").agg(F.array_sort(F.collect_set("doc_id")).alias("a")).where(F.size("a") > 4)
    pick = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at("a", F.bround(i * (F.size("a") - 1) / 3.0, 0).cast("int") + 1))
    return pages.select("source", F.array_join(pick, ",").alias("pages"))


@query("w24_front_matter", with_frames("page_elements", """SELECT doc, pos, type FROM page_elements JOIN (SELECT doc, min(pos) AS stop FROM page_elements WHERE type = 'paragraph' GROUP BY doc) USING (doc) WHERE pos < stop QUALIFY row_number() OVER (PARTITION BY doc ORDER BY pos) <= 8"""))
def w24(spark, folder):
    w = Window.partitionBy("doc").orderBy("pos")
    e = S.page_elements(spark, folder).withColumn("seen", F.max((c("type") == "paragraph").cast("int")).over(w)).withColumn("r", F.row_number().over(w))
    has = F.max((c("type") == "paragraph").cast("int")).over(Window.partitionBy("doc"))
    return e.withColumn("has", has).where("seen = 0 and r <= 8 and has = 1").select("doc", "pos", "type")


@query("w25_early_title", with_frames("page_elements", "SELECT doc, pos, type FROM page_elements WHERE type IN ('title', 'heading') QUALIFY row_number() OVER (PARTITION BY doc ORDER BY pos) <= 8"))
def w25(spark, folder):
    w = Window.partitionBy("doc").orderBy("pos")
    return S.page_elements(spark, folder).where(c("type").isin("title", "heading")).withColumn("r", F.row_number().over(w)).where("r <= 8").select("doc", "pos", "type")


@query("w27_first_heading", with_frames("blocks", "SELECT page, arg_min(role, {'p': (NOT (role = 'assistant'))::INT, 'q': pos}) AS role FROM blocks GROUP BY page"))
def w27(spark, folder):
    return S.blocks(spark, folder).groupBy("page").agg(F.min_by("role", F.struct((c("role") != "assistant").cast("int"), "pos")).alias("role"))


@query("w28_synthesized_title", with_frames("page_elements", "SELECT doc, CASE WHEN n >= 2 THEN 1 ELSE n END AS titles, n AS fragments FROM (SELECT doc, count(*) FILTER (type IN ('title', 'heading')) AS n FROM page_elements GROUP BY doc)"))
def w28(spark, folder):
    n = S.page_elements(spark, folder).groupBy("doc").agg(F.count_if(c("type").isin("title", "heading")).alias("fragments"))
    return n.select("doc", F.when(c("fragments") >= 2, F.lit(1)).otherwise(c("fragments")).cast("bigint").alias("titles"), "fragments")


@query("w29_grid_fill", with_frames("table_cells", """SELECT tbl, "row", col, coalesce(text, '') AS text FROM (SELECT tbl, unnest(range(0, 3))::INT AS "row", col FROM (SELECT tbl, unnest(range(1, m + 1))::INT AS col FROM (SELECT tbl, max(col) AS m FROM table_cells GROUP BY tbl))) LEFT JOIN table_cells USING (tbl, "row", col)"""))
def w29(spark, folder):
    cells = S.table_cells(spark, folder)
    size = cells.groupBy("tbl").agg(F.max("col").alias("m"))
    grid = size.withColumn("col", F.explode(F.sequence(F.lit(1), c("m")))).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return grid.join(cells, ["tbl", "row", "col"], "left").select("tbl", "row", "col", F.coalesce("text", F.lit("")).alias("text"))


@query("w30_cell_box", with_frames("table_cells", """SELECT tbl, "row", col, (col - 1) * 100.0::DOUBLE AS l, "row" * 20.0::DOUBLE AS b, (col - 1 + col_span) * 100.0::DOUBLE AS r, ("row" + 1) * 20.0::DOUBLE AS t FROM table_cells"""))
def w30(spark, folder):
    return S.table_cells(spark, folder).select("tbl", "row", "col", ((c("col") - 1) * 100.0).alias("l"), (c("row") * 20.0).alias("b"), ((c("col") - 1 + c("col_span")) * 100.0).alias("r"), ((c("row") + 1) * 20.0).alias("t"))


@query("w31_insert_element", with_frames("blocks", "SELECT page, (row_number() OVER (PARTITION BY page ORDER BY fresh, pos))::INT AS slot, role FROM (SELECT page, pos, role, 0 AS fresh FROM blocks UNION ALL SELECT DISTINCT page, 0, 'figure', 1 FROM blocks)"))
def w31(spark, folder):
    b = S.blocks(spark, folder).select("page", "pos", "role", F.lit(0).alias("fresh"))
    new = b.select("page").distinct().select("page", F.lit(0).cast("bigint").alias("pos"), F.lit("figure").alias("role"), F.lit(1).alias("fresh"))
    return b.unionByName(new).select("page", F.row_number().over(Window.partitionBy("page").orderBy("fresh", "pos")).alias("slot"), "role")


@query("w32_order_pages", with_frames("blocks", "SELECT role, CASE WHEN len(a) = 0 THEN '1' ELSE array_to_string(a[1:4], ',') END AS pages FROM (SELECT role, list_sort(list(DISTINCT page)) AS a FROM blocks GROUP BY role)"))
def w32(spark, folder):
    pages = S.blocks(spark, folder).groupBy("role").agg(F.array_sort(F.collect_set("page")).alias("a"))
    return pages.select("role", F.coalesce(F.nullif(F.array_join(F.slice("a", 1, 4), ","), F.lit("")), F.lit("1")).alias("pages"))
