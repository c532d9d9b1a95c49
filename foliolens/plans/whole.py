"""Queries of whole operators where an older query of the same id states a part of one, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.operators import drift as D
from foliolens.operators import model as M
from foliolens.operators import outlines as O
from foliolens.plans.registry import query
from foliolens.plans.scalars import _TOC, _c
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames

c = F.col


# Elements of documents: lines with types dealt by their place, eight to a page.
def elements(spark, folder) -> DataFrame:
    lines = S.doc_lines(spark, folder).select(c("doc_id").alias("doc"), "pos", F.floor(c("pos") / 8).cast("int").alias("page"), ((c("doc_id") * 7 + c("pos") * 5) % 11).alias("k"), F.substring(T.collapsed(c("line")), 1, 60).alias("line"))
    kind = F.when(c("k") < 2, "heading").when(c("k") == 2, "figure").when(c("k") == 3, "artifact").when(c("k") == 4, "list_item").otherwise("paragraph")
    odd = (c("doc") + c("pos")) % 2 == 1
    text = F.when((c("type") == "heading") & (c("pos") % 3 == 0), "Table  of Contents").when(c("type").isin("paragraph", "list_item") & odd, F.concat("line", F.lit(" .... "), c("page").cast("string"))).otherwise(c("line"))
    return lines.withColumn("type", kind).select("doc", "pos", "page", "type", text.alias("text"))


_ELEMENTS = f"""elements AS (SELECT doc, pos, page, type, CASE WHEN type = 'heading' AND pos % 3 = 0 THEN 'Table  of Contents' WHEN type IN ('paragraph', 'list_item') AND (doc + pos) % 2 = 1 THEN line || ' .... ' || page ELSE line END AS text FROM (
    SELECT doc_id AS doc, pos, pos // 8 AS page, CASE WHEN (doc_id * 7 + pos * 5) % 11 < 2 THEN 'heading' WHEN (doc_id * 7 + pos * 5) % 11 = 2 THEN 'figure' WHEN (doc_id * 7 + pos * 5) % 11 = 3 THEN 'artifact' WHEN (doc_id * 7 + pos * 5) % 11 = 4 THEN 'list_item' ELSE 'paragraph' END AS type,
    substr({_c('line')}, 1, 60) AS line FROM doc_lines))"""
_ENTRY = rf"(type IN ('paragraph', 'list_item', 'heading') AND length({_c('text')}) >= 4 AND regexp_matches({_c('text')}, '[A-Za-z]') AND regexp_matches({_c('text')}, '{_TOC}') AND regexp_replace(regexp_replace({_c('text')}, '{_TOC}', ''), '[ .\t]+$', '') <> '')"


@query("w7_contents_runs", with_frames("doc_lines", f""", {_ELEMENTS}, e AS (SELECT doc, pos, type, text, {_ENTRY} AS entry FROM elements),
    h AS (SELECT *, max(CASE WHEN NOT entry AND type <> 'artifact' THEN pos END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS head FROM e),
    runs AS (SELECT doc, pos, (row_number() OVER (PARTITION BY doc ORDER BY pos) - 1)::INT AS grp FROM e WHERE type = 'heading' AND NOT entry AND lower({_c('text')}) IN ('contents', 'table of contents')
        AND EXISTS (SELECT 1 FROM h WHERE h.doc = e.doc AND h.head = e.pos AND h.entry))
    SELECT doc, pos, 'toc_caption' AS kind, grp FROM runs UNION ALL SELECT h.doc, h.pos, 'toc_item', grp FROM h JOIN runs ON h.doc = runs.doc AND h.head = runs.pos WHERE h.entry"""))
def w7_runs(spark, folder):
    return O.contents_runs(elements(spark, folder))


@query("w22_figure_context", with_frames("doc_lines", f""", {_ELEMENTS}, t AS (SELECT doc, page, pos, type, CASE WHEN type IN ('heading', 'paragraph', 'note', 'list_item') AND {_c('text')} <> '' THEN {_c('text')} END AS said FROM elements),
    l AS (SELECT doc, page, list({{'pos': pos, 'said': said, 'type': type}} ORDER BY pos) FILTER (said IS NOT NULL) AS a FROM t GROUP BY doc, page)
    SELECT f.doc, f.pos, coalesce(list_filter(a, lambda x: x.pos < f.pos AND x.type = 'heading')[-1].said, '') AS heading,
    coalesce(array_to_string(list_transform(list_filter(a, lambda x: x.pos < f.pos)[-2:], lambda x: x.said), ' | '), '') AS before,
    coalesce(array_to_string(list_transform(list_filter(a, lambda x: x.pos > f.pos)[1:2], lambda x: x.said), ' | '), '') AS after
    FROM t f JOIN l USING (doc, page) WHERE f.type = 'figure'"""))
def w22_context(spark, folder):
    return O.figure_context(elements(spark, folder))


_LIKE = rf"trim(regexp_replace(regexp_replace(lower({{}}), '[^\p{{{{L}}}}\p{{{{N}}}}\s]', '', 'g'), '\s+', ' ', 'g'))"


def _like(x: str) -> str:
    return _LIKE.format(_c(x))


@query("w28_title_bookmarks", with_frames("doc_lines", f""", {_ELEMENTS}, g AS (SELECT doc, list({{'text': text, 'page': page, 'level': 2}} ORDER BY pos) AS a FROM elements WHERE type = 'heading' GROUP BY doc),
    d AS (SELECT doc, a, CASE doc % 4 WHEN 0 THEN a[1].text WHEN 3 THEN 'something else' ELSE a[1].text || ': ' || coalesce(a[2].text, '') END AS title, doc % 8 = 1 AS has_toc FROM g),
    f AS (SELECT *, list_transform(list_filter(a, lambda e: e.page = 0)[1:4], lambda e: {_like('e.text')}) AS keys, {_like('title')} AS k FROM d),
    w AS (SELECT *, NOT has_toc AND k <> '' AND NOT list_contains(keys, k) AND len(list_filter(keys, lambda x: x <> '' AND contains(k, x))) >= 2 AS whole FROM f),
    r AS (SELECT doc, CASE WHEN whole THEN list_concat([{{'text': title, 'page': 0, 'level': 1}}], list_filter(a, lambda e: e.page <> 0 OR {_like('e.text')} = '' OR NOT contains(k, {_like('e.text')}) OR {_like('e.text')} = k)) ELSE a END AS a FROM w)
    SELECT doc, i::INT - 1 AS place, a[i].text AS text, a[i].page::INT AS page, a[i].level::INT AS level FROM (SELECT doc, a, unnest(range(1, len(a) + 1)) AS i FROM r)"""))
def w28_bookmarks(spark, folder):
    heads = elements(spark, folder).where("type = 'heading'").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "page"))).alias("a"))
    entries = F.transform("a", lambda x: F.struct(x["text"].alias("text"), x["page"].alias("page"), F.lit(2).alias("level")))
    text = lambda i: F.get(F.transform("a", lambda x: x["text"]), F.lit(i))
    title = F.when(c("doc") % 4 == 0, text(0)).when(c("doc") % 4 == 3, "something else").otherwise(F.concat(text(0), F.lit(": "), F.coalesce(text(1), F.lit(""))))
    found = O.title_bookmarks(heads.select("doc", title.alias("title"), (c("doc") % 8 == 1).alias("has_toc"), entries.alias("entries")))
    return found.select("doc", F.posexplode("entries").alias("place", "x")).select("doc", "place", "x.text", "x.page", "x.level")


_COUNTS = {
    "headings": ("p_size", "p_size * (p_partkey % 5) // 4"), "figures": ("p_partkey % 7", "p_size % 3"), "tables": ("p_size % 9", "p_partkey % 9 - 1"),
    "lists": ("p_size - 20", "p_partkey % 30"), "links": ("p_partkey % 4", "p_size % 4"),
}


@query("t3_tagging_regressions", """SELECT p_partkey, concat_ws('; ', CASE WHEN h > 0 AND h2 = 0 THEN 'headings dropped to zero (' || h || ' -> 0)' WHEN h >= 5 AND h2 < floor(h * 0.8) THEN 'headings dropped significantly (' || h || ' -> ' || h2 || ')' END,
    CASE WHEN f > 0 AND f2 = 0 THEN 'figures dropped to zero (' || f || ' -> 0)' WHEN f >= 5 AND f2 < floor(f * 0.8) THEN 'figures dropped significantly (' || f || ' -> ' || f2 || ')' END,
    CASE WHEN t > 0 AND t2 = 0 THEN 'tables dropped to zero (' || t || ' -> 0)' WHEN t >= 5 AND t2 < floor(t * 0.8) THEN 'tables dropped significantly (' || t || ' -> ' || t2 || ')' END,
    CASE WHEN l > 0 AND l2 = 0 THEN 'lists dropped to zero (' || l || ' -> 0)' WHEN l >= 5 AND l2 < floor(l * 0.8) THEN 'lists dropped significantly (' || l || ' -> ' || l2 || ')' END,
    CASE WHEN k > 0 AND k2 < k THEN 'links decreased (' || k || ' -> ' || k2 || ')' END) AS regressions
    FROM (SELECT p_partkey, p_size AS h, (p_size * (p_partkey % 5)) // 4 AS h2, p_partkey % 7 AS f, p_size % 3 AS f2, p_size % 9 AS t, greatest(p_partkey % 9 - 1, 0) AS t2, greatest(p_size - 20, 0) AS l, p_partkey % 30 AS l2, p_partkey % 4 AS k, p_size % 4 AS k2 FROM part)""")
def t3_whole(spark, folder):
    column = lambda x: F.expr(x.replace(" // ", " div ")).cast("bigint")
    found = O.tagging_regressions({k: column(v[1]) for k, v in _COUNTS.items()}, {k: column(v[0]) for k, v in _COUNTS.items()})
    return S.table(spark, folder, "part").select("p_partkey", F.array_join(found, "; ").alias("regressions"))


@query("g39_status_histogram", """WITH r AS (SELECT '{"Status" : " ' || event_type || ' ", "items": [{"result":"' || upper(event_type) || '", "more": {"a": {"STATE" :"op\\u0065n"}}}, ' || event_id % 3 || ', "status"], "state": ' || event_id % 2 || ', "x": {"result": {"status": "deep"}}}' AS j FROM events)
    SELECT lower(trim(t.atom ->> '$')) AS status, count(*) AS n FROM r, json_tree(r.j::JSON) t WHERE lower(t.key) IN ('status', 'result', 'state') AND t.type = 'VARCHAR' GROUP BY ALL""")
def g39_whole(spark, folder):
    """Strings under the three keys, in any case and at any depth, of reports that nest five deep."""
    report = F.concat(
        F.lit('{"Status" : " '), "event_type", F.lit(' ", "items": [{"result":"'), F.upper("event_type"), F.lit('", "more": {"a": {"STATE" :"op\\u0065n"}}}, '), (c("event_id") % 3).cast("string"),
        F.lit(', "status"], "state": '), (c("event_id") % 2).cast("string"), F.lit(', "x": {"result": {"status": "deep"}}}'))
    return O.status_counts(S.table(spark, folder, "events").select(report.alias("j")), "j")


# Trees of 64 nodes, six levels deep: two children of each; every fourth size has no label.
def tree(spark, folder) -> DataFrame:
    i = c("p_partkey") % 64
    parent = F.when(i > 0, c("p_partkey") - i + F.floor((i - 1) / 2)).cast("bigint")
    return S.table(spark, folder, "part").where("p_partkey >= 64").select(
        (c("p_partkey") - i).cast("bigint").alias("doc"), c("p_partkey").cast("bigint").alias("node"), parent.alias("parent"), (-c("p_partkey")).cast("bigint").alias("pos"),
        F.when(c("p_size") % 4 == 0, "").otherwise(c("p_name")).alias("label"))


_TREE = """tree AS (SELECT p_partkey - p_partkey % 64 AS doc, p_partkey AS node, CASE WHEN p_partkey % 64 > 0 THEN p_partkey - p_partkey % 64 + (p_partkey % 64 - 1) // 2 END AS parent, -p_partkey AS pos, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS label FROM part WHERE p_partkey >= 64),
    walk AS (SELECT doc, node, parent, 0 AS depth, [pos] AS ord, '/' || label AS path, label, label <> '' AS open FROM tree WHERE parent IS NULL
        UNION ALL SELECT t.doc, t.node, t.parent, depth + 1, list_append(ord, t.pos), path || '/' || t.label, t.label, open AND t.label <> '' FROM walk JOIN tree t ON t.parent = walk.node)"""


@query("n3_body_walk", f"WITH RECURSIVE {_TREE} SELECT doc, node, depth, (row_number() OVER (PARTITION BY doc ORDER BY ord) - 1)::INT AS place, path FROM walk")
def n3_whole(spark, folder):
    return O.walked(tree(spark, folder)).select("doc", "node", "depth", "place", "path")


@query("n6_pruned_tree", f"""WITH RECURSIVE {_TREE}, up AS (SELECT node, parent FROM walk WHERE label <> '' UNION SELECT w.node, w.parent FROM up JOIN walk w ON w.node = up.parent)
    SELECT k.doc, k.node, count(ch.node) AS children FROM walk k LEFT JOIN up ch ON ch.parent = k.node WHERE k.node IN (SELECT node FROM up) GROUP BY ALL""")
def n6_whole(spark, folder):
    """Nodes that have a label or a kept child, with the number of kept children."""
    kept = O.walked(tree(spark, folder)).where("said")
    children = kept.groupBy(c("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    return kept.join(children, "node", "left").select("doc", "node", F.coalesce("children", F.lit(0)).alias("children"))


@query("g11_tree_types", f"WITH RECURSIVE {_TREE} SELECT p_brand AS type, depth, count(*) AS n FROM walk JOIN part ON p_partkey = node GROUP BY ALL")
def g11_whole(spark, folder):
    types = S.table(spark, folder, "part").select(c("p_partkey").alias("node"), c("p_brand").alias("type"))
    return O.walked(tree(spark, folder)).join(types, "node").groupBy("type", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("s20_outline_list", f"WITH RECURSIVE {_TREE} SELECT doc, coalesce(string_agg(label, ' > ' ORDER BY ord) FILTER (label <> ''), '') AS outline FROM walk GROUP BY doc")
def s20_whole(spark, folder):
    """Titles of an outline, depth first; those without text are left out."""
    nodes = tree(spark, folder)
    rows = O.walked(nodes).join(nodes.select("doc", "node", "label"), ["doc", "node"])
    listed = F.array_sort(F.collect_list(F.when(c("label") != "", F.struct("place", "label"))))
    return rows.groupBy("doc").agg(F.array_join(F.transform(listed, lambda x: x["label"]), " > ").alias("outline"))


@query("t14_native_bookmarks", f"""WITH RECURSIVE {_TREE}, h AS (SELECT doc, {_like('label')} AS key, arg_min(p_size % 10, node) AS page FROM tree JOIN part ON p_partkey = node WHERE p_size > 10 AND {_like('label')} <> '' GROUP BY ALL),
    f AS (SELECT w.doc, w.node, w.ord, w.depth, page, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS label FROM walk w JOIN h ON w.doc = h.doc AND {_like('w.label')} = h.key WHERE w.open AND page < 8)
    SELECT doc, node, page, least(6, depth + 1)::INT AS level FROM f QUALIFY row_number() OVER (PARTITION BY doc, label, page ORDER BY ord) = 1""")
def t14_whole(spark, folder):
    nodes = tree(spark, folder)
    sizes = S.table(spark, folder, "part").where("p_size > 10").select(c("p_partkey").alias("node"), (c("p_size") % 10).alias("page"))
    headings = nodes.join(sizes, "node").select("doc", c("label").alias("title"), "page", c("node").alias("pos"))
    return O.native_bookmarks(nodes, headings, F.lit(8))


@query("j9_reading_order", """WITH p AS (SELECT conv_id AS page, list(turn ORDER BY turn) AS own, list(turn ORDER BY turn * 7 % 5, turn DESC) AS ids FROM conversations GROUP BY conv_id),
    q AS (SELECT page, own, CASE WHEN page % 5 = 0 THEN ids[2:] WHEN page % 5 = 1 THEN list_append(ids[2:], 99) ELSE ids END AS ids FROM p),
    r AS (SELECT page, own, CASE WHEN list_sort(ids) = own THEN ids ELSE own END AS ids FROM q)
    SELECT page, own[i] AS pos, ids[i] AS id FROM (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM r)""")
def j9_whole(spark, folder):
    """Pages whose order lacks an element or names another stay as they are."""
    b = S.blocks(spark, folder).select("page", "pos", c("pos").alias("id"))
    asked = b.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct((c("pos") * 7 % 5).alias("k"), (-c("pos")).alias("n")))), lambda x: -x["n"]).alias("ids"))
    cut = F.slice("ids", 2, F.size("ids"))
    orders = asked.select("page", F.when(c("page") % 5 == 0, cut).when(c("page") % 5 == 1, F.array_append(cut, F.lit(99).cast("bigint"))).otherwise(c("ids")).alias("ids"))
    return O.reordered(b, orders)


def _named(metadata):
    """A map as text in the order of its names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query("g19_merged_tasks", with_frames("violations", """, t AS (SELECT doc, 'review:' || (event_id % 3) AS key, event_id AS place, rule_id AS title, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'odd' ELSE 'low' END AS severity, severity = 'error' AND event_id % 4 = 0 AS blocking, count FROM violations),
    m AS (SELECT doc, key, place, 'last' AS name, rule_id AS value FROM (SELECT doc, key, place, title AS rule_id FROM t) UNION ALL SELECT doc, key, place, title, count::VARCHAR FROM t WHERE place % 7 <> 0),
    l AS (SELECT doc, key, name, arg_max(value, place) AS value FROM m GROUP BY ALL),
    j AS (SELECT doc, key, string_agg(name || '=' || value, ';' ORDER BY name) AS metadata FROM l GROUP BY ALL)
    SELECT doc, key, arg_min(title, place) AS title, CASE WHEN bool_or(severity = 'high') THEN 'high' WHEN bool_or(severity = 'medium') THEN 'medium' WHEN bool_or(severity = 'low') THEN 'low' ELSE 'odd' END AS severity, bool_or(blocking) AS blocking, any_value(metadata) AS metadata
    FROM t JOIN j USING (doc, key) GROUP BY doc, key"""))
def g19_whole(spark, folder):
    """Tasks that a document's violations add under three keys, each with metadata of its own."""
    e = c("event_id")
    severity = F.when(e % 5 == 0, "high").when(e % 5 == 1, "medium").when(e % 5 == 2, "odd").otherwise("low")
    count = F.map_filter(F.create_map(F.lit("last"), c("rule_id"), c("rule_id"), c("count").cast("string")), lambda k, _: (k == "last") | (e % 7 != 0))
    rows = S.violations(spark, folder).select(
        "doc", F.concat(F.lit("review:"), (e % 3).cast("string")).alias("key"), e.alias("place"), c("rule_id").alias("title"), severity.alias("severity"),
        ((c("severity") == "error") & (e % 4 == 0)).alias("blocking"), count.alias("metadata"))
    return D.merged_tasks(rows).select("doc", "key", "title", "severity", "blocking", _named("metadata").alias("metadata"))


@query("n21_task_metadata", with_frames("review_tasks", """, t AS (SELECT *, CASE WHEN task_id % 4 <> 0 THEN source END AS said, coalesce(CASE WHEN task_id % 4 <> 0 THEN source END, 'fidelity') AS src FROM review_tasks),
    r AS (SELECT *, row_number() OVER (PARTITION BY job_id, task_type, src ORDER BY task_id) AS n FROM t)
    SELECT job_id AS doc, task_id AS place, CASE WHEN n = 1 AND task_type = 'alt_text' AND src IN ('fidelity', '1-URGENT') AND job_id % 3 <> 0 THEN 'from=' || job_id || ';rank=new' ELSE 'rank=' || severity END AS metadata FROM r"""))
def n21_whole(spark, folder):
    tasks = S.review_tasks(spark, folder).select(
        c("job_id").alias("doc"), c("task_id").alias("place"), "task_type", F.when(c("task_id") % 4 != 0, c("source")).alias("source"), F.create_map(F.lit("rank"), "severity").alias("metadata"))
    news = F.when(c("doc") % 3 != 0, F.create_map(F.lit("rank"), F.lit("new"), F.lit("from"), c("doc").cast("string")))
    updates = tasks.select("doc").distinct().select("doc", F.lit("alt_text").alias("task_type"), F.explode(F.array(F.lit("fidelity"), F.lit("1-URGENT"))).alias("source"), news.alias("metadata"))
    return D.with_metadata(tasks, updates).select("doc", "place", _named("metadata").alias("metadata"))


@query("n1_document_pages", with_frames("doc_lines", f""", {_ELEMENTS}, r AS (SELECT doc, pos, page + 1 AS page, CASE WHEN pos % 3 = 0 THEN 'e' || pos ELSE 'review-' || pos END AS id, CASE type WHEN 'figure' THEN 'table' WHEN 'artifact' THEN 'paragraph' ELSE type END AS role, substr({_c('text')}, 1, 240) AS text,
        CASE WHEN pos % 5 = 0 THEN 'fixed' WHEN pos % 7 = 0 THEN nullif(substr({_c('text')}, 1, 240), '') END AS resolved, row_number() OVER (PARTITION BY doc, page ORDER BY pos) AS ord FROM elements),
    p AS (SELECT doc, page, string_agg(ord || ':' || id || ':' || role || ':' || text || ':' || coalesce(resolved, '-'), '|' ORDER BY ord) FILTER (role <> 'table') AS blocks,
        string_agg(ord || ':' || id || ':' || CASE WHEN doc % 2 = 1 THEN '-' ELSE CASE WHEN length(id) % 2 = 0 THEN '0' ELSE '' END || ';' || CASE WHEN length(id) % 3 = 0 THEN '1' ELSE '' END || ';4' END, '|' ORDER BY ord) FILTER (role = 'table') AS tables FROM r GROUP BY ALL),
    f AS (SELECT doc, page, string_agg(pos || ':' || name, '|' ORDER BY pos) AS fields FROM (SELECT doc, CASE WHEN doc % 3 = 0 THEN page + 50 ELSE page + 1 END AS page, pos, substr({_c('text')}, 1, 240) AS name FROM elements WHERE type = 'list_item') GROUP BY ALL)
    SELECT doc, page, coalesce(blocks, '') AS blocks, coalesce(tables, '') AS tables, coalesce(fields, '') AS fields FROM p FULL JOIN f USING (doc, page)"""))
def n1_whole(spark, folder):
    """Pages as lists: places, ids and texts of blocks, headers and cells of tables, fields, some of them on pages of their own."""
    e, pos = elements(spark, folder), c("pos")
    none = F.lit(None).cast("string")
    kind = F.when(c("type") == "figure", " table ").when(c("type") == "artifact", "").otherwise(c("type"))
    rows = e.select(
        "doc", "pos", "page", F.when(pos % 3 == 0, F.concat(F.lit("e"), pos.cast("string"))).alias("review_id"), kind.alias("type"), "text", F.when(pos % 5 == 0, " fixed").otherwise("").alias("resolved_text"), none.alias("actual_text"), F.when(pos % 7 == 0, c("text")).alias("hint"), F.lit(1).alias("level"))
    tables = rows.where("type = ' table ' and doc % 2 = 0").select("doc", F.coalesce("review_id", F.concat(F.lit("review-"), pos.cast("string"))).alias("tbl"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    cells = tables.select("doc", "tbl", "pos", F.floor(c("pos") / 2).cast("int").alias("row"), (c("pos") % 2).alias("col"), F.lit("x").alias("text"), F.lit(False).alias("is_header"), ((c("pos") < 2) & (F.length("tbl") % 2 == 0)).alias("column_header"), ((c("pos") % 2 == 1) & (F.length("tbl") % 3 == 0)).alias("row_header"))
    fields = e.where("type = 'list_item'").select("doc", (c("page") + F.when(c("doc") % 3 == 0, 50).otherwise(1)).alias("page"), pos.alias("ord"), pos.cast("string").alias("field_id"), F.lit("text").alias("kind"), c("text").alias("name"), none.alias("label"), none.alias("value"))
    shown = lambda k, f: F.array_join(F.transform(k, f), "|").alias(k)
    joined = lambda *xs: F.concat_ws(":", *[x.cast("string") for x in xs])
    grid = lambda t: F.when(t["cells"].isNull(), "-").otherwise(F.concat_ws(";", F.array_join(t["header_rows"], ","), F.array_join(t["header_cols"], ","), F.size(t["cells"]).cast("string")))
    return M.document_pages(rows, cells, fields).select(
        "doc", "page", shown("blocks", lambda b: joined(b["ord"], b["id"], b["role"], b["text"], F.coalesce(b["resolved"], F.lit("-")))), shown("tables", lambda t: joined(t["ord"], t["id"], grid(t))), shown("fields", lambda f: joined(f["ord"], f["name"])))
