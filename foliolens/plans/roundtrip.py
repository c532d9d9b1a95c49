"""Queries of the gold-and-candidate comparison, with SQL of their own.

Gold documents are documents with lines as elements; candidates are the same with pages,
titles, types, order, fields, links and bookmarks changed by rules of their ids and places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.operators import roundtrip as O
from foliolens.operators.bookmarks import compare_bookmarks
from foliolens.plans.oracles import LONGEST as _LNDS
from foliolens.plans.registry import query
from foliolens.plans.scalars import _c, _loose, _n
from foliolens.plans.whole import _ELEMENTS, elements
from foliolens.sources import frames as S
from foliolens.sources.frames import with_frames

c = F.col


def sides(spark, folder) -> tuple[O.Side, O.Side]:
    doc, pos = c("doc"), c("pos")
    docs = S.table(spark, folder, "documents").select(c("doc_id").alias("doc"), F.floor(c("n_chars") / 1000).alias("pages"), "lang", F.substring(T.collapsed(c("text")), 1, 40).alias("title"), "text")
    changed = F.when(doc % 3 == 0, F.concat(F.lower("title"), F.lit("!"))).when(doc % 3 == 1, F.concat(F.lit("my "), "title")).otherwise(F.lit("other"))
    e = elements(spark, folder)
    field = e.where("type = 'list_item'").select("doc", "pos", "page", (pos % 8).alias("ord"), F.when(pos % 2 == 0, "text").otherwise("button").alias("kind"), F.substring("text", 1, 12).alias("name"), F.when(pos % 3 != 0, c("text")).otherwise("").alias("label"))
    again = field.where(pos % 6 == 0).withColumns({"pos": pos + 1000, "label": F.lit("again")})
    label = F.when(pos % 7 == 0, F.concat(F.lower("label"), F.lit("?!"))).when(pos % 4 == 1, "other").otherwise(c("label"))
    link = e.where("type = 'paragraph'").select("doc", "pos", "page", (pos % 8).alias("ord"), F.concat(F.lit("/"), F.substring("text", 1, 8)).alias("uri"), F.lit(None).cast("string").alias("dest"), c("text").alias("contents"), (pos % 4 != 0).alias("descriptive"))
    contents = F.when(pos % 5 == 2, "gone").when(pos % 2 == 0, F.replace("contents", F.lit(" "), F.lit(" zz "))).otherwise(F.lower("contents"))
    title = e.where("type = 'heading'").select("doc", "pos", c("text").alias("title"))
    higher = docs.select("doc", F.lit(100000).alias("pos"), F.concat(F.lit("Higher "), "lang").alias("title"))
    gold = O.Side(docs, e.select("doc", "pos", "type", "text", F.lit("caption").alias("caption")), field, link, title.unionByName(higher))
    candidate = O.Side(
        docs.select("doc", (c("pages") + (doc % 5 == 0).cast("int")).alias("pages"), F.when(doc % 4 == 0, F.concat(F.upper("lang"), F.lit("-XX"))).when(doc % 4 == 1, "zz").otherwise(c("lang")).alias("lang"), changed.alias("title"), F.lower("text").alias("text")),
        gold.elements.where(pos % 5 != 4).select(
            "doc", F.when(doc % 2 == 0, -pos).otherwise(pos).alias("pos"), F.when((pos % 7 == 0) & (c("type") == "heading"), "paragraph").otherwise(c("type")).alias("type"), F.when(doc % 3 == 1, F.lower("text")).otherwise(c("text")).alias("text"), "caption"),
        field.where(pos % 5 != 2).withColumn("label", label).unionByName(again), link.where(pos % 5 != 3).withColumn("contents", contents),
        title.where(pos % 3 != 1).withColumn("title", F.when(doc % 3 == 1, F.concat(F.lit("on "), F.lower("title"))).otherwise(c("title"))).unionByName(higher.where(doc % 2 == 0)))
    return gold, candidate


def assertions(spark, folder) -> DataFrame:
    """Six for each document, of sets by turns."""
    strings = lambda *xs: F.array(*xs).cast("array<string>")
    asked = F.array(*[F.struct(F.lit(s).alias("set"), F.lit(k).alias("kind"), x.alias("expected")) for s, k, x in (
        ("recoverable", "document_lang", strings(c("lang"))), ("recoverable", "title_contains", strings(c("title"))), ("recoverable", "title_equals", strings(c("title"))),
        ("recoverable", "text_contains", strings(c("title"))), ("hidden", "bookmark_title", strings(F.concat(F.lit("higher "), "lang"))), ("hidden", "field_accessible_name", strings(F.lit("again"))))])
    docs = S.table(spark, folder, "documents").select(c("doc_id").alias("doc"), "lang", F.substring(T.collapsed(c("text")), 1, 40).alias("title"))
    none = {**dict.fromkeys(("field_name", "field_type", "uri", "dest", "match_mode"), "string"), "page": "int", "terms_all": "array<string>", "terms_any": "array<string>"}
    return docs.select("doc", F.posexplode(asked).alias("id", "a")).select("doc", "id", "a.*", *[F.lit(None).cast(t).alias(k) for k, t in none.items()])


def _in_order(actual: str, expected: str) -> str:
    """The expected words, one blank about each, one after the other in the actual ones with two blanks between."""
    return f"({_loose(actual)} <> '' AND {_loose(expected)} <> '' AND regexp_matches(' ' || replace({_loose(actual)}, ' ', '  ') || ' ', ' ' || replace({_loose(expected)}, ' ', ' .* ') || ' '))"


def _in_title(actual: str, expected: str) -> str:
    return f"({_loose(actual, '')} <> '' AND {_loose(expected, '')} <> '' AND contains({_loose(actual, '')}, {_loose(expected, '')}))"


_DENSE = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_AT = "list_filter(list_transform({f}, lambda x: strpos({t}, x)), lambda v: v > 0)"
_TRACKED = ("heading", "paragraph", "list_item", "table", "figure", "note", "code", "formula")

_SIDES = f"""{_ELEMENTS}, d AS (SELECT doc_id AS doc, n_chars // 1000 AS pages, lang, substr({_c('text')}, 1, 40) AS title, text FROM documents),
    d2 AS (SELECT doc, pages + (doc % 5 = 0)::INT AS pages, CASE doc % 4 WHEN 0 THEN upper(lang) || '-XX' WHEN 1 THEN 'zz' ELSE lang END AS lang, CASE doc % 3 WHEN 0 THEN lower(title) || '!' WHEN 1 THEN 'my ' || title ELSE 'other' END AS title, lower(text) AS text FROM d),
    e2 AS (SELECT doc, CASE WHEN doc % 2 = 0 THEN -pos ELSE pos END AS pos, CASE WHEN pos % 7 = 0 AND type = 'heading' THEN 'paragraph' ELSE type END AS type, CASE WHEN doc % 3 = 1 THEN lower(text) ELSE text END AS text FROM elements WHERE pos % 5 <> 4),
    f AS (SELECT doc, pos, page, CASE WHEN pos % 2 = 0 THEN 'text' ELSE 'button' END AS kind, {_n('substr(text, 1, 12)')} AS name, CASE WHEN pos % 3 <> 0 THEN text ELSE '' END AS label FROM elements WHERE type = 'list_item'),
    f2 AS (SELECT * REPLACE (CASE WHEN pos % 7 = 0 THEN lower(label) || '?!' WHEN pos % 4 = 1 THEN 'other' ELSE label END AS label) FROM f WHERE pos % 5 <> 2 UNION ALL SELECT * REPLACE (pos + 1000 AS pos, 'again' AS label) FROM f WHERE pos % 6 = 0),
    l AS (SELECT doc, pos, text AS contents, pos % 4 <> 0 AS descriptive FROM elements WHERE type = 'paragraph'),
    l2 AS (SELECT doc, pos, CASE WHEN pos % 5 = 2 THEN 'gone' WHEN pos % 2 = 0 THEN replace(contents, ' ', ' zz ') ELSE lower(contents) END AS contents FROM l WHERE pos % 5 <> 3),
    t AS (SELECT doc, pos, text AS title, true AS heading FROM elements WHERE type = 'heading' UNION ALL SELECT doc, 100000, 'Higher ' || lang, false FROM d),
    t2 AS (SELECT doc, CASE WHEN doc % 3 = 1 AND heading THEN 'on ' || lower(title) ELSE title END AS title FROM t WHERE CASE WHEN heading THEN pos % 3 <> 1 ELSE doc % 2 = 0 END)"""

_MARKS = f"""marked AS (SELECT doc, pos, title, EXISTS (SELECT 1 FROM t2 WHERE t2.doc = t.doc AND ({_in_title('t2.title', 't.title')} OR {_in_order('t2.title', 't.title')})) AS hit,
        EXISTS (SELECT 1 FROM elements s WHERE s.doc = t.doc AND s.type = 'heading' AND {_loose('t.title')} <> '' AND contains(' ' || {_loose('s.text')} || ' ', ' ' || {_loose('t.title')} || ' ')) AS seen FROM t WHERE {_c('t.title')} <> ''),
    m AS (SELECT doc, count(*) AS n, count(*) FILTER (hit) AS matched, count(*) FILTER (seen) AS seen, count(*) FILTER (seen AND hit) AS seen_hit, count(*) FILTER (NOT seen) AS higher, count(*) FILTER (NOT seen AND hit) AS higher_hit,
        coalesce(array_to_string((list(title ORDER BY pos) FILTER (NOT hit))[1:10], '|'), '') AS missing, coalesce(array_to_string((list(title ORDER BY pos) FILTER (NOT seen AND NOT hit))[1:10], '|'), '') AS missing_higher FROM marked GROUP BY doc)"""


def _rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round({part} / {whole}::DOUBLE, 4) END"


@query("j4_bookmarks", with_frames("doc_lines", f""", {_SIDES}, {_MARKS}
    SELECT doc, m.n AS gold_total, (SELECT count(*) FROM t2 WHERE t2.doc = m.doc) AS candidate_total, matched AS matched_titles, {_rate('matched', 'n')} AS match_rate, missing AS missing_titles, seen AS recoverable_gold_total, seen_hit AS recoverable_matched_titles, {_rate('seen_hit', 'seen')} AS recoverable_match_rate,
    higher AS higher_order_gold_total, higher_hit AS higher_order_matched_titles, {_rate('higher_hit', 'higher')} AS higher_order_match_rate, missing_higher AS missing_higher_order_titles FROM m"""))
def j4_whole(spark, folder):
    """Titles by key or words in order, split by whether a heading shows their words."""
    gold, candidate = sides(spark, folder)
    listed = lambda df, name: df.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias(name))
    rows = listed(gold.titles, "gold").join(listed(candidate.titles, "candidate"), "doc", "left").join(O.transcripts(gold.elements), "doc", "left")
    found = compare_bookmarks(rows).drop("missing_recoverable_titles")
    lists = ("missing_titles", "missing_higher_order_titles")
    return found.withColumns({k: F.array_join(k, "|") for k in lists})


_COUNTS = (
    "gold_typed", "matched_typed", "gold_fields", "candidate_fields", "matched_fields", "matched_field_types", "gold_named_fields", "matched_named_fields", "gold_links", "candidate_links", "gold_descriptive_links", "matched_descriptive_links",
    "bookmark_gold_total", "bookmark_matched_titles", "recoverable_passed", "recoverable_failed", "recoverable_invalid", "hidden_passed", "hidden_failed", "hidden_invalid",
)


@query("e17_gold_candidate", with_frames("doc_lines", f""", {_SIDES}, {_MARKS},
    types AS (SELECT doc, type, count(*) FILTER (gold) AS g, count(*) FILTER (NOT gold) AS k FROM (SELECT doc, type, true AS gold FROM elements UNION ALL SELECT doc, type, false FROM e2) WHERE type IN {_TRACKED} GROUP BY ALL),
    ty AS (SELECT doc, sum(g)::BIGINT AS gold_typed, sum(least(g, k))::BIGINT AS matched_typed, string_agg(type || ':' || g || '/' || k, ',' ORDER BY list_position({list(_TRACKED)}, type)) AS types FROM types GROUP BY doc),
    last_f AS (SELECT doc, page, pos % 1000 % 8 AS ord, kind, name, arg_max(label, pos) AS label FROM f2 GROUP BY ALL),
    fr AS (SELECT f.doc, h.label IS NOT NULL AS hit, {_c('f.label')} <> '' AS named, h.label IS NOT NULL AND {_n('f.label')} <> '' AND {_n('f.label')} = {_n('h.label')} AS same FROM f LEFT JOIN last_f h ON f.doc = h.doc AND f.page = h.page AND f.pos % 8 = h.ord AND f.kind = h.kind AND f.name = h.name),
    fa AS (SELECT doc, count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (named) AS named, count(*) FILTER (named AND same) AS same FROM fr GROUP BY doc),
    lr AS (SELECT l.doc, l.descriptive AS d, l.descriptive AND l2.pos IS NOT NULL AND {_n('l.contents')} <> '' AND ({_n('l.contents')} = {_n('l2.contents')} OR {_loose('l.contents')} = {_loose('l2.contents')} OR {_in_order('l2.contents', 'l.contents')}) AS same FROM l LEFT JOIN l2 ON l.doc = l2.doc AND l.pos = l2.pos),
    la AS (SELECT doc, count(*) AS n, count(*) FILTER (d) AS d, count(*) FILTER (same) AS same FROM lr GROUP BY doc),
    frag AS (SELECT doc, fragment, min(pos) AS pos FROM (SELECT doc, pos, substring({_n('text')}, 1, 120) AS fragment FROM elements WHERE type <> 'artifact' AND length({_n('text')}) >= 18) GROUP BY ALL),
    fl AS (SELECT doc, (list(fragment ORDER BY pos))[1:24] AS fr FROM frag GROUP BY doc),
    tr AS (SELECT doc, string_agg(CASE WHEN {_c('text')} = '' THEN 'caption' ELSE {_c('text')} END, ' ' ORDER BY pos) FILTER (type <> 'artifact' AND ({_c('text')} <> '' OR type = 'figure')) AS tr FROM e2 GROUP BY doc),
    po AS (SELECT d.doc, coalesce(fr, []) AS fr, coalesce(tr, '') AS tr, {_AT.format(f='fr', t="coalesce(tr, '')")} AS a, {_AT.format(f=f"list_transform(fr, lambda y: {_DENSE.format('y')})", t=_DENSE.format("coalesce(tr, '')"))} AS b FROM d LEFT JOIN fl USING (doc) LEFT JOIN tr USING (doc)),
    ln AS (SELECT *, coalesce(len(a), 0) AS na, coalesce(len(b), 0) AS nb, CASE WHEN coalesce(len(a), 0) = 0 THEN 0 ELSE {_LNDS.format(a='a')} END AS oa, CASE WHEN coalesce(len(b), 0) = 0 THEN 0 ELSE {_LNDS.format(a='b')} END AS ob FROM po),
    ro AS (SELECT doc, len(fr) AS n, nb > na OR (nb = na AND ob > oa) AS dense, len(fr) = 0 OR tr = '' AS nothing, CASE WHEN nb > na OR (nb = na AND ob > oa) THEN nb ELSE na END AS hits, CASE WHEN nb > na OR (nb = na AND ob > oa) THEN ob ELSE oa END AS kept FROM ln),
    asked AS (SELECT d.doc, d2.lang = d.lang OR starts_with(d2.lang, upper(d.lang) || '-') AS lang_k, string_split(lower(d.lang), '-')[1] <> '' AS lang_g,
        ({_n('d.title')} <> '' AND contains({_n('d2.title')}, {_n('d.title')})) OR {_in_title('d2.title', 'd.title')} OR {_in_order('d2.title', 'd.title')} AS has_k, {_n('d.title')} <> '' OR {_loose('d.title', '')} <> '' OR {_loose('d.title')} <> '' AS has_g,
        ({_n('d.title')} <> '' AND {_n('d2.title')} = {_n('d.title')}) OR ({_loose('d.title', '')} <> '' AND {_loose('d2.title', '')} = {_loose('d.title', '')}) AS is_k, {_n('d.title')} <> '' OR {_loose('d.title', '')} <> '' AS is_g,
        {_n('d.title')} <> '' AS text_g, {_n('d.title')} <> '' AND (contains({_n('d2.text')}, {_n('d.title')}) OR contains({_n("coalesce(tr.tr, '')")}, {_n('d.title')})) AS text_k,
        true AS mark_g, EXISTS (SELECT 1 FROM t2 WHERE t2.doc = d.doc AND (contains({_n('t2.title')}, {_n("'higher ' || d.lang")}) OR contains({_loose('t2.title')}, {_loose("'higher ' || d.lang")}))) AS mark_k,
        EXISTS (SELECT 1 FROM f WHERE f.doc = d.doc AND {_n('label')} = 'again') AS field_g, EXISTS (SELECT 1 FROM f2 WHERE f2.doc = d.doc AND {_n('label')} = 'again') AS field_k FROM d JOIN d2 USING (doc) LEFT JOIN tr USING (doc)),
    aa AS (SELECT doc, (lang_g AND lang_k)::BIGINT + (has_g AND has_k)::BIGINT + (is_g AND is_k)::BIGINT + (text_g AND text_k)::BIGINT AS rp, (NOT lang_g)::BIGINT + (NOT has_g)::BIGINT + (NOT is_g)::BIGINT + (NOT text_g)::BIGINT AS ri, (mark_g AND mark_k)::BIGINT + (field_g AND field_k)::BIGINT AS hp, (NOT mark_g)::BIGINT + (NOT field_g)::BIGINT AS hi FROM asked)
    SELECT d.doc, d.pages = d2.pages AS page_count_match, d2.lang = d.lang OR starts_with(d2.lang, upper(d.lang) || '-') AS document_lang_match,
    ({_n('d.title')} <> '' AND {_n('d2.title')} <> '' AND (contains({_n('d2.title')}, {_n('d.title')}) OR contains({_n('d.title')}, {_n('d2.title')}))) OR {_in_title('d2.title', 'd.title')} OR {_in_title('d.title', 'd2.title')} OR {_in_order('d2.title', 'd.title')} OR {_in_order('d.title', 'd2.title')} AS title_match,
    coalesce(types, '') AS types, {_rate('matched_typed', 'gold_typed')} AS recoverable_type_recall, ro.n AS fragments_considered, ro.hits AS matched_fragments, kept AS ordered_fragments, round(ro.hits / greatest(ro.n, 1)::DOUBLE, 4) AS hit_rate, CASE WHEN ro.hits > 0 THEN round(kept / ro.hits::DOUBLE, 4) ELSE 0.0::DOUBLE END AS order_rate,
    CASE WHEN nothing THEN 'none' WHEN dense THEN 'dense' ELSE 'exact' END AS match_mode, coalesce(gold_typed, 0) AS gold_typed, coalesce(matched_typed, 0) AS matched_typed, coalesce(fa.n, 0) AS gold_fields, (SELECT count(*) FROM f2 WHERE f2.doc = d.doc) AS candidate_fields, coalesce(fa.hits, 0) AS matched_fields, coalesce(fa.hits, 0) AS matched_field_types,
    coalesce(fa.named, 0) AS gold_named_fields, coalesce(fa.same, 0) AS matched_named_fields, coalesce(la.n, 0) AS gold_links, (SELECT count(*) FROM l2 WHERE l2.doc = d.doc) AS candidate_links, coalesce(la.d, 0) AS gold_descriptive_links, coalesce(la.same, 0) AS matched_descriptive_links,
    coalesce(m.n, 0) AS bookmark_gold_total, coalesce(m.matched, 0) AS bookmark_matched_titles, rp AS recoverable_passed, 4 - rp - ri AS recoverable_failed, ri AS recoverable_invalid, hp AS hidden_passed, 2 - hp - hi AS hidden_failed, hi AS hidden_invalid
    FROM d JOIN d2 USING (doc) JOIN ro USING (doc) JOIN aa USING (doc) LEFT JOIN ty USING (doc) LEFT JOIN fa USING (doc) LEFT JOIN la USING (doc) LEFT JOIN m USING (doc)"""))
def e17_whole(spark, folder):
    """The whole comparison but for the two likenesses of texts, which SQL can't state."""
    found = O.compare_documents(*sides(spark, folder), assertions(spark, folder))
    types = F.array_join(F.transform("types", lambda x: F.concat_ws("", x["type"], F.lit(":"), x["gold"], F.lit("/"), x["candidate"])), ",")
    return found.select(
        "doc", "page_count_match", "document_lang_match", "title_match", F.coalesce(types, F.lit("")).alias("types"), "recoverable_type_recall", "fragments_considered", "matched_fragments", "ordered_fragments", "hit_rate", "order_rate", "match_mode", *_COUNTS)
