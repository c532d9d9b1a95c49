"""A candidate document held against its gold one: description, structure, fields, links, bookmarks and assertions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.functions import similarity as X
from foliolens.functions import text as T
from foliolens.functions.sequences import longest_nondecreasing
from foliolens.operators.bookmarks import compare_bookmarks
from foliolens.sources.shipping import ship

c = F.col

# Types whose counts are compared, types that read like bookmarks, limits of a fragment and of lists.
TYPES = ("heading", "paragraph", "list_item", "table", "figure", "note", "code", "formula")
BOOKMARK_TYPES = ("heading", "title", "subtitle", "toc_caption", "toc_group_heading", "toc_item", "toc_item_table")
LEAST_FRAGMENT, MOST_FRAGMENT, MOST_FRAGMENTS, MOST_MISMATCHES = 18, 120, 24, 10


class Side(NamedTuple):
    """The frames of the gold or of the candidate documents; ``pos`` orders the rows of a document."""

    documents: DataFrame  #: doc (one row each), pages, lang, title, text
    elements: DataFrame  #: doc, pos, type, text, caption
    fields: DataFrame  #: doc, pos, page, ord, kind, name, label
    links: DataFrame  #: doc, pos, page, ord, uri, dest, contents, descriptive
    titles: DataFrame  #: doc, pos, title


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4))


def _ordered(*columns: str | Column) -> Column:
    """The rows of a group as an array in the order of ``pos``."""
    return F.array_sort(F.collect_list(F.struct("pos", *columns)))


def _known(column: Column, default: int | str) -> Column:
    return F.coalesce(column, F.lit(default))


def compare_fields(gold: DataFrame, candidate: DataFrame) -> DataFrame:
    """Of each document's gold fields how many the candidate has, with the same type, and with the same label.

    Fields are the same if page, order, type and name agree; of such candidates the last
    counts. Only gold fields with a label can differ in it; ``field_mismatches`` has the first few.
    """
    key = {"page": _known(c("page"), 0), "ord": _known(c("ord"), 0), "kind": _known(c("kind"), ""), "name": T.normalized(c("name"))}
    keys = ["doc", *(f"_{k}" for k in key)]
    keyed = lambda df: df.withColumns({f"_{k}": x for k, x in key.items()})
    last = keyed(candidate).groupBy(*keys).agg(F.max_by(F.struct("kind", "label"), "pos").alias("_hit"))
    rows = keyed(gold).join(last, keys, "left")
    hit, named = c("_hit").isNotNull(), T.collapsed(c("label")) != ""
    label = T.normalized(c("label"))
    same = named & hit & (label != "") & (label == T.normalized(c("_hit.label")))
    wrong = F.when(named & ~same, F.struct("pos", "page", "name", c("label").alias("expected"), F.coalesce("_hit.label", F.lit("")).alias("actual")))
    counted = rows.groupBy("doc").agg(
        F.count(F.lit(1)).alias("gold_fields"), F.count_if(hit).alias("matched_fields"), F.count_if(hit & (T.normalized(c("_hit.kind")) == T.normalized(c("kind")))).alias("matched_field_types"),
        F.count_if(named).alias("gold_named_fields"), F.count_if(same).alias("matched_named_fields"), F.slice(F.array_sort(F.collect_list(wrong)), 1, MOST_MISMATCHES).alias("field_mismatches"))
    rates = {"field_presence_match_rate": ("matched_fields", "gold_fields"), "field_type_match_rate": ("matched_field_types", "gold_fields"), "named_field_match_rate": ("matched_named_fields", "gold_named_fields")}
    return counted.withColumns({k: _rate(c(a), c(b)) for k, (a, b) in rates.items()})


def compare_links(gold: DataFrame, candidate: DataFrame) -> DataFrame:
    """Of each document's descriptive gold links how many the candidate has with contents alike.

    Links are the same if page, order, address and destination agree; of such candidates the
    last counts. Contents are alike if they agree but for punctuation, or hold the gold words in order.
    """
    key = {"page": _known(c("page"), 0), "ord": _known(c("ord"), 0), "uri": T.normalized(c("uri")), "dest": T.normalized(c("dest"))}
    keys = ["doc", *(f"_{k}" for k in key)]
    keyed = lambda df: df.withColumns({f"_{k}": x for k, x in key.items()})
    last = keyed(candidate).groupBy(*keys).agg(F.max_by(F.struct("contents"), "pos").alias("_hit"))
    rows = keyed(gold).join(last, keys, "left")
    said, found, asked = c("contents"), c("_hit.contents"), F.coalesce("descriptive", F.lit(False))
    alike = (T.normalized(said) == T.normalized(found)) | (T.loose(said) == T.loose(found)) | T.matches_ordered_terms(found, said)
    same = asked & c("_hit").isNotNull() & (T.normalized(said) != "") & F.coalesce(alike, F.lit(False))
    wrong = F.when(asked & ~same, F.struct("pos", "page", "uri", said.alias("expected"), F.coalesce(found, F.lit("")).alias("actual")))
    counted = rows.groupBy("doc").agg(
        F.count(F.lit(1)).alias("gold_links"), F.count_if(asked).alias("gold_descriptive_links"), F.count_if(same).alias("matched_descriptive_links"),
        F.slice(F.array_sort(F.collect_list(wrong)), 1, MOST_MISMATCHES).alias("link_mismatches"))
    return counted.withColumn("descriptive_link_match_rate", _rate(c("matched_descriptive_links"), c("gold_descriptive_links")))


def compare_types(gold: DataFrame, candidate: DataFrame) -> DataFrame:
    """Counts of the recoverable types of each document on either side, what both have, and the gold's recall."""
    rows = gold.select("doc", "type", F.lit(True).alias("_g")).unionByName(candidate.select("doc", "type", F.lit(False).alias("_g")))
    counted = rows.groupBy("doc").agg(*[F.count_if((F.trim("type") == t) & (c("_g") == g)).alias(f"_{t}_{g}") for t in TYPES for g in (True, False)])
    each = [(t, c(f"_{t}_True"), c(f"_{t}_False")) for t in TYPES]
    types = F.array_compact(F.array(*[
        F.when((g > 0) | (k > 0), F.struct(F.lit(t).alias("type"), g.alias("gold"), k.alias("candidate"), F.least(g, k).alias("matched"), _rate(F.least(g, k), g).alias("recall"), F.greatest(k - g, F.lit(0)).alias("surplus")))
        for t, g, k in each]))
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    out = counted.select("doc", types.alias("types"), total(g for _, g, _ in each).alias("gold_typed"), total(F.least(g, k) for _, g, k in each).alias("matched_typed"))
    return out.withColumn("recoverable_type_recall", _rate(c("matched_typed"), c("gold_typed")))


def _said(elements: DataFrame) -> DataFrame:
    """(doc, pos, s, f, b): what an element adds to the transcript, to the fragments and to the texts like bookmarks."""
    body = ~(_known(c("type"), "").startswith("toc_") | (_known(c("type"), "") == "artifact"))
    said = T.collapsed(c("text"))
    shown = F.when(said != "", said).when(c("type") == "figure", T.collapsed(c("caption"))).otherwise("")
    norm = T.normalized(c("text"))
    return elements.select(
        "doc", "pos", F.when(body, shown).otherwise("").alias("s"), F.when(body & (F.length(norm) >= LEAST_FRAGMENT), F.substring(norm, 1, MOST_FRAGMENT)).alias("f"),
        F.when(c("type").isin(*BOOKMARK_TYPES) & (said != ""), said).alias("b"))


def _read(rows: Column) -> dict[str, Column]:
    """Transcript, fragments and sources of a document's rows of ``_said`` in order."""
    picked = lambda k: F.array_compact(F.transform(rows, lambda x: x[k]))
    return {"transcript": F.array_join(F.filter(picked("s"), lambda x: x != ""), " "), "fragments": F.slice(F.array_distinct(picked("f")), 1, MOST_FRAGMENTS), "sources": picked("b")}


def transcripts(elements: DataFrame) -> DataFrame:
    """(doc, transcript, fragments, sources): a document's texts in a row, its first distinct beginnings of longer ones, and texts like bookmarks.

    Artifacts and parts of a table of contents are in neither of the first two; a figure without a text has its caption.
    """
    listed = _said(elements).groupBy("doc").agg(_ordered("s", "f", "b").alias("_a"))
    return listed.select("doc", *[x.alias(k) for k, x in _read(c("_a")).items()])


def with_reading_order(rows: DataFrame) -> DataFrame:
    """``rows`` (fragments, transcript, …) with how many fragments the transcript holds, and holds in order.

    They are looked for as they are and without blanks and punctuation; the way that finds
    more counts, then the way with more in order, then the former.
    """
    at = lambda text, xs: F.filter(F.transform(xs, lambda x: F.instr(text, x)), lambda p: p > 0)
    found = rows.withColumns({
        "_exact": at(c("transcript"), c("fragments")), "_dense": at(T.dense(c("transcript")), F.transform("fragments", T.dense))})
    ordered = found.withColumns({"_eo": longest_nondecreasing(c("_exact")), "_do": longest_nondecreasing(c("_dense"))})
    dense = (F.size("_dense") > F.size("_exact")) | ((F.size("_dense") == F.size("_exact")) & (c("_do") > c("_eo")))
    none = (F.size("fragments") == 0) | (c("transcript") == "")
    hits, kept = F.when(dense, F.size("_dense")).otherwise(F.size("_exact")), F.when(dense, c("_do")).otherwise(c("_eo"))
    return ordered.withColumns({
        "fragments_considered": F.size("fragments"), "matched_fragments": hits, "ordered_fragments": kept, "hit_rate": F.round(hits / F.greatest(F.size("fragments"), F.lit(1)), 4),
        "order_rate": F.when(hits > 0, F.round(kept / hits, 4)).otherwise(0.0), "match_mode": F.when(none, "none").when(dense, "dense").otherwise("exact"),
    }).drop("_exact", "_dense", "_eo", "_do")


def _gathered(gold: Side, candidate: Side, assertions: DataFrame | None) -> DataFrame:
    """One row for each document on both sides: ``g_`` and ``k_`` document, elements, titles, fields and links, and what is asked.

    All frames are dealt and gathered by document once, so a task holds one sort, not one for each frame.
    """
    listed = {"elements": ("pos", "s", "f", "b"), "titles": ("pos", "title"), "fields": ("pos", "page", "kind", "name", "label"), "links": ("pos", "page", "uri", "dest", "contents")}
    parts = {}
    for p, side in (("g", gold), ("k", candidate)):
        parts[f"{p}_document"] = side.documents.select("doc", F.struct("pages", "lang", "title", "text").alias(f"{p}_document"))
        frames = side._asdict() | {"elements": _said(side.elements)}
        parts |= {f"{p}_{k}": frames[k].select("doc", F.struct(*names).alias(f"{p}_{k}")) for k, names in listed.items()}
    if assertions is not None:
        parts["asked"] = assertions.select("doc", F.struct(*[k for k in assertions.columns if k != "doc"]).alias("asked"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values()).where(c("doc").isNotNull()).repartition("doc")
    one = lambda k: F.first(k, ignorenulls=True) if k.endswith("_document") else F.collect_list(k) if k == "asked" else F.array_sort(F.collect_list(k))
    return rows.groupBy("doc").agg(*[one(k).alias(k) for k in parts]).where("g_document is not null and k_document is not null")


def _holds(a: Column, f: dict[str, Column]) -> Column:
    """Whether an assertion (kind, expected, page, field_name, field_type, uri, dest, match_mode, terms_all, terms_any) holds of features (lang, title, sources, titles, fields, links); null for an unknown kind."""
    lists = {k: F.coalesce(a[k], F.array().cast("array<string>")) for k in ("expected", "terms_all", "terms_any")}
    first = F.get(lists["expected"], F.lit(0))
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    has_all = lambda name: F.forall(lists["terms_all"], lambda t: F.contains(name, T.normalized(t)))
    has_any = lambda name: (F.size(lists["terms_any"]) == 0) | F.exists(lists["terms_any"], lambda t: F.contains(name, T.normalized(t)))
    meant = F.filter(f["fields"], lambda x: (a["page"].isNull() | (_known(x["page"], 0) == a["page"])) & (~given(a["field_type"]) | (_known(x["kind"], "") == a["field_type"]))
                     & (~given(a["field_name"]) | (T.normalized(x["name"]) == T.normalized(a["field_name"]))))
    label_holds = lambda x: F.when(
        F.size(lists["expected"]) > 0, F.exists(lists["expected"], lambda e: F.when(a["match_mode"] == "contains", T.matches_text(x["label"], e, False)).otherwise(T.matches_text(x["label"], e, True)))
    ).otherwise((T.normalized(x["label"]) != "") & (F.size(lists["terms_all"]) + F.size(lists["terms_any"]) > 0) & has_all(T.normalized(x["label"])) & has_any(T.normalized(x["label"])))
    link_holds = lambda x: (
        (a["page"].isNull() | (_known(x["page"], 0) == a["page"])) & (~given(a["uri"]) | (T.normalized(x["uri"]) == T.normalized(a["uri"]))) & (~given(a["dest"]) | (T.normalized(x["dest"]) == T.normalized(a["dest"])))
        & (T.matches_text(x["contents"], first, True) | ((T.loose(first) != "") & (T.loose(x["contents"]) == T.loose(first))) | T.matches_ordered_terms(x["contents"], first)))
    parts = F.filter(F.transform(lists["expected"], T.normalized), lambda p: p != "")
    in_order = lambda s: F.aggregate(parts, F.lit(1), lambda k, p: F.when((k > 0) & (F.position(p, T.normalized(s), k) > 0), F.position(p, T.normalized(s), k) + F.length(p)).otherwise(0)) > 0
    loosely = lambda x, e: (T.loose(x) != "") & (T.loose(e) != "") & F.contains(T.loose(x), T.loose(e))
    kind, title = a["kind"], f["title"]
    subtag = T.primary_subtag(first)
    return (
        F.when(kind == "document_lang", (subtag != "") & (subtag == T.primary_subtag(f["lang"])))
        .when(kind == "title_equals", T.matches_text(title, first, True) | ((T.title_key(first) != "") & (T.title_key(title) == T.title_key(first))))
        .when(kind == "title_contains", T.matches_text(title, first, False) | T.matches_title(title, first) | T.matches_ordered_terms(title, first))
        .when(kind == "text_contains", F.exists(f["sources"], lambda s: T.matches_text(s, first, False)))
        .when(kind == "ordered_text", (F.size(parts) > 0) & F.exists(f["sources"], in_order))
        .when(kind.isin("field_present", "field_type"), F.size(meant) > 0)
        .when(kind == "field_accessible_name", F.exists(meant, label_holds))
        .when(kind == "link_contents", F.exists(f["links"], link_holds))
        .when(kind == "bookmark_title", F.exists(f["titles"], lambda t: T.matches_text(t, first, False) | loosely(t, first))))


def evaluate_assertions(assertions: Column, gold: dict[str, Column], candidate: dict[str, Column]) -> Column:
    """(set, status) of each of a document's assertions (set, id, and what ``_holds`` names).

    One that doesn't hold of the gold document, or is of an unknown kind, is invalid; the
    others pass or fail by the candidate. ``gold`` and ``candidate`` are features as ``_holds`` names them.
    """
    held = lambda a, f: F.coalesce(_holds(a, f), F.lit(False))
    return F.transform(assertions, lambda a: F.struct(a["set"].alias("set"), F.when(~held(a, gold), "invalid").when(held(a, candidate), "pass").otherwise("fail").alias("status")))


def _alike(a: Column, b: Column) -> Column:
    fixed = X.mapped("string", X.repaired)
    return F.round(F.pandas_udf(lambda x, y: x.combine(y, X.indel_ratio).astype("float64"), "double")(fixed(a), fixed(b)), 4)


def compare_documents(gold: Side, candidate: Side, assertions: DataFrame | None = None) -> DataFrame:
    """One row for each document on both sides: all comparisons, rates null where there is nothing to match.

    The frames of both sides are gathered by document once; fields and links are compared by
    equi-joins on their keys; only lists of one document are gathered. ``assertions`` (see
    ``evaluate_assertions``) add counts by status for the sets "recoverable" and "hidden".
    """
    ship(gold.documents.sparkSession)
    marked = lambda k: F.filter(F.transform(k, lambda x: x["title"]), lambda t: T.collapsed(t) != "")
    rows = _gathered(gold, candidate, assertions).select(
        "*", *[c(f"{p}_document")[k].alias(f"{own}{k}") for p, own in (("g", ""), ("k", "_")) for k in ("pages", "lang", "title", "text")],
        *[x.alias({"transcript": "gold_transcript"}.get(k, k)) for k, x in _read(c("g_elements")).items()], *[x.alias({"fragments": "_fragments"}.get(k, k)) for k, x in _read(c("k_elements")).items() if k != "sources"],
    ).drop("g_document", "k_document", "g_elements", "k_elements")
    title, other = c("title"), c("_title")
    tag = T.primary_subtag(c("lang"))
    either = lambda match: match(title, other) | match(other, title)
    described = {
        "page_count_match": c("pages").eqNullSafe(c("_pages")), "document_lang_match": (tag != "") & (tag == T.primary_subtag(c("_lang"))),
        "title_match": either(lambda a, b: T.matches_text(a, b, False)) | either(T.matches_title) | either(T.matches_ordered_terms),
        "gold_chars": F.length(T.text_of(c("text"))), "candidate_chars": F.length(T.text_of(c("_text"))), "raw_text_similarity": _alike(c("text"), c("_text")),
        "transcript_similarity": _alike(c("gold_transcript"), c("transcript")), "candidate_fragments": F.size("_fragments"),
        **{k: c(k) for k in ("fragments_considered", "matched_fragments", "ordered_fragments", "hit_rate", "order_rate", "match_mode")},
        "candidate_fields": F.size("k_fields").cast("bigint"), "candidate_links": F.size("k_links").cast("bigint")}
    if assertions is not None:
        texts = {"g": ("text", "gold_transcript"), "k": ("_text", "transcript")}
        rows = rows.withColumns({f"{p}_sources": F.filter(F.array(*[T.collapsed(c(t)) for t in ts]), lambda x: x != "") for p, ts in texts.items()})
        features = lambda p, own: {"lang": c(f"{own}lang"), "title": c(f"{own}title"), "sources": c(f"{p}_sources"), "titles": F.transform(f"{p}_titles", lambda x: x["title"]), "fields": c(f"{p}_fields"), "links": c(f"{p}_links")}
        rows = rows.withColumn("judged", evaluate_assertions(c("asked"), features("g", ""), features("k", "_")))
        counted = lambda s, v: F.size(F.filter("judged", lambda x: (x["set"] == s) & (x["status"] == v))).cast("bigint")
        described |= {
            f"{s}_{n}": counted(s, v)
            for s in ("recoverable", "hidden") for v, n in (("pass", "passed"), ("fail", "failed"), ("invalid", "invalid"))}
    marks = compare_bookmarks(with_reading_order(rows).select("doc", marked("g_titles").alias("gold"), marked("k_titles").alias("candidate"), "sources", *[x.alias(k) for k, x in described.items()]), *described)
    marks = marks.select("doc", *described, *[c(k).alias(f"bookmark_{k}") for k in marks.columns if k != "doc" and k not in described])
    more = [compare_types(gold.elements, candidate.elements), compare_fields(gold.fields, candidate.fields), compare_links(gold.links, candidate.links)]
    out = reduce(lambda df, x: df.join(x, "doc", "left"), more, marks)
    return out.withColumns({k: _known(c(k), 0) for k, kind in out.dtypes if kind in ("bigint", "int") and k != "doc"})
