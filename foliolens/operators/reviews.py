"""Summaries of answers to a task, and whether proposed changes fit what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.functions import geometry as G
from foliolens.functions import text as T

#: A sibling is far larger from this factor on; a child's share of the largest is at most this; siblings named.
FAR_LARGER, CHILD_SHARE, MOST_SIBLINGS = 8.0, 0.02, 4
REASON_CHARS = 1000


def figure_context(figures: DataFrame) -> DataFrame:
    """(page, box, area, relative, child, siblings) of figures (page, box, l, b, r, t, caption).

    siblings are the first few far larger figures of the page; a figure without caption and
    with almost no area beside such is a child. A page is taken to be a bounded group.
    """
    rows = figures.withColumn("area", F.coalesce(G.area(G.box()), F.lit(0.0)))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("box", "area"))).alias("_all"), F.max("area").alias("_most"))
    far = F.transform(F.filter("_all", lambda x: (x["box"] != F.col("box")) & (x["area"] > F.col("area") * FAR_LARGER)), lambda x: x["box"])
    joined = rows.join(pages, "page").withColumn("_far", far)
    share = F.when(F.col("_most") > 0, F.col("area") / F.col("_most")).otherwise(0.0)
    child = (F.coalesce(F.col("caption"), F.lit("")) == "") & (F.col("area") > 0) & (share <= CHILD_SHARE) & (F.size("_far") > 0)
    return joined.select("page", "box", F.round("area", 2).alias("area"), F.round(share, 4).alias("relative"), child.alias("child"), F.slice("_far", 1, MOST_SIBLINGS).alias("siblings"))


def confidence_rank(label: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(low == "high", 2).when(low == "medium", 1).otherwise(0)


def table_summary(items: DataFrame, key: str) -> DataFrame:
    """One row for each task from its answers (key, pos, table_id, confidence, action, reason), each about a table.

    The least confidence counts. Of a table's answers that change it the first does; header
    changes go before reclassification, that before manual work. Reasons are named once, in
    order. Answers of one task are taken to be a bounded group.
    """
    c = F.col
    action, table_id = F.trim(F.coalesce("action", F.lit(""))), T.collapsed(c("table_id"))
    rows = items.select(key, "pos", table_id.alias("_table"), action.alias("_action"), confidence_rank(c("confidence")).alias("_rank"), T.collapsed(c("reason")).alias("_reason"))
    changes = c("_action").isin("set_table_headers", "reclassify_region") & (c("_table") != "")
    tables = rows.groupBy(key, "_table").agg(
        F.min_by(F.when(changes, c("_action")), F.when(changes, c("pos"))).alias("_first"), F.min("_rank").alias("_rank"), F.count(F.lit(1)).alias("_n"),
        *[F.count_if(c("_action") == a).alias(f"_{n}") for n, a in (("manual", "manual_only"), ("confirm", "confirm_current_headers"), ("moved", "reclassify_region"))],
        F.collect_list(F.when(c("_reason") != "", F.struct("pos", "_reason"))).alias("_reasons"))
    told = tables.groupBy(key).agg(
        F.sum("_n").alias("total"), F.min("_rank").alias("_rank"), F.count_if(c("_first") == "set_table_headers").alias("proposed"), F.count_if(c("_first") == "reclassify_region").alias("reclassified"),
        *[F.sum(n).alias(n) for n in ("_manual", "_confirm", "_moved")],
        F.array_distinct(F.transform(F.array_sort(F.flatten(F.collect_list("_reasons"))), lambda x: x["_reason"])).alias("_reasons"))
    left = F.greatest(c("total") - c("proposed") - c("_confirm"), F.lit(0), c("_manual"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    reviewed = text("Reviewed ", c("total"), " tables; ")
    summary = (
        F.when((c("proposed") > 0) & (left > 0), text(reviewed, "proposed header updates for ", c("proposed"), " and left ", left, " needing manual follow-up."))
        .when(c("proposed") > 0, text(reviewed, "proposed header updates for ", c("proposed"), "."))
        .when(c("_moved") > 0, text(reviewed, c("_moved"), F.when(c("_moved") == 1, " region was").otherwise(" regions were"), " identified as not actually being data tables."))
        .when(c("_confirm") == c("total"), text(reviewed, "current header flags look acceptable."))
        .otherwise(text(reviewed, "manual follow-up is still required.")))
    chosen = (
        F.when(c("proposed") > 0, "set_table_headers").when((c("reclassified") > 0) | (c("_moved") > 0), "reclassify_region")
        .when(c("_manual") > 0, "manual_only").otherwise("confirm_current_headers"))
    label = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), c("_rank") + 1)
    return told.select(key, "total", "proposed", "reclassified", label.alias("confidence"), chosen.alias("action"), summary.alias("summary"), F.substring(F.array_join("_reasons", " "), 1, REASON_CHARS).alias("reason"))


def order_fits(current: Column, proposed: Column) -> Column:
    """Whether a proposed order names exactly the ids there are, each once; false for no ids or a null."""
    return F.coalesce((F.size(current) > 0) & (F.size(current) == F.size(proposed)) & (F.size(F.array_distinct(proposed)) == F.size(proposed)) & (F.size(F.array_except(proposed, current)) == 0), F.lit(False))


def updates_fit(updates: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """(key, valid): every update (key, table_id, action) sets headers, or names no action, and hits a table (table_id) that has cells."""
    known = tables.select("table_id").distinct().withColumn("_known", F.lit(True))
    fits = F.trim(F.coalesce("action", F.lit(""))).isin("", "set_table_headers") & F.coalesce("_known", F.lit(False))
    return updates.join(known, "table_id", "left").groupBy(key).agg(F.bool_and(fits).alias("valid"))


def once_in_order(items: Column, sep: str = " ", most: int = REASON_CHARS) -> Column:
    """Texts of an array of (pos, text), each named once, by their first places; blank ones left out."""
    texts = F.transform(F.array_sort(items), lambda x: T.collapsed(x["text"]))
    return F.substring(F.array_join(F.array_distinct(F.filter(texts, lambda x: x != "")), sep), 1, most)


def order_summary(items: DataFrame, key: str) -> DataFrame:
    """One row for each reading-order task from its pages' answers (key, pos, page, confidence, action, reason, summary, ids).

    The least confidence counts; reordering goes before hiding headers, that before manual
    work. Orders are proposed where a page names ids. Pages of one task are a bounded group.
    """
    c = F.col
    asked = lambda a: F.bool_or(T.collapsed(c("action")) == a)
    rows = items.groupBy(key).agg(
        F.min(confidence_rank(c("confidence"))).alias("_rank"), *[asked(a).alias(a) for a in ("reorder_review", "artifact_headers_footers", "manual_only")],
        *[F.collect_list(F.struct("pos", F.col(n).alias("text"))).alias(f"_{n}") for n in ("reason", "summary")],
        F.count_if((c("page") > 0) & (F.size(F.filter(F.coalesce("ids", F.expr("cast(array() as array<string>)")), lambda x: F.trim(x) != "")) > 0)).alias("orders"), F.count_if(c("page") > 0).alias("focus"))
    action = F.when(c("reorder_review"), "reorder_review").when(c("artifact_headers_footers"), "artifact_headers_footers").when(c("manual_only"), "manual_only").otherwise("confirm_current_order")
    plain = F.when(action == "confirm_current_order", "Current reading order looks acceptable on the reviewed pages.").when(action == "manual_only", "Reading order still needs manual follow-up.").otherwise("Review the proposed reading order changes.")
    label = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), c("_rank") + 1)
    return rows.select(key, action.alias("action"), label.alias("confidence"), F.coalesce(F.nullif(once_in_order(c("_summary")), F.lit("")), plain).alias("summary"), once_in_order(c("_reason")).alias("reason"), "orders", "focus")


def merged_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """One row for each candidate list of contents from its chunks (key, pos, is_toc, confidence, reason, caption, entry_indexes, entry_types).

    Only chunks that are contents with high or medium confidence add entries; of types of
    one entry the last counts, of captions the first; the best confidence of all chunks is
    the whole's. Chunks of one list are a bounded group.
    """
    c = F.col
    label = F.lower(F.trim(F.coalesce("confidence", F.lit(""))))
    rank = F.when(label == "high", 2).when(label == "medium", 1).when(label == "low", 0).otherwise(-1)
    good = F.coalesce(c("is_toc"), F.lit(False)) & (rank >= 1)
    part = F.struct("pos", "reason", "caption", "entry_indexes", F.map_entries("entry_types").alias("entry_types"))  # maps have no order
    rows = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"), F.max(rank).alias("_rank"), F.array_sort(F.collect_list(F.when(good, part))).alias("_kept"))
    texts = lambda n: F.filter(F.transform("_kept", lambda e: T.collapsed(e[n])), lambda t: t != "")
    indexes = F.array_sort(F.array_distinct(F.flatten(F.transform("_kept", lambda e: F.coalesce(e["entry_indexes"], F.expr("cast(array() as array<int>)"))))))
    none = F.expr("cast(map() as map<string,string>)")
    full = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    tidy = lambda m: F.map_from_entries(F.transform(F.filter(F.coalesce(m, F.map_entries(none)), lambda e: full(e["key"]) & full(e["value"])), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value"))))
    later = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    types = F.aggregate("_kept", none, lambda m, e: later(m, tidy(e["entry_types"])))
    best = F.when(c("_rank") >= 0, F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.greatest(c("_rank"), F.lit(0)) + 1)).otherwise("low")
    return rows.select(
        key, (F.size("_kept") > 0).alias("is_toc"), best.alias("confidence"), F.array_join(F.slice(texts("reason"), 1, 3), " ").alias("reason"), indexes.alias("entry_indexes"),
        types.alias("entry_types"), F.coalesce(F.get(texts("caption"), F.lit(0)), F.lit("")).alias("caption"), "chunk_count")


EXAMPLES = 5


def repair_gate(fonts: DataFrame, key: str) -> DataFrame:
    """One row for each document from its fonts: whether maps may be repaired by rule, counts, first distinct blocked fonts, and why.

    Fonts have (key, pos, subtype, descendant, embedded, mapped, unread, missing,
    repairable, policy, base_font) and the document's rule families (unicode_rules,
    invalid_rules). Fonts of one document are a bounded group.
    """
    c = F.col
    no = lambda n: F.coalesce(c(n), F.lit(0))
    yes = lambda n: F.coalesce(c(n), F.lit(False))
    composite = (c("subtype") == "/Type0") & (c("descendant") == "/CIDFontType2") & yes("embedded") & (yes("unicode_rules") | ~yes("mapped") | yes("invalid_rules"))
    simple = c("subtype").isin("/Type1", "/MMType1", "/TrueType") & (~yes("mapped") | (no("unread") > 0) | (no("missing") > 0) | yes("invalid_rules"))
    sure = F.coalesce(c("policy"), F.lit("")).isin("explicit", "standard14", "embedded_cff") & ((no("unread") > 0) | (no("repairable") > 0))
    name = F.coalesce(F.nullif(c("base_font"), F.lit("")), F.lit("(unnamed)"))
    n = fonts.groupBy(key).agg(
        F.count_if(composite).alias("safe_type0"), F.count_if(simple & sure).alias("safe_simple"), F.count_if(simple & ~sure).alias("blocked"),
        F.array_sort(F.collect_list(F.when(simple & ~sure, F.struct("pos", name.alias("text"))))).alias("_names"))
    examples = F.array_join(F.slice(F.array_distinct(F.transform("_names", lambda x: x["text"])), 1, EXAMPLES), ", ")
    safe = c("safe_type0") + c("safe_simple")
    reason = (
        F.when(safe > 0, "deterministic font candidates available")
        .when(c("blocked") > 0, F.concat(F.lit("unicode issues appear tied to simple fonts without explicit encoding ("), examples, F.lit(")")))
        .otherwise("no deterministic ToUnicode candidates found"))
    return n.select(key, (safe > 0).alias("automatic"), "safe_type0", "safe_simple", "blocked", examples.alias("examples"), reason.alias("reason"))
