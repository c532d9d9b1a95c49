"""Operators over a document's elements and trees: contents runs, figure context, title bookmarks, orders, walks, statuses.

A document, its pages and its tree are bounded groups: a group is one window or one task's
work, and the number of groups is what grows.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import text as T
from foliolens.sources.shipping import ship

# Texts of a contents heading, types that hold text, keys of a status, and limits.
CONTENTS_HEADINGS = ("contents", "table of contents")
ENTRY_TYPES = ("paragraph", "list_item", "heading")
TEXT_TYPES = ("heading", "paragraph", "note", "list_item")
STATUS_KEYS = ("status", "result", "state")
TITLE_FRAGMENTS, MOST_LEVELS = 4, 6

c = F.col


def contents_runs(elements: DataFrame) -> DataFrame:
    """(doc, pos, kind, grp): contents headings followed by entries, and those entries, numbered within a document.

    ``elements`` is (doc, pos, type, text). A run goes on over artifacts and ends at the
    first other element that is no entry; each such element opens an island, and an island
    that a contents heading opens is a run. Headings without an entry are left out.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    entry = c("type").isin(*ENTRY_TYPES) & T.is_toc_entry(c("text"))
    opens = ~entry & (c("type") != "artifact")
    caption = opens & (c("type") == "heading") & F.lower(T.collapsed(c("text"))).isin(*CONTENTS_HEADINGS)
    islands = elements.select(
        "doc", "pos", entry.alias("entry"), F.last(F.when(opens, c("pos")), ignorenulls=True).over(w).alias("head"),
        F.last(F.when(opens, caption), ignorenulls=True).over(w).alias("run"))
    kept = islands.where("run and (entry or pos = head)").withColumn("entries", F.count_if("entry").over(Window.partitionBy("doc", "head"))).where("entries > 0")
    return kept.select("doc", "pos", F.when(c("entry"), "toc_item").otherwise("toc_caption").alias("kind"), (F.dense_rank().over(Window.partitionBy("doc").orderBy("head")) - 1).alias("grp"))


def figure_context(elements: DataFrame) -> DataFrame:
    """(doc, pos, heading, before, after) of each figure: the nearest heading before it on its page, and up to two texts on either side."""
    said = F.when(c("type").isin(*TEXT_TYPES) & (T.collapsed(c("text")) != ""), T.collapsed(c("text")))
    rows = elements.select("doc", "page", "pos", "type", said.alias("said"))
    w = "OVER (PARTITION BY doc, page ORDER BY pos)"
    near = {name: F.expr(f"{fn}(said, {k}) IGNORE NULLS {w}") for name, fn, k in (("b2", "lag", 2), ("b1", "lag", 1), ("a1", "lead", 1), ("a2", "lead", 2))}
    heading = F.last(F.when(c("type") == "heading", c("said")), ignorenulls=True).over(Window.partitionBy("doc", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({**near, "heading": heading}).where("type = 'figure'").select(
        "doc", "pos", F.coalesce("heading", F.lit("")).alias("heading"), F.concat_ws(" | ", "b2", "b1").alias("before"), F.concat_ws(" | ", "a1", "a2").alias("after"))


def title_bookmarks(documents: DataFrame) -> DataFrame:
    """(doc, entries): the heading bookmarks, of which two or more first-page pieces of the title give way to one for the whole title.

    ``documents`` is (doc, title, has_toc, entries), the entries in order with text, page (from 0)
    and level. Nothing changes beside a contents list, or where one of the first four
    entries of the first page is the title itself.
    """
    key = T.title_like(c("title"))
    first = F.slice(F.filter("entries", lambda e: e["page"] == 0), 1, TITLE_FRAGMENTS)
    keys = F.transform(first, lambda e: T.title_like(e["text"]))
    pieces = F.size(F.filter(keys, lambda k: (k != "") & F.contains(key, k)))
    whole = F.coalesce(key != "", F.lit(False)) & ~c("has_toc") & (pieces >= 2) & ~F.array_contains(keys, key)
    title = F.regexp_replace("title", r"(?<=\b[A-Z])\s+(?=[A-Z]\b)", "")
    rest = F.filter("entries", lambda e: (e["page"] != 0) | (T.title_like(e["text"]) == "") | ~F.contains(key, T.title_like(e["text"])) | (T.title_like(e["text"]) == key))
    entry = F.struct(title.alias("text"), F.lit(0).alias("page"), F.lit(1).alias("level"))
    like = documents.schema["entries"].dataType.elementType
    return documents.select("doc", F.when(whole, F.concat(F.array(entry.cast(like)), rest)).otherwise(c("entries")).alias("entries"))


def reordered(elements: DataFrame, orders: DataFrame) -> DataFrame:
    """(page, pos, id): the elements of a page put into its places in the order asked for.

    ``elements`` is (page, pos, id), ``orders`` (page, ids). An order that isn't exactly the
    page's ids changes nothing, nor does a page without one.
    """
    pages = elements.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("own")).join(orders, "page", "left")
    ids = F.transform("own", lambda x: x["id"])
    fits = F.coalesce(F.array_sort(ids) == F.array_sort("ids"), F.lit(False))
    return pages.select("page", F.explode(F.arrays_zip(F.transform("own", lambda x: x["pos"]).alias("pos"), F.when(fits, c("ids")).otherwise(ids).alias("id"))).alias("x")).select("page", "x.pos", "x.id")


def tagging_regressions(now: dict[str, Column], before: dict[str, Column]) -> Column:
    """What a candidate lost: kinds gone, kinds of five or more that fell below four fifths, fewer links; counts below 0 are 0."""
    found = []
    for kind in before:
        a, b = F.greatest(F.coalesce(before[kind], F.lit(0)), F.lit(0)), F.greatest(F.coalesce(now[kind], F.lit(0)), F.lit(0))
        change = lambda word, a=a, b=b, kind=kind: F.concat(F.lit(f"{kind} {word} ("), a.cast("string"), F.lit(" -> "), b.cast("string"), F.lit(")"))
        if kind == "links":
            found.append(F.when((a > 0) & (b < a), change("decreased")))
        else:
            found.append(F.when((a > 0) & (b == 0), change("dropped to zero")).when((a >= 5) & (b < F.floor(a * 0.8)), change("dropped significantly")))
    return F.array_compact(F.array(*found))


def statuses(text: str | None) -> list[str]:
    """Trimmed lower-case strings under a status key, at any depth of a JSON text; none for what is no JSON."""
    try:
        open_ = [json.loads(text or "null")]
    except ValueError:
        return []
    found = []
    while open_:
        value = open_.pop()
        if isinstance(value, dict):
            found += [v.strip().lower() for k, v in value.items() if k.lower() in STATUS_KEYS and isinstance(v, str)]
        open_ += value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return found


def status_counts(reports: DataFrame, report: str) -> DataFrame:
    """(status, n) over all reports; each is walked in an Arrow batch, and counts are reduced before the shuffle."""
    ship(reports.sparkSession)
    walk = F.pandas_udf(lambda s: s.map(statuses, na_action=None).astype("object") if len(s) else pd.Series([], dtype="object"), "array<string>")
    return reports.select(F.explode(walk(report)).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def walked(nodes: DataFrame) -> DataFrame:
    """(doc, node, parent, depth, place, path, said, open): each document's trees, depth first.

    ``nodes`` is (doc, node, parent, pos, label), bigint but for the label; a null parent
    is a root, children go by pos, then node. ``place`` counts from 0, ``path`` joins the
    labels from the root, ``said`` tells whether a label in the node's subtree isn't empty,
    ``open`` whether those of the node and all above it are not. Nodes on no tree (a parent
    that is missing, a circle) are left out.
    """
    ship(nodes.sparkSession)

    def walk(table: pa.Table) -> pa.Table:
        doc, rows = table["doc"][0].as_py(), sorted(zip(*(table[k].to_pylist() for k in ("pos", "node", "parent", "label")), strict=True), key=lambda r: r[:2])
        below: dict[int | None, list] = {}
        for _, node, parent, label in rows:
            below.setdefault(parent, []).append((node, label or ""))
        out: list[list] = []
        at: dict[int, int] = {}
        open_ = [(node, None, 0, "", True, label) for node, label in reversed(below.get(None, []))]
        while open_:
            node, parent, depth, path, free, label = open_.pop()
            at[node] = len(out)
            path, free = f"{path}/{label}", free and label != ""
            out.append([doc, node, parent, depth, len(out), path, label != "", free])
            open_ += [(n, node, depth + 1, path, free, x) for n, x in reversed(below.get(node, []))]
        for row in reversed(out):
            if row[6] and row[2] is not None:
                out[at[row[2]]][6] = True
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
        names = ("doc", "node", "parent", "depth", "place", "path", "said", "open")
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))})

    return nodes.groupBy("doc").applyInArrow(walk, "doc bigint, node bigint, parent bigint, depth int, place int, path string, said boolean, open boolean")


def native_bookmarks(nodes: DataFrame, headings: DataFrame, pages: Column) -> DataFrame:
    """(doc, node, page, level): tree nodes whose label is a heading's, each (label, page) once, depth first.

    ``headings`` is (doc, title, page, pos); the first of a title counts, and only on one of
    the document's ``pages``. A node without a label hides its subtree; other nodes without
    a heading don't.
    """
    first = headings.select("doc", T.title_like(c("title")).alias("key"), "page", "pos").where("key <> ''").groupBy("doc", "key").agg(F.min_by("page", "pos").alias("page"))
    rows = walked(nodes).where("open").join(nodes.select("doc", "node", "label"), ["doc", "node"]).withColumn("key", T.title_like(c("label")))
    found = rows.join(first, ["doc", "key"]).where((c("page") >= 0) & (c("page") < pages))
    once = found.groupBy("doc", T.normalized(c("label")).alias("label"), "page").agg(F.min(F.struct("place", "node", "depth")).alias("x"))
    return once.select("doc", "x.node", "page", F.least(F.lit(MOST_LEVELS), c("x.depth") + 1).alias("level"))
