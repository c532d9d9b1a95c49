"""Tables of contents held against the headings of their documents: bookmarks, targets and candidates with their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import text as T

c = F.col

# Types of entries, headings and other landmarks, and limits.
CAPTION, ENTRY_TYPES = "toc_caption", ("toc_caption", "toc_item", "toc_item_table")
HEADING, LANDMARK_TYPES = "heading", ("paragraph", "list_item", "note")
MOST_LEVELS, MOST_ENTRIES, MOST_CHARS = 6, 80, 240


def contents_bookmarks(elements: DataFrame, headings: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc, pos, text, page, source_page, level, section): the entries of ``elements`` (doc, pos, page, type, text, grp) as bookmarks.

    ``headings`` is (doc, pos, page, level, text), ``documents`` (doc, pages), a row each.
    An entry leads to the first heading of its title, else to its own page; pages beyond the
    document are its first. Entries of a group with a caption are a level down. Of entries
    with the same words and page the first stays. Entries without a Latin letter are left out.
    """
    captioned = c("grp").isNotNull() & F.bool_or(c("type") == CAPTION).over(Window.partitionBy("doc", "grp"))
    entries = elements.where(F.trim("type").isin(*ENTRY_TYPES)).select("doc", "pos", "page", F.trim("type").alias("type"), "grp", T.bookmark_label(c("text")).alias("label"))
    entries = entries.withColumn("_down", captioned).where(F.rlike("label", F.lit("[A-Za-z]"))).withColumn("_key", F.when(c("type") != CAPTION, T.title_like(c("label"))))
    first = headings.withColumn("_key", T.title_like(c("text"))).where("_key <> ''").groupBy("doc", "_key").agg(F.min_by(F.struct("page", "level"), "pos").alias("_to"))
    rows = entries.join(first, ["doc", "_key"], "left").join(documents.select("doc", "pages"), "doc")
    inside = (c("page") >= 0) & (c("page") < c("pages"))
    to = c("_to.page")
    own, source = F.when(inside, c("page")).otherwise(0), F.when(inside, c("page")).otherwise(to)
    led = c("_to").isNotNull()
    base = F.when(led & (c("_to.level") > 0), F.least(c("_to.level"), F.lit(MOST_LEVELS))).otherwise(1)
    level = F.when(c("type") == CAPTION, 1).otherwise(F.least(base + c("_down").cast("int"), F.lit(MOST_LEVELS)))
    placed = rows.select("doc", "pos", "label", F.when(led, to).otherwise(own).alias("page"), F.when(led, source).otherwise(own).alias("source_page"), level.alias("level"))
    once = placed.groupBy("doc", T.normalized(c("label")).alias("_words"), "page").agg(F.min(F.struct("pos", "label", "source_page", "level")).alias("x"))
    return once.select("doc", "x.pos", c("x.label").alias("text"), "page", "x.source_page", "x.level", T.section_key(c("x.label")).alias("section"))


def _labelled(elements: DataFrame) -> DataFrame:
    """``elements`` with _label, and _entry and _heading: whether a row is one of the first entries, or a heading on a page."""
    w = Window.partitionBy("doc").orderBy("pos")
    rows = elements.withColumn("_label", T.bookmark_label(c("text"))).withColumn("_said", c("_label") != "")
    entry = c("type").isin(*ENTRY_TYPES) & c("_said")
    return rows.withColumn("_entry", entry & (F.count_if(entry).over(w) <= MOST_ENTRIES)).withColumn("_heading", (c("type") == HEADING) & c("_said") & c("page").isNotNull())


def _cut(x: Column) -> Column:
    return F.substring(x, 1, MOST_CHARS)


def contents_targets(elements: DataFrame) -> DataFrame:
    """(doc, pos, text, target): the first ``MOST_ENTRIES`` entries of a document and the place of the heading each leads to.

    That is the first heading of its title, else the first of its section number, else null.
    """
    rows = _labelled(elements)
    heads = rows.where("_heading").select("doc", "pos", T.title_like(_cut(c("_label"))).alias("_title"), T.section_key(c("_label")).alias("_section"))
    by_title = heads.where("_title <> ''").groupBy("doc", "_title").agg(F.min("pos").alias("_a"))
    by_section = heads.where("_section <> ''").groupBy("doc", "_section").agg(F.min("pos").alias("_b"))
    entries = rows.where("_entry").select("doc", "pos", _cut(c("_label")).alias("text"))
    entries = entries.withColumns({"_title": T.title_like(c("text")), "_section": T.section_key(c("text"))})
    found = entries.join(by_title, ["doc", "_title"], "left").join(by_section, ["doc", "_section"], "left")
    return found.select("doc", "pos", "text", F.when(c("_title") != "", F.coalesce("_a", "_b")).alias("target"))


def bookmark_candidates(elements: DataFrame) -> DataFrame:
    """Headings and landmarks of ``elements`` (doc, pos, page from 0, type, text) after the last page of contents, with what stands about them.

    (doc, pos, kind, page from 1, text, section, parent, before, after, body_before, body_after):
    ``before`` and ``after`` are the neighbouring headings (of a landmark: the neighbouring
    candidates), the bodies the next landmark's text on either side, empty where a heading
    comes first. A document without entries has no candidates. All windows share one shuffle.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    whole, above, below = Window.partitionBy("doc"), order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    nearest = lambda x: (F.last(x, ignorenulls=True).over(above), F.first(x, ignorenulls=True).over(below))
    label, landmark = _cut(c("_label")), c("type").isin(*LANDMARK_TYPES) & c("_said")
    body = nearest(F.when(c("type") == HEADING, "").when(landmark, label))
    heads = nearest(F.when(c("_heading"), label))
    rows = _labelled(elements).withColumns({
        "_any": F.bool_or("_entry").over(whole), "_last": F.coalesce(F.max(F.when(c("_entry"), c("page") + 1)).over(whole), F.lit(0)),
        "_b0": body[0], "_b1": body[1], "_h0": heads[0], "_h1": heads[1]})
    shown = c("page").isNotNull() & (c("page") + 1 > c("_last")) & (c("_heading") | landmark)
    near = nearest(F.when(c("_shown"), label))
    rows = rows.withColumn("_shown", F.coalesce(shown, F.lit(False))).withColumns({"_v0": near[0], "_v1": near[1]}).where("_any and _shown")
    either = lambda head, other: F.coalesce(F.when(c("_heading"), c(head)).otherwise(c(other)), F.lit(""))
    return rows.select(
        "doc", "pos", F.when(c("_heading"), "heading").otherwise("landmark").alias("kind"), (c("page") + 1).alias("page"), label.alias("text"), T.section_key(c("_label")).alias("section"), T.parent_section_key(c("_label")).alias("parent"),
        either("_h0", "_v0").alias("before"), either("_h1", "_v1").alias("after"), F.coalesce("_b0", F.lit("")).alias("body_before"), F.coalesce("_b1", F.lit("")).alias("body_after"))
