"""Spatial joins of boxes on a page: overlap by grid cells, best match, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions import geometry as G

c = F.col


def overlapping(boxes: DataFrame, cell: float = 100.0) -> DataFrame:
    """Pairs of boxes of a page that overlap, the second as ``o_*``, itself left out.

    Each box is dealt to the grid cells that it covers and meets others there by an
    equi-join on (page, cell); a pair counts in one cell only, the first that both cover.
    """
    def cells(low: str, high: str):
        return F.sequence(F.floor(c(low) / cell), F.floor(c(high) / cell))

    dealt = boxes.withColumn("cx", F.explode(cells("l", "r"))).withColumn("cy", F.explode(cells("b", "t")))
    other = dealt.select("page", "cx", "cy", *[c(k).alias(f"o_{k}") for k in ("box", "l", "b", "r", "t")])
    pairs = dealt.join(other, ["page", "cx", "cy"]).where("box <> o_box")
    first = (c("cx") == F.floor(F.greatest("l", "o_l") / cell)) & (c("cy") == F.floor(F.greatest("b", "o_b") / cell))
    return pairs.where(first & (G.intersection(G.box(), G.box("o_")) > 0)).drop("cx", "cy")


def best_box_match(boxes: DataFrame) -> DataFrame:
    """(target, box, score): the other box of the page that overlaps best by IoU or containment either way; ties to the smaller."""
    a, o = G.box(), G.box("o_")
    score = F.greatest(G.iou(a, o), G.containment(a, o), G.containment(o, a))
    scored = overlapping(boxes).select(c("box").alias("target"), c("o_box").alias("box"), score.alias("score"))
    return scored.groupBy("target").agg(F.max_by("box", F.struct("score", -c("box"))).alias("box"), F.round(F.max("score"), 6).alias("score"))


def nearest_boxes(boxes: DataFrame, k: int) -> DataFrame:
    """(box, near, rank): the ``k`` nearest others of a page by L1 distance of centres, ties to the smaller.

    A page is a bounded group: its boxes are compared by a join on the page, and the rank
    is pushed below the window's shuffle, so each task keeps ``k`` rows of a box.
    """
    a = boxes.select("page", "box", *[x.alias(n) for x, n in zip(G.centre(G.box()), ("x", "y"), strict=True)])
    o = a.select("page", c("box").alias("near"), c("x").alias("ox"), c("y").alias("oy"))
    rank = F.row_number().over(Window.partitionBy("box").orderBy(F.abs(c("x") - c("ox")) + F.abs(c("y") - c("oy")), "near"))
    return a.join(o, "page").where("box <> near").select("box", "near", rank.alias("rank")).where(c("rank") <= k)
