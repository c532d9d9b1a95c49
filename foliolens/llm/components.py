"""Distributed connected components, and spanning forests of the links found inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import clear, mark, removed, written_at


def local_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes over the links a-b (and those in ``labels``)."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        ra, rb = labels[a], labels[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(labels, high, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped
    return labels


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that isn't the smallest of its component.

    ``edges`` has two bigint columns ``a`` and ``b``; rows with nulls or a = b count for
    nothing. Each round hooks every node to its smallest neighbour (a pre-aggregated
    minimum, so a hub costs nothing), jumps pointers until all point at roots, and
    relabels the edges; edges inside a component go, so rounds are few. All state lies in
    tables in the shared folder, which go when the next round's are written, and the edge side of each join is a plain
    exchange that adaptive execution may split where a hub makes it large.
    """
    spark = edges.sparkSession
    edges, edges_at = written_at(
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(), "edges")
    result, result_at = None, None
    while not edges.isEmpty():
        since = mark(spark)
        parent, parent_at = written_at(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents")
        while True:
            above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped, jumped_at = written_at(
                parent.join(above, "parent", "left")
                .select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
            moved = not jumped.where("moved").isEmpty()
            parent, parent_at = jumped.select("node", "parent"), jumped_at
            if not moved:
                break
        before = [edges_at, *([result_at] if result_at else [])]
        if result is None:
            result, result_at = parent, parent_at
        else:
            later = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            result, result_at = written_at(
                result.join(later, "parent", "left")
                .select("node", F.coalesce("above", "parent").alias("parent"))
                .unionByName(parent), "components")
        of_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        of_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        edges, edges_at = written_at(
            edges.join(of_b, "b").join(of_a, "a", "left")
            .select(F.coalesce("pa", "a").alias("x"), F.col("pb").alias("y"))
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(), "edges")
        clear(spark, since, but=(edges_at, result_at))
        for path in before:
            if path != result_at:
                removed(spark, path)
    if result is None:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    removed(spark, edges_at)
    return result.select("node", F.col("parent").alias("component"))
