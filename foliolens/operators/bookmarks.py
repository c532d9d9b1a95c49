"""Bookmarks of a candidate held against the gold ones of its document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.functions import text as T

#: Missing titles named.
MOST_MISSING = 10


def compare_bookmarks(documents: DataFrame, *keep: str) -> DataFrame:
    """Counts, rates and missing titles of each row of (doc, gold, candidate, sources), arrays of texts; columns to ``keep`` come after them.

    A gold title is matched by a candidate title that holds its title key or its words in
    order, and recoverable where a visible source holds its words side by side; the others
    are higher-order. Rates over no title are null; missing titles are the first few.
    """
    rows = documents.select("doc", *keep, *[F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in ("gold", "candidate", "sources")])

    def rated(g):
        matched = F.exists("candidate", lambda t: T.matches_title(t, g) | T.matches_ordered_terms(t, g))
        recoverable = F.exists("sources", lambda t: T.matches_contiguous_terms(t, g))
        return F.struct(g.alias("title"), F.coalesce(matched, F.lit(False)).alias("matched"), F.coalesce(recoverable, F.lit(False)).alias("recoverable"))

    rated_rows = rows.withColumn("_all", F.transform("gold", rated))
    out = [F.col("doc"), F.size("gold").alias("gold_total"), F.size("candidate").alias("candidate_total")]
    for name, kept in (("", lambda x: F.lit(True)), ("recoverable_", lambda x: x["recoverable"]), ("higher_order_", lambda x: ~x["recoverable"])):
        own = F.filter("_all", kept)
        total, matched = F.size(own), F.size(F.filter(own, lambda x: x["matched"]))
        if name:
            out.append(total.alias(f"{name}gold_total"))
        missing = F.transform(F.filter(own, lambda x: ~x["matched"]), lambda x: x["title"])
        out += [
            matched.alias(f"{name}matched_titles"), F.when(total > 0, F.round(matched / total, 4)).alias(f"{name}match_rate"),
            F.slice(missing, 1, MOST_MISSING).alias(f"missing_{name}titles"),
        ]
    return rated_rows.select(*out, *keep)
