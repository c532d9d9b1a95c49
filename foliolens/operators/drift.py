"""Text drift of remediated documents, and review tasks merged by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.functions import similarity as X
from foliolens.sources.shipping import ship

c = F.col

# Limits of the check.
LEAST_CHARS = 300
OCR_KINDS = ("scanned", "mixed", "ocr_scan")
CONTAINMENT_FAIL, CONTAINMENT_WARN = 85.0, 92.0
PRESERVATION_FAIL, PRESERVATION_WARN = 0.90, 0.95
OCR_LENGTH_FAIL = 0.70
SIMILARITY_FAIL, SIMILARITY_WARN = 0.82, 0.90
LENGTH_FAIL = (0.70, 1.45)
LENGTH_WARN = (0.85, 1.20)
RESCUE_SIMILARITY, RESCUE_LENGTH = 0.82, (0.70, 1.45)
SEVERITIES = ("low", "medium", "high")

_MEASURED = "similarity double, containment double, preservation double, original_similarity double"


def _measures(source: str, output: str, original: str | None, ocr: bool) -> tuple[float | None, ...]:
    enough = len(source) >= LEAST_CHARS and len(output) >= LEAST_CHARS
    return (
        X.sequence_ratio(source, output) if enough else None,
        100 * X.window_ratio(source, output) if enough and ocr else None,
        X.preservation(source, output) if enough and ocr else None,
        X.sequence_ratio(original, output) if enough and original is not None and len(original) >= LEAST_CHARS else None,
    )


def text_drift(texts: DataFrame) -> DataFrame:
    """``texts`` (source, output, original, classification, and more columns) with its measures and verdict.

    ``original`` is the text before another source took its place, null where none did. Null
    texts count as empty. OCR kinds are judged by containment, preservation and loss of
    length, since added text is no damage there; others by likeness and length both ways.
    Texts under ``LEAST_CHARS`` are skipped. ``rescue_review`` asks for a look at a
    replaced text layer that is far from the original one.
    """
    ship(texts.sparkSession)

    @F.pandas_udf(f"struct<{_MEASURED.replace(' double', ':double')}>")
    def measured(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for source, output, original, ocr in parts:
            rows = [_measures(s or "", o or "", g, k) for s, o, g, k in zip(source, output, original, ocr, strict=True)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _MEASURED.split(", ")], dtype="float64")

    ocr = F.coalesce(c("classification").isin(*OCR_KINDS), F.lit(False))
    chars = lambda x: F.length(F.coalesce(x, F.lit("")))
    ratio = chars(c("output")) / F.greatest(chars(c("source")), F.lit(1))
    original_ratio = chars(c("output")) / chars(c("original"))
    beyond = lambda x, low, high: (x < low) | (x > high)
    found = texts.withColumn("_m", measured("source", "output", "original", ocr)).select(
        *texts.columns, "_m.*", F.when(c("_m.similarity").isNotNull(), ratio).alias("length_ratio"),
        F.when(c("_m.original_similarity").isNotNull(), original_ratio).alias("original_length_ratio"))
    fails = F.when(ocr, (c("containment") < CONTAINMENT_FAIL) | (c("preservation") < PRESERVATION_FAIL) | (c("length_ratio") < OCR_LENGTH_FAIL)).otherwise(
        (c("similarity") < SIMILARITY_FAIL) | beyond(c("length_ratio"), *LENGTH_FAIL))
    warns = F.when(ocr, (c("containment") < CONTAINMENT_WARN) | (c("preservation") < PRESERVATION_WARN)).otherwise(
        (c("similarity") < SIMILARITY_WARN) | beyond(c("length_ratio"), *LENGTH_WARN))
    status = F.when(c("similarity").isNull(), "skip").when(fails, "fail").when(warns, "warning").otherwise("pass")
    rescue = (c("original_similarity") < RESCUE_SIMILARITY) | beyond(c("original_length_ratio"), *RESCUE_LENGTH)
    return found.withColumns({"status": status, "rescue_review": F.coalesce(rescue, F.lit(False))})


def drift_tasks(drift: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows of ``merged_tasks`` for what ``text_drift`` found: a failed check blocks, the others ask for a look."""
    shown = lambda name, places: F.struct(F.lit(name).alias("key"), F.round(name, places).cast("string").alias("value"))
    tasks = F.array(
        F.when(c("rescue_review"), F.struct(
            F.lit(0).alias("place"), F.lit("review:content_fidelity:ocr_rescue").alias("key"), F.lit("Spot-check OCR rescue text fidelity").alias("title"), F.lit("medium").alias("severity"),
            F.lit(False).alias("blocking"), F.array(shown("original_similarity", 4), shown("original_length_ratio", 4)).alias("entries"))),
        F.when(c("status").isin("fail", "warning"), F.struct(
            F.lit(1).alias("place"), F.lit("review:content_fidelity").alias("key"),
            F.when(c("status") == "fail", "Verify extracted text fidelity").otherwise("Spot-check extracted text fidelity").alias("title"),
            F.when(c("status") == "fail", "high").otherwise("medium").alias("severity"), (c("status") == "fail").alias("blocking"),
            F.array(shown("similarity", 4), shown("length_ratio", 4), shown("containment", 1), shown("preservation", 4)).alias("entries"))))
    rows = drift.select(c(doc).alias("doc"), F.inline(F.filter(tasks, lambda t: t.isNotNull())))
    known = F.filter("entries", lambda e: e["value"].isNotNull())
    return rows.select("doc", "key", "place", "title", "severity", "blocking", F.map_from_entries(known).alias("metadata"))


def merged_tasks(tasks: DataFrame) -> DataFrame:
    """One task of each (doc, key): the first title, the worst severity, blocking if any is.

    ``metadata`` (strings by name) holds every name, with its last value. ``place`` orders the
    tasks of a document and must not repeat within a key. A severity that is not known ranks
    lowest. All three steps reduce before they shuffle, whatever the size of a key.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), c("severity")), F.lit(0))
    heads = tasks.groupBy("doc", "key").agg(
        F.min_by("title", "place").alias("title"), F.max_by("severity", F.struct(rank, -c("place"))).alias("severity"), F.max("blocking").alias("blocking"))
    entries = tasks.select("doc", "key", "place", F.explode("metadata").alias("name", "value"))
    last = entries.groupBy("doc", "key", "name").agg(F.max_by("value", "place").alias("value"))
    maps = last.groupBy("doc", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metadata"))
    return heads.join(maps, ["doc", "key"], "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def with_metadata(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """``tasks`` (doc, place, task_type, source, metadata) with the metadata of ``updates`` (doc, task_type, source, metadata) in the first task that matches.

    A null source of a task reads as "fidelity". Names of the update win. ``updates`` holds
    one row for each (doc, task_type, source); an update of null or no names changes nothing.
    """
    source = F.coalesce("source", F.lit("fidelity"))
    first = tasks.groupBy("doc", "task_type", source.alias("_source")).agg(F.min("place").alias("place"))
    news = updates.where(F.size("metadata") > 0).select("doc", "task_type", c("source").alias("_source"), c("metadata").alias("_news"))
    hits = first.join(news, ["doc", "task_type", "_source"])
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys("_news"), k))
    merged = F.when(c("_news").isNotNull(), F.map_concat(own, "_news")).otherwise(c("metadata"))
    return tasks.withColumn("_source", source).join(hits, ["doc", "task_type", "_source", "place"], "left").withColumn("metadata", merged).select(*tasks.columns)
