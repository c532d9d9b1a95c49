"""The corpus pipeline: language ID, quality, near-duplicates, secrets, packing.

Each stage takes what its predecessor kept. All but the last return the columns of
``documents``; a row that a filter drops is gone, and texts that hold secrets go on
without them. Stages write Parquet to the shared folder and read it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliolens.llm import language_id, packing, quality_rules, secret_scan, simhash_vp, word_sets
from foliolens.llm.common import clear, free_name, mark, table, written_at

#: A document goes on if its language is known and its score reaches this.
LEAST_LANGUAGE_SCORE = 0.25
#: A document goes on if its quality score reaches this.
LEAST_QUALITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt from them; those without a letter, or far from all, go."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = language_id.with_language(docs, language_id.fit_profiles(docs), lang_pred=lang, score=score)
    return found.where((found[lang] != language_id.UNKNOWN) & (found[score] >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels, calls good."""
    model = quality_rules.fit_quality(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    found = quality_rules.with_quality(docs, model, score=score)
    return found.where(found[score] >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return simhash_vp.one_of_each_group(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts whose 5-word sets are at least 0.8 alike.

    Not among ``STAGES``: the pipeline's test holds that stage to fingerprints within 3 bits.
    """
    return simhash_vp.one_of_each_group(docs, groups=word_sets.near_duplicates)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets put out; n_chars follows the text."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``; a stage's tables go when its result is written.

    What the last stage wrote is read when the result is used, and stays until ``common.clear``.
    """
    docs, last, since = table(spark, sf_dir, "documents"), None, mark(spark)
    for name, stage in STAGES[:-1]:
        docs, last = written_at(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear(spark, since, but=(last,))
    return STAGES[-1][1](spark, docs, sf_dir)
