"""The registered query of each operator: its whole table, production parameters, the full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm import (
    graph_ann,
    language_id,
    licence_rules,
    packing,
    pii,
    piece_fst,
    quality_rules,
    secret_scan,
    simhash_vp,
    vector_dedup,
)
from foliolens.llm.common import held_out, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (sparse rule ensemble)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules.with_quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id 100 divides (robust-pruned graphs)."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return graph_ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, byte fallbacks, checksum of ids and round trip of every document (weighted transducer)."""
    return piece_fst.digest(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document (keyword automaton, anchored patterns, checksums)."""
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document (patterns, checksums, context)."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector (sign hashes, exact cosine)."""
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, licences (distinct, sorted, comma-joined), n_matches and spans of every document (sentence rules)."""
    found = licence_rules.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["licence"]))), ",").alias("licences"),
        F.size("licences").cast("bigint").alias("n_matches"),
        F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["licence"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (vantage-point trees)."""
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash_vp.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document (rank-order profiles)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.fit_profiles(docs)
    return language_id.with_language(docs.select("doc_id", "text"), profiles).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, a row for each piece (concatenate and cut)."""
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_nearest, op3_pieces, op4_secrets, op5_pii, op6_vector_dedup, op7_licences, op8_simhash, op9_language, op10_packing)
}

_VECTORS = """v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

#: Brute force over all pairs of vectors. SQL states the base spans' counts of the text scans at best, never all that
#: those queries return; they are tested against brute force, the published libraries and held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op2_nearest": f"""WITH {_VECTORS}, q AS (SELECT vec_id AS query_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
        d AS (SELECT query_id, vec_id, min(sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b))) AS score FROM q JOIN v ON query_id <> vec_id AND len(q.e) = len(v.e) GROUP BY query_id, vec_id),
        n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d)
        SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 10""",
    "op6_vector_dedup": f"""WITH RECURSIVE {_VECTORS}, l AS (SELECT a.r, a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
        c AS (SELECT x, min(y) AS low FROM reach GROUP BY x), n AS (SELECT r, count(*) AS n FROM l GROUP BY r),
        f AS (SELECT v.vec_id, coalesce(n, 0) AS n_links, low AS component_id FROM v JOIN c ON v.vec_id = c.x LEFT JOIN n ON v.r = n.r
            UNION ALL SELECT vec_id, 0, vec_id FROM embeddings WHERE vec_id IS NULL OR NOT coalesce(len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false))
        SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM f""",
}
