"""One query for each operator, over its whole table, with the result columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, hnsw_dedup, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, token_counts, toxicity
from tidemark.llm.store import crc_mod, new_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, _read(spark, sf_dir, "labels")))


def _predicted(scores: DataFrame, threshold: float) -> DataFrame:
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return _predicted(toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels"))), toxicity.THRESHOLD)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as flat token files in the shared folder, then their counts from those files alone."""
    path = new_path(spark, "flat-tokens")
    token_counts.write_flat(_read(spark, sf_dir, "documents"), path)
    return token_counts.scan_documents(token_counts.read_blocks(spark, path)).select("doc_id", "n_tokens", "terminated")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.round_trip(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_csv", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.deduplicate(_read(spark, sf_dir, "embeddings"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(quality_classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")), quality_classifier.THRESHOLD)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_quality_rules,
        op3_toxicity,
        op4_token_counts,
        op5_substring_dedup,
        op6_byte_bpe,
        op7_hnsw_dedup,
        op8_lm_scoring,
        op9_quality_classifier,
        op10_ngram_jaccard_join,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_hnsw_dedup": r"""
WITH RECURSIVE e AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (
    SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e
), link AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach AS (
    SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u
), comp AS (
    SELECT u, min(v) AS component_id FROM reach GROUP BY u
), cnt AS (
    SELECT u, count(*) AS n FROM link GROUP BY u
)
SELECT vec_id, coalesce(cnt.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.u = vec_id LEFT JOIN cnt ON cnt.u = vec_id
""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
    SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)
), e AS (
    SELECT u, v FROM l UNION SELECT v, u FROM l
), r AS (
    SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u
), c AS (
    SELECT u, min(v) AS component_id FROM r GROUP BY u
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.u = doc_id
""",
    "op5_substring_dedup": r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
    SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS s FROM w
), g AS (
    SELECT doc_id, s, min(doc_id) OVER (PARTITION BY array_to_string(words[s:s + 12], ' ')) AS first_id FROM p
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM g WHERE doc_id > first_id
), per AS (
    SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words
        ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
""",
}
