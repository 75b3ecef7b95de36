"""A training-data pipeline over `documents`: each stage keeps the columns of documents, the last packs.

Every stage works on all that its predecessor kept, and judges that alone. Rows are judged
one by one, also when they share a doc_id; of rows with one id and one text one stays
among near copies. Null, empty and very long texts are judged by the operators' own rules:
the base rules reject what has too few words; later stages keep texts without words. Ties
go by doc_id and then by row key. An empty table gives an empty result. Columns other than
those of documents are not handed on, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ngram_join, packing, quality_rules, substring_dedup, toxicity
from tidemark.llm.store import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the trees reject."""
    verdicts = quality_rules.apply_rules(docs, quality_rules.train(docs, _labels(spark, sf_dir)), carry=COLUMNS[1:])
    return verdicts.where("kept").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    scores = toxicity.score(docs, toxicity.train(docs, _labels(spark, sf_dir)), carry=COLUMNS[1:])
    return scores.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: of those with the smallest id the one with the least row key.

    Rows without words or without an id are in no class and stay; of rows with one id and one text one stays.
    """
    classes = ngram_join.join_classes(docs, keyed=True)
    heads = classes.where("class_key is not null").groupBy("class_key").agg(F.min(F.struct("doc_id", "row_key")).alias("h")).select("h.row_key")
    alone = classes.where("class_key is null and doc_id is not null").select("row_key")
    stay = heads.union(alone).distinct()
    kept = docs.where("doc_id is not null").withColumn("row_key", ngram_join.row_key()).join(stay.hint("shuffle_hash"), "row_key", "left_semi")
    kept = kept.groupBy("row_key").agg(F.any_value(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; a text that loses nothing stays as it is, one that loses all goes."""
    left = substring_dedup.remove_repeats(docs, verbatim=True, carry=("lang", "source")).where("n_removed = 0 or n_removed < n_words")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", substrings),
    ("best_fit_packing", pack),
]

#: Learned models and the packing search have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
