"""A corpus pipeline in five stages: quality, near copies, benchmark passages, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and all that the stage before it kept.  All but the last return the columns of
documents; the last returns a row for each document with the words that the mix takes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import cgk_leaks, jaccard_join, knn_quality, secret_tests, source_mix
from siftline.llm.queries import remainder
from siftline.llm.support import table, written

#: Near copies share four fifths of their five-word shingles.
NEAR = jaccard_join.Rule(words=5, num=80, den=100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours vote for; labels are learned from three quarters of the identifiers."""
    learn = ~F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return knn_quality.reject_poor(docs, table(spark, sf_dir, "labels"), learn=learn)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs, NEAR)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return cgk_leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows the text."""
    kind = docs.schema["n_chars"].dataType
    return secret_tests.mask_secrets(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document."""
    text = F.col("text")
    return source_mix.mix(docs, identifier=F.col("doc_id"), source=F.col("source"), size=source_mix.word_count(text), weight=source_mix.quality_weight(text))


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("secrets", secrets), ("mixture", mixture)]
#: SQL can't express the first stage; the operators of the stages are tested against brute force one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
