"""Corpus preparation, stage after stage: each applies one operator to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basewright.llm import bpe, cotraining, decontaminate, jaccard, linechunks
from basewright.llm.common import fresh_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return cotraining.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that came before in another place; n_chars is kept up to date."""
    return linechunks.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text that they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Neither the classifier nor BPE can be put in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the table of documents; what each returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made, path = stage(spark, docs, sf_dir), fresh_path(spark, name)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
