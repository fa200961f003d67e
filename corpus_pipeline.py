"""Corpus pipeline: quality, near duplicates, secrets, source mixing, packing.

Every stage takes all that the one before kept. Between stages the documents are written as
Parquet below the folder named in ``spark.checkpoint.dir`` and read again. All stages but the
last return the columns of ``documents``; the last returns the places of the token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazardlake.llm import mixing, ngram_join, packing, quality, queries, secret_scan
from hazardlake.llm.words import bound_batches
from hazardlake.session import materialize

#: Rows of a batch that travels between Spark and Python, whose buffers an executor keeps from stage to stage.
BATCH_ROWS = 500


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    bound_batches(spark, BATCH_ROWS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.resample(docs, labels).filter("kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bound_batches(spark, BATCH_ROWS)
    return ngram_join.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars counted anew."""
    bound_batches(spark, BATCH_ROWS)
    return secret_scan.redact(docs, **queries.rank_vocabulary())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice as often as those of the largest."""
    return mixing.mix(docs, repetition=2.0).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every token piece in sequences of at most 2048 tokens."""
    bound_batches(spark, BATCH_ROWS)
    return packing.pack(materialize(packing.pieces(docs, queries.word_vocabulary()), "pieces"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Hashed models, token vocabularies and packing have no SQL form; tests/llm compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
