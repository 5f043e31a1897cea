"""The training-data pipeline: each stage is one operator over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagwright.llm import mixing, quality, sentencepieces, simhash, suffixes
from tagwright.session import write_once

#: Domain weights of the mixture; clean tokens stay as many as they are.
WEIGHTS = {"clean": 0.97, "low": 0.005, "toxic": 0.025}

#: Bytes of rows that travel to a Python worker at a time.  Spark's own bound is 64 MB, which both sides hold at once,
#: in every core, beside what the stages before have left in the executor.
BATCH = 1 << 20
#: Rows of a table that are decoded at a time.  Spark's own 4,096 texts fill arrays of megabytes over and over, for which
#: the heap grows to its bound and stays there.
ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Texts are read and go to Python workers in small batches, in this stage and, as these are settings of the session, after it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(ROWS))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly labelled classifier rejects go."""
    small_batches(spark)
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked by 2 bits or fewer, the one with the smallest doc_id stays."""
    small_batches(spark)
    return simhash.first_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 bytes and more that occur in a document with a smaller doc_id."""
    small_batches(spark)
    return suffixes.dedup(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin out domains with more tokens than their weight, by rates that the posteriors imply."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.sampled(docs, labels, WEIGHTS, keep="clean")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with parity and round trip.

    By now the executors hold memory of four stages, so the workers take less for a longer time.
    """
    small_batches(spark)
    return sentencepieces.digest(docs, remembered=32 << 20, at_once=1 << 12)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", remove_repeats),
    ("mixing to weights", mix_domains),
    ("sentencepiece", encode),
]

#: Expectation maximisation, trained scorers and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every other stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
