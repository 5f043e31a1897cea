"""The given tables read as labelled text and as a tracking log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.functions.text import experiment_name
from tagwright.sources.examples import Dataset, hold_out, to_examples
from tagwright.spec import TaskSpec

LANGUAGE_TASK = TaskSpec(
    "language", ("de", "en", "es", "fr"), domain="language identification", input_label="Document",
    label_noun="language",
)

VERDICT_TASK = TaskSpec(
    "verdict", ("clean", "low quality", "low quality toxic", "toxic"), domain="content review",
    input_label="Document", label_noun="verdict",
)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents under raw column names, with a raw split."""
    raw = read(spark, folder, "documents").select(
        F.col("doc_id").alias("example_id"), F.col("text").alias("input_text"), F.col("lang").alias("output_text")
    )
    return hold_out(raw)


def language(spark: SparkSession, folder: str) -> Dataset:
    """Text of every document, labelled with its language."""
    return Dataset(to_examples(raw_documents(spark, folder)), LANGUAGE_TASK, source="documents")


def verdicts(spark: SparkSession, folder: str, how: str = "inner") -> DataFrame:
    """Documents with the four-way verdict of their review; unreviewed ones if ``left``.

    Both sides are keyed by the unique document id.
    """
    reviewed = read(spark, folder, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 0, F.when(F.col("quality") == 1, "clean").otherwise("low quality"))
        .otherwise(F.when(F.col("quality") == 1, "toxic").otherwise("low quality toxic"))
        .alias("diagnosis"),
    )
    documents = read(spark, folder, "documents").select("doc_id", F.col("text").alias("symptoms"))
    joined = documents.join(reviewed, "doc_id", how).withColumnRenamed("doc_id", "example_id")
    return to_examples(hold_out(joined))


def verdict(spark: SparkSession, folder: str) -> Dataset:
    """Reviewed documents, labelled with their verdict."""
    return Dataset(verdicts(spark, folder), VERDICT_TASK, source="documents+labels")


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as metrics logged by runs, one run per user."""
    return read(spark, folder, "events").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.when(F.col("event_type").isin("click", "view"), "train").otherwise("validation").alias("split"),
        F.col("event_type").alias("metric"),
        "value",
        F.struct("ts", "event_id").alias("logged_at"),
    )


def model_names(spark: SparkSession, folder: str) -> DataFrame:
    """One model per user of the event log, and one that has no version yet."""
    named = read(spark, folder, "events").select(F.concat(F.lit("model-"), F.col("user_id").cast("string")).alias("name"))
    return named.unionByName(named.agg(F.concat(F.min("name"), F.lit("-new")).alias("name")))


def version_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as registered model versions, one model per user."""
    return read(spark, folder, "events").select(
        F.concat(F.lit("model-"), F.col("user_id").cast("string")).alias("name"),
        (F.col("event_id") + 1).alias("version"),
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
    )


def alias_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as aliases being set; the event type is the alias."""
    return read(spark, folder, "events").select(
        F.concat(F.lit("model-"), F.col("user_id").cast("string")).alias("name"),
        F.col("event_type").alias("alias"),
        F.get_json_object("props", "$.k").cast("long").alias("version"),
        F.struct("ts", "event_id").alias("updated_at"),
    )


def tagged_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as runs with tags; the event type is the project."""
    trainable = F.when(F.col("value") >= 20, "true").otherwise("false")
    return read(spark, folder, "events").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
        experiment_name(
            F.lit("events"), F.col("event_type"), F.concat(F.lit("user-"), F.col("user_id").cast("string"))
        ).alias("experiment"),
        F.create_map(
            F.lit("system"), F.lit("events"),
            F.lit("project"), F.col("event_type"),
            F.lit("trainable"), trainable,
        ).alias("tags"),
    )


def model_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Parts read as runs with a model id, most of them ``provider/model``."""
    named = F.concat(F.lower("p_type"), F.lit("/"), F.col("p_name"))
    return read(spark, folder, "part").select(
        F.concat(F.lit("run-"), F.col("p_partkey").cast("string")).alias("run_id"),
        F.when(F.col("p_type") == "SMALL", F.col("p_name")).otherwise(named).alias("lm_model"),
    )
