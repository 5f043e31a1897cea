"""Scoring predictions against labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions.metrics import accuracy as accuracy_of
from tagwright.functions.metrics import bounded, exact_match
from tagwright.operators.rows import SMALL, first_n

Metric = Callable[[Column, Column], Column]


def score(predictions: DataFrame, metric: Metric = exact_match) -> DataFrame:
    """Add ``correct`` to rows that carry ``actual`` and ``predicted``; no shuffle.

    ``metric`` maps (actual, predicted) to a number; a ``pandas_udf`` will do.
    """
    return predictions.withColumn("correct", metric(F.col("actual"), F.col("predicted")))


def score_rows(examples: DataFrame, predictions: DataFrame, metric: Metric = exact_match) -> DataFrame:
    """Score a separate prediction table; an example without prediction is wrong.

    Ids are unique on both sides, so no key is hot; the optimizer broadcasts a
    side that turns out small.
    """
    keep = [c for c in ("example_id", "split") if c in examples.columns]
    answers = predictions.select("example_id", "predicted")
    joined = examples.select(*keep, F.col("diagnosis").alias("actual")).join(answers, "example_id", "left")
    return score(joined, metric)


def accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy and number of rows; one row, also over an empty table."""
    return scored.agg(accuracy_of(F.col("correct")).alias("accuracy"), F.count(F.lit(1)).alias("num_examples"))


def accuracy_by_split(scored: DataFrame) -> DataFrame:
    """Accuracy, number of rows and number of disagreements per split."""
    return scored.groupBy("split").agg(
        accuracy_of(F.col("correct")).alias("accuracy"),
        F.count(F.lit(1)).alias("num_examples"),
        F.count_if(F.col("correct") == 0).alias("disagreements"),
    )


def checked(metrics: DataFrame) -> DataFrame:
    """The same metrics; the job fails on an accuracy outside [0, 1] or no rows."""
    return metrics.withColumn("accuracy", bounded(F.col("accuracy"), "accuracy", 0.0, 1.0)).withColumn(
        "num_examples", bounded(F.col("num_examples"), "num_examples", above=0).cast("long")
    )


def disagreement_count(scored: DataFrame) -> DataFrame:
    """Wrong rows per split, zero included."""
    return scored.groupBy("split").agg(F.count_if(F.col("correct") == 0).alias("disagreements"))


def keep_wrong_texts(scored: DataFrame) -> DataFrame:
    """Drop the text of right rows, so that a written table holds what is reported."""
    if "symptoms" not in scored.columns:
        return scored
    return scored.withColumn("symptoms", F.when(F.col("correct") == 0, F.col("symptoms")))


def disagreements(scored: DataFrame, examples: DataFrame) -> DataFrame:
    """All wrong rows with their text.

    Scored rows that brought their text along are only filtered.  Otherwise the
    ids of wrong rows, and no others, are joined with the texts.
    """
    wrong = scored.filter(F.col("correct") == 0)
    columns = ["example_id", "split", "actual", "predicted"]
    if "symptoms" in scored.columns:
        return wrong.select(*columns, "symptoms")
    return wrong.select(*columns).join(examples.select("example_id", "symptoms"), "example_id")


def prediction_sample(scored: DataFrame, examples: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows by id with text, label, prediction and correctness."""
    if n <= 0:
        raise ValueError(f"a sample size must be positive, got {n}")
    narrow = scored.select("example_id", "actual", "predicted", (F.col("correct") == 1).alias("correct"))
    # The limit proves the size of what is broadcast, whatever the ids are.
    sample = F.broadcast(narrow.orderBy("example_id").limit(n)) if n <= SMALL else first_n(narrow, n)
    return _texts_up_to(examples, sample).join(sample, "example_id")


def _texts_up_to(examples: DataFrame, sample: DataFrame) -> DataFrame:
    """Texts up to the last sampled id, a filter the file scan can use."""
    last = sample.agg(F.max("example_id"))
    return examples.filter(F.col("example_id") <= last.scalar()).select("example_id", "symptoms")


def samples_by_split(scored: DataFrame, examples: DataFrame, splits, n: int = 10) -> DataFrame:
    """A prediction sample of every split, each its own small top-n."""
    parts = [
        prediction_sample(scored.filter(F.col("split") == name), examples, n).withColumn("split", F.lit(name))
        for name in splits
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked
