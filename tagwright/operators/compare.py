"""Comparing runs by their recorded metrics ``(run_id, split, metric, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.sources.tracking import metrics_latest

# Fixed value: differences up to this size count as a tie.
TIE_BAND = 0.01


def _latest(metrics: DataFrame) -> DataFrame:
    """The last value of each metric where values carry the time they were logged; runs may be resumed."""
    return metrics_latest(metrics) if "logged_at" in metrics.columns else metrics


def compare_runs(metrics: DataFrame, metric: str = "accuracy", splits=("train", "validation", "test"),
                 runs: DataFrame | None = None) -> DataFrame:
    """One row per run, one column per split; with ``runs`` also the framework each run used."""
    wide = _latest(metrics.filter(F.col("metric") == metric)).groupBy("run_id").agg(
        *[F.max(F.when(F.col("split") == s, F.col("value"))).alias(f"{s}_{metric}") for s in splits]
    )
    if runs is None:
        return wide
    named = runs.groupBy("run_id").agg(F.max(F.col("tags")["framework"]).alias("framework"))
    return wide.join(named, "run_id", "left")


def metric_diff(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """Values of two runs side by side and second minus first.

    A conditional aggregation: one shuffle, where a self-join needs two.
    """
    both = _latest(metrics.filter(F.col("run_id").isin(first, second))).groupBy("split", "metric").agg(
        F.max(F.when(F.col("run_id") == first, F.col("value"))).alias("first_value"),
        F.max(F.when(F.col("run_id") == second, F.col("value"))).alias("second_value"),
    )
    return both.withColumn("difference", F.col("second_value") - F.col("first_value"))


def winner(metrics: DataFrame, first: str, second: str, split: str = "validation", metric: str = "accuracy",
           band: float = TIE_BAND) -> DataFrame:
    """The better run, or ``tie`` when the difference stays within the band."""
    chosen = (F.col("split") == split) & (F.col("metric") == metric)
    difference = F.col("difference")
    better = F.when(difference > band, F.lit(second)).when(difference < -band, F.lit(first)).otherwise("tie")
    return metric_diff(metrics.filter(chosen), first, second).select("difference", better.alias("winner"))


def best_run(metrics: DataFrame, split: str = "validation", metric: str = "accuracy",
             order: list[str] | None = None) -> DataFrame:
    """The run with the highest value; ties go to the run named first in ``order``, then to the first run id."""
    chosen = _latest(metrics.filter((F.col("split") == split) & (F.col("metric") == metric)))
    ties = ["run_id"]
    if order is not None:
        chosen = chosen.filter(F.col("run_id").isin(order))
        ties = [F.array_position(F.array(*[F.lit(r) for r in order]), F.col("run_id"))]
    return chosen.orderBy(F.desc("value"), *ties).limit(1).select("run_id", "value")
