"""Checks on tables of labelled text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tagwright.functions.prompts import feedback_column
from tagwright.functions.text import is_blank, normalize_label
from tagwright.session import small_frame, write_once
from tagwright.spec import RAW_TEST, RAW_TRAIN, TaskSpec


def in_vocabulary(label: Column, task: TaskSpec) -> Column:
    """Membership as a literal set inside the scan stage: no join, no shuffle."""
    return label.isin(*task.vocabulary)


def _problem(task: TaskSpec) -> Column:
    text, label = F.col("symptoms"), F.col("diagnosis")
    return (
        F.when(text.isNull(), "null_text")
        .when(is_blank(text), "empty_text")
        .when(label.isNull(), "null_label")
        .when(~in_vocabulary(label, task), "label_not_in_vocabulary")
    )


def check_columns(df: DataFrame) -> None:
    """Both columns are there and hold strings; read from the schema, no job."""
    types = dict(df.dtypes)
    for name in ("symptoms", "diagnosis"):
        if name not in types:
            raise ValueError(f"column '{name}' is missing; found {', '.join(df.columns)}")
        if types[name] != "string":
            raise ValueError(f"column '{name}' must be a string, not {types[name]}")


PROBLEMS = ("null_text", "empty_text", "null_label", "label_not_in_vocabulary")


def _counts(problem: Column) -> list[Column]:
    """Rows, rows under each problem, and valid and rejected rows."""
    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.coalesce(problem == name, F.lit(False))).alias(name) for name in PROBLEMS],
        F.count_if(problem.isNull()).alias("valid"),
        F.count_if(problem.isNotNull()).alias("rejected"),
    ]


def validation_report(df: DataFrame, task: TaskSpec, check_ids: bool = False) -> DataFrame:
    """One row of counts; a row is counted under the first problem it has.

    One scan and one tiny aggregation.  ``check_ids`` adds the number of rows
    whose id was used before, which costs a shuffle of the ids.
    """
    check_columns(df)
    report = df.withColumn("problem", _problem(task)).agg(*_counts(F.col("problem")))
    if check_ids:
        ids = df.groupBy("example_id").agg((F.count(F.lit(1)) - 1).alias("extra"))
        repeated = ids.agg(F.coalesce(F.sum("extra"), F.lit(0)))
        report = report.withColumn("repeated_ids", repeated.scalar())
    return report


def partition_valid(df: DataFrame, task: TaskSpec) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the rejected rows with the problem of each."""
    check_columns(df)
    marked = df.withColumn("problem", _problem(task))
    valid = marked.filter(F.col("problem").isNull()).drop("problem")
    return valid, marked.filter(F.col("problem").isNotNull())


def require_valid(df: DataFrame, task: TaskSpec, check_ids: bool = False) -> DataFrame:
    """``df`` itself; raises with the counts when any row is rejected."""
    counts = validation_report(df, task, check_ids).first().asDict()
    if counts["rejected"] or counts.get("repeated_ids"):
        found = ", ".join(f"{k}={v}" for k, v in counts.items() if v and k not in ("total", "valid"))
        raise ValueError(f"{counts['total']} rows checked: {found}")
    return df


def id_problems(df: DataFrame, key: str = "example_id") -> DataFrame:
    """Rows without an id, and rows whose id was used before, counted; one shuffle of the ids."""
    ids = df.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    missing = F.col("id").isNull()
    return ids.agg(
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("null_ids"),
        F.coalesce(F.sum(F.when(~missing, F.col("n") - 1)), F.lit(0)).alias("repeated_ids"),
    )


def require_ids(df: DataFrame, key: str = "example_id") -> DataFrame:
    """``df`` itself; raises when ids are missing or repeated."""
    found = {k: v for k, v in id_problems(df, key).first().asDict().items() if v}
    if found:
        raise ValueError(", ".join(f"{k}={v}" for k, v in found.items()))
    return df


def enforce(df: DataFrame, task: TaskSpec) -> DataFrame:
    """``df`` itself; the job that reads it fails at the first row to reject.

    The check rides along with the scan it guards, so it costs no pass of its own.
    """
    check_columns(df)
    problem = _problem(task)
    return df.filter(F.when(problem.isNull(), True).otherwise(F.raise_error(_rejection(problem)).cast("boolean")))


def _rejection(problem: Column) -> Column:
    row_id = F.coalesce(F.col("example_id").cast("string"), F.lit("without id"))
    return F.concat(F.lit("row "), row_id, F.lit(": "), problem)


def observed(df: DataFrame, task: TaskSpec) -> tuple[DataFrame, Observation]:
    """``df`` with the counts of ``validation_report`` taken along by whatever job reads it first."""
    check_columns(df)
    seen = Observation(f"validation-{uuid.uuid4().hex}")
    problem = _problem(task)
    counts = _counts(problem)
    if "example_id" in df.columns:
        counts.append(F.min(F.when(problem.isNotNull(), _rejection(problem))).alias("example"))
    return df.observe(seen, *counts), seen


def observed_counts(seen: Observation) -> dict[str, int]:
    """What an observed job has counted; zeros if it had no rows."""
    return {name: seen.get.get(name) or 0 for name in ("total", *PROBLEMS, "valid", "rejected")}


def write_valid(df: DataFrame, task: TaskSpec, name: str = "checked-rows") -> tuple[DataFrame, dict[str, int]]:
    """``df`` written once and read back, with the counts taken by the job that wrote it.

    Raises when any row is to be rejected, or when ids are missing or repeated; these
    are looked for in the id column of what was written.  Later jobs read the written
    rows and do not derive them anew.
    """
    watched, seen = observed(df, task)
    written = write_once(watched, name)
    counts = observed_counts(seen)
    if counts["rejected"]:
        wrong = ", ".join(f"{k}={counts[k]}" for k in PROBLEMS if counts[k])
        raise ValueError(f"{counts['total']} rows checked: {wrong}; {seen.get.get('example')}")
    return require_ids(written), counts


def invalid_labels(df: DataFrame, task: TaskSpec) -> DataFrame:
    """Rows whose label is outside the closed vocabulary."""
    label = F.col("diagnosis")
    return df.filter(label.isNotNull() & ~in_vocabulary(label, task))


def vocabulary_frame(df: DataFrame, task: TaskSpec) -> DataFrame:
    """The declared vocabulary as a one-column table."""
    rows = [(label,) for label in task.ordered]
    return small_frame(df.sparkSession, rows, "label string")


def vocab_coverage(df: DataFrame, task: TaskSpec) -> DataFrame:
    """Labels on one side only; no rows when data and vocabulary agree.

    One scan of the label column.  Labels of the data are combined per task, so
    a label that holds most rows costs one row per task.
    """
    found = df.filter(F.col("diagnosis").isNotNull()).select(
        F.col("diagnosis").alias("label"), F.lit(1).alias("in_data"), F.lit(0).alias("declared")
    )
    declared = vocabulary_frame(df, task).select(
        "label", F.lit(0).alias("in_data"), F.lit(1).alias("declared")
    )
    sides = found.unionByName(declared).groupBy("label").agg(
        F.max("in_data").alias("in_data"), F.max("declared").alias("declared")
    )
    return sides.filter(F.col("in_data") != F.col("declared")).select(
        "label",
        F.when(F.col("in_data") == 1, "missing_from_vocabulary").otherwise("missing_from_data").alias("problem"),
    )


def row_conservation(df: DataFrame) -> DataFrame:
    """Rows per raw split against all rows, in one pass."""
    return df.agg(
        F.count_if(F.col("split") == RAW_TRAIN).alias("train_rows"),
        F.count_if(F.col("split") == RAW_TEST).alias("test_rows"),
        F.count(F.lit(1)).alias("all_rows"),
    ).withColumn("conserved", F.col("train_rows") + F.col("test_rows") == F.col("all_rows"))


def flag_invalid_output(predictions: DataFrame, task: TaskSpec, column: str = "predicted",
                        validator: Callable[[Column], Column] | None = None) -> DataFrame:
    """Mark answers outside the vocabulary and word the feedback for a retry.

    ``validator`` replaces the vocabulary check; it maps an answer to a boolean
    and may be a ``pandas_udf``.
    """
    answer = F.col(column)
    valid = validator(answer) if validator else in_vocabulary(normalize_label(answer), task)
    return predictions.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn(
        "feedback", F.when(~F.col("valid"), feedback_column(task, answer))
    )
