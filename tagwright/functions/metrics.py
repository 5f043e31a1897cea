"""Column expressions that compare predictions with labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwright.functions.text import normalize_label


def exact_match(actual: Column, predicted: Column) -> Column:
    """1.0 when both name the same label, else 0.0; no prediction counts as wrong."""
    same = normalize_label(predicted) == normalize_label(actual)
    return F.coalesce(same, F.lit(False)).cast("double")


def accuracy(correct: Column) -> Column:
    """Share of correct rows as an aggregate; 0.0 over no rows."""
    return F.coalesce(F.sum(correct) / F.count(F.lit(1)), F.lit(0.0))


def bounded(value: Column, name: str, low: float | None = None, high: float | None = None,
            above: float | None = None) -> Column:
    """The value itself; the job fails if it leaves its bounds."""
    bad = value.isNull()
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    if above is not None:
        bad = bad | (value <= above)
    message = F.concat(F.lit(f"{name} out of bounds: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(bad, F.raise_error(message).cast("double")).otherwise(value)
