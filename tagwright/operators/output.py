"""From raw model answers to labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions.prompts import STYLES
from tagwright.functions.text import strip

_REPLY = "diagnosis string, reasoning string"


def answer(raw: Column, style: str) -> Column:
    """The label named by a raw answer; null when a structured answer has none."""
    if style not in STYLES:
        raise ValueError(f"unknown prompt style '{style}'; choose from {', '.join(STYLES)}")
    if style == "answer_only":
        return strip(raw)
    return strip(F.from_json(raw, _REPLY).getField("diagnosis"))


def parse_output(df: DataFrame, style: str = "answer_only", column: str = "raw_output") -> DataFrame:
    """Add ``predicted``, and ``reasoning`` where the style asks for it."""
    raw = F.col(column)
    parsed = df.withColumn("predicted", answer(raw, style))
    if style == "reasoned":
        parsed = parsed.withColumn("reasoning", F.from_json(raw, _REPLY).getField("reasoning"))
    return parsed


def token_usage(predictions: DataFrame) -> DataFrame:
    """Prompt and completion tokens per run and split; null where none was reported."""
    return predictions.groupBy("run_id", "split").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )
