"""Deterministic, un-stratified train/validation split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions.text import hash_below, hash_key
from tagwright.operators.rows import kth_smallest

SEED = 42
TRAIN_RATIO = 0.8

MODES = ("hash", "exact")


def in_train(df: DataFrame, ratio: float = TRAIN_RATIO, seed: int = SEED, mode: str = "hash",
             key: str = "example_id") -> Column:
    """Condition that holds for the training part of ``df``.

    ``hash`` decides each row by its own id: no shuffle, and adding rows never
    moves old ones.  ``exact`` takes ``floor(ratio * n)`` rows in hash order: it
    finds the cut-off hash first and is then the same kind of filter.
    """
    if mode == "hash":
        return hash_below(F.col(key), seed, ratio)
    if mode != "exact":
        raise ValueError(f"unknown split mode '{mode}'; choose from {', '.join(MODES)}")
    if not 0.0 < ratio < 1.0:
        raise ValueError(f"ratio must lie strictly between 0 and 1, got {ratio}")
    hashes = df.select(hash_key(F.col(key), seed).alias("key"))
    cutoff = kth_smallest(hashes, lambda n: math.floor(ratio * n))
    if cutoff is None:
        return F.lit(False)
    return hash_key(F.col(key), seed) <= F.lit(cutoff)


def train_validation(df: DataFrame, ratio: float = TRAIN_RATIO, seed: int = SEED, mode: str = "hash",
                     key: str = "example_id") -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that together are ``df``."""
    chosen = in_train(df, ratio, seed, mode, key)
    return df.filter(chosen), df.filter(~chosen)


def mark_parts(df: DataFrame, ratio: float = TRAIN_RATIO, seed: int = SEED, mode: str = "hash",
               key: str = "example_id", column: str = "split") -> DataFrame:
    """``df`` with the part of each row, ``train`` or ``validation``, as a column."""
    part = F.when(in_train(df, ratio, seed, mode, key), "train").otherwise("validation")
    return df.withColumn(column, part)
