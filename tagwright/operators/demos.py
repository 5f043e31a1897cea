"""Choosing the worked examples that go into a prompt."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.functions.prompts import Demo, Prompt
from tagwright.functions.text import hash_key
from tagwright.operators.rows import SMALL, fetch, first_ids_by_hash
from tagwright.operators.score import score
from tagwright.session import small_frame

# How many demonstrations of each kind a prompt takes by default.
MAX_BOOTSTRAPPED = 3
MAX_LABELED = 4

# A slice of about so many rows is fetched by id.
SLICE_IDS = 1000

# Example rows -> rows with ``actual`` and ``predicted``.
Teacher = Callable[[DataFrame], DataFrame]


def _demos(train: DataFrame, ids: list, kind: str) -> DataFrame:
    return fetch(train, ids).select("ord", F.lit(kind).alias("kind"), "example_id", "symptoms", "diagnosis")


def labeled_ids(train: DataFrame, k: int = MAX_LABELED, seed: object = 42, exclude=()) -> list:
    """Ids of a seeded pick of training rows, none of them in ``exclude``."""
    rows = train.filter(~F.col("example_id").isin(list(exclude))) if exclude else train
    return first_ids_by_hash(rows, k, f"labeled:{seed}")


def labeled_demos(train: DataFrame, k: int = MAX_LABELED, seed: object = 42, exclude=()) -> DataFrame:
    """Training rows as they are: at most k, picked by hash."""
    return _demos(train, labeled_ids(train, k, seed, exclude), "labeled")


def bootstrap_ids(train: DataFrame, teacher: Teacher, k: int = MAX_BOOTSTRAPPED, seed: object = 42,
                  first_slice: int = 64) -> list:
    """Ids of the first k training rows, in hash order, that a teacher gets right.

    Rows are tried slice by slice along the hash, each slice four times as wide,
    until k are right: the answer is that of predicting the whole table, at the
    price of about k rows when the teacher is any good.
    """
    if k <= 0:
        return []
    salt = f"bootstrap:{seed}"
    hashed = hash_key(F.col("example_id"), salt)
    n = train.count()
    found: list = []
    low, high = 0.0, min(1.0, first_slice / max(n, 1))
    while n:
        bounds = hashed >= F.lit(_hash_bound(low))
        if high < 1.0:
            bounds = bounds & (hashed < F.lit(_hash_bound(high)))
        part = train.filter(bounds)
        if high * n <= SLICE_IDS:
            # So few rows are found in the id column alone, and the scan is told their ids.
            ids = [row[0] for row in train.select("example_id").filter(bounds).collect()]
            part = train.filter(F.col("example_id").isin(ids))
        scored = score(teacher(part))
        found += first_ids_by_hash(scored.filter(F.col("correct") == 1), k - len(found), salt)
        if len(found) >= k or high >= 1.0:
            break
        low, high = high, min(1.0, high * 4)
    return found


def _hash_bound(share: float) -> str:
    return format(int(share * 2**48), "012x")


def bootstrap_demos(train: DataFrame, teacher: Teacher, k: int = MAX_BOOTSTRAPPED, seed: object = 42) -> DataFrame:
    """Training rows that a teacher gets right: at most k, picked by hash."""
    return _demos(train, bootstrap_ids(train, teacher, k, seed), "bootstrapped")


def demo_set(train: DataFrame, teacher: Teacher | None = None, max_bootstrapped: int = MAX_BOOTSTRAPPED,
             max_labeled: int = MAX_LABELED, seed: object = 42) -> DataFrame:
    """Bootstrapped demonstrations first, then labeled ones, numbered through."""
    boot = bootstrap_ids(train, teacher, max_bootstrapped, seed) if teacher else []
    labeled = labeled_ids(train, max_labeled, seed, boot)
    return fetch(train, boot + labeled).select(
        "ord",
        F.when(F.col("ord") <= len(boot), "bootstrapped").otherwise("labeled").alias("kind"),
        "example_id",
        "symptoms",
        "diagnosis",
    )


def demo_sets(train: DataFrame, n_sets: int, k: int = MAX_LABELED, seed: object = 42) -> DataFrame:
    """Several seeded picks of k labeled demonstrations, told apart by ``demo_set_id``.

    All picks are made in one job over the ids; the few chosen rows are then read.
    """
    if n_sets * k > SMALL:
        raise ValueError(f"at most {SMALL} demonstrations can be picked")
    picks = [
        train.select(
            F.lit(c).alias("demo_set_id"),
            "example_id",
            hash_key(F.col("example_id"), f"labeled:{seed}-{c}").alias("hash"),
        )
        .orderBy("hash")
        .limit(k)
        for c in range(1, n_sets + 1)
    ]
    chosen = reduce(DataFrame.unionByName, picks).collect()
    ords: dict = {}
    numbered = []
    for set_id, row_id, _ in sorted(chosen, key=lambda x: (x["demo_set_id"], x["hash"])):
        ords[set_id] = ords.get(set_id, 0) + 1
        numbered.append((set_id, ords[set_id], row_id))
    kind = dict(train.dtypes)["example_id"]
    table = small_frame(train.sparkSession, numbered, f"demo_set_id int, ord int, example_id {kind}")
    rows = train.filter(F.col("example_id").isin([x[2] for x in numbered]))
    return rows.join(F.broadcast(table), "example_id").select(
        "demo_set_id", "ord", F.lit("labeled").alias("kind"), "example_id", "symptoms", "diagnosis"
    )


def as_prompt_demos(demos: DataFrame) -> tuple[Demo, ...]:
    """The few demonstrations as driver values, in order."""
    return tuple(Demo(row["symptoms"], row["diagnosis"]) for row in sorted(demos.collect(), key=lambda r: r["ord"]))


def from_prompt(spark: SparkSession, prompt: Prompt) -> DataFrame:
    """The demonstrations of a prompt as a table again."""
    rows = [(i, "shown", d.symptoms, d.diagnosis) for i, d in enumerate(prompt.demos, 1)]
    return small_frame(spark, rows, "ord int, kind string, symptoms string, diagnosis string")
