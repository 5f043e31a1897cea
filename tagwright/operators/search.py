"""Scoring prompt candidates on minibatches and choosing the best one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.functions.metrics import accuracy as accuracy_of
from tagwright.functions.text import hash_key
from tagwright.operators.rows import SMALL, sample_n
from tagwright.operators.score import score
from tagwright.session import small_frame, write_once


@dataclass(frozen=True)
class Budget:
    """How many candidates to try, on how many rows, and how often in full."""

    candidates: int
    pool_rows: int
    minibatch: int = 35
    full_every: int = 5
    rounds: int | None = None

    def __post_init__(self) -> None:
        for name in ("candidates", "pool_rows", "minibatch", "full_every"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    @property
    def n_rounds(self) -> int:
        return self.rounds or self.candidates

    @property
    def full_rounds(self) -> list[int]:
        """Rounds after which the leader is scored on the whole pool."""
        last = self.n_rounds
        return sorted({*range(self.full_every, last + 1, self.full_every), last})


# Search budgets by name.
BUDGETS = {
    "light": Budget(candidates=6, pool_rows=100),
    "medium": Budget(candidates=12, pool_rows=300),
    "heavy": Budget(candidates=18, pool_rows=1000),
}


def budget(auto: str | None = "light", **manual: int) -> Budget:
    """A named budget, or a manual one when ``auto`` is None."""
    if auto is None:
        missing = [name for name in ("candidates", "pool_rows") if name not in manual]
        if missing:
            raise ValueError(f"a budget without a name needs {', '.join(missing)}")
        return Budget(**manual)
    if auto not in BUDGETS:
        raise ValueError(f"unknown budget '{auto}'; choose from {', '.join(BUDGETS)}")
    return Budget(**{**BUDGETS[auto].__dict__, **manual})


def minibatch_sample(pool: DataFrame, size: int, round_number: int, seed: object = 42) -> DataFrame:
    """Ids of a round's rows: a top-n on the hash, salted with the round."""
    hashed = hash_key(F.col("example_id"), f"minibatch:{seed}:{round_number}")
    return (
        pool.select("example_id", hashed.alias("hash"))
        .orderBy("hash")
        .limit(size)
        .select(F.lit(round_number).alias("round"), "example_id")
    )


def candidate_scores(scored: DataFrame) -> DataFrame:
    """Accuracy and number of rows of every candidate."""
    return scored.groupBy("candidate_id").agg(
        accuracy_of(F.col("correct")).alias("accuracy"), F.count(F.lit(1)).alias("num_examples")
    )


def best_candidate(scores: DataFrame, column: str = "accuracy") -> DataFrame:
    """The candidate with the highest score; ties go to the first by id."""
    return scores.filter(F.col(column).isNotNull()).orderBy(F.desc(column), "candidate_id").limit(1)


# Rows under some candidates -> predictions with candidate_id, actual, predicted.
Run = Callable[[DataFrame, list], DataFrame]


def search(validation: DataFrame, candidates: list, run: Run, plan: Budget, seed: object = 42) -> DataFrame:
    """Minibatch score of every candidate and pool score of the leaders.

    Minibatches depend on the ids alone, so the rows of all rounds are predicted
    together, each (candidate, row) once; a second pass asks the leaders about the
    rest of the pool, and what both passes found is written.  The driver sees one number per candidate and round.
    """
    if not 0 < len(candidates) <= plan.candidates:
        raise ValueError(f"the budget allows {plan.candidates} candidates, got {len(candidates)}")
    pool = write_once(sample_n(validation, plan.pool_rows, f"pool:{seed}"), "search-pool")
    numbers = range(1, plan.n_rounds + 1)
    rounds = reduce(DataFrame.unionByName, [minibatch_sample(pool, plan.minibatch, r, seed) for r in numbers])
    chosen = rounds.select("example_id").distinct()
    if plan.minibatch * plan.n_rounds <= SMALL:
        chosen, rounds = F.broadcast(chosen), F.broadcast(rounds)
    rows = pool.join(chosen, "example_id", "left_semi")
    scored = write_once(score(run(rows, candidates)), "search-minibatches")
    by_round = (
        scored.join(rounds, "example_id")
        .groupBy("candidate_id", "round")
        .agg(F.sum("correct").alias("correct"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    leaders = _leaders(by_round, plan.full_rounds)
    minibatch = [
        (c, sum(x["correct"] for x in by_round if x["candidate_id"] == c)
         / max(1, sum(x["n"] for x in by_round if x["candidate_id"] == c)))
        for c in candidates
    ]
    # Rows of the minibatches have been answered under every candidate; only the others are asked.
    rest = pool.join(chosen, "example_id", "left_anti")
    answered = scored.filter(F.col("candidate_id").isin(leaders))
    in_full = answered.unionByName(write_once(score(run(rest, leaders)), "search-pool-scores").select(*scored.columns))
    full = candidate_scores(in_full).select(
        "candidate_id", F.col("accuracy").alias("full_accuracy"), F.col("num_examples").alias("full_examples")
    )
    kind = dict(scored.dtypes)["candidate_id"]
    table = small_frame(validation.sparkSession, minibatch, f"candidate_id {kind}, minibatch_accuracy double")
    return table.join(full, "candidate_id", "left")


def _leaders(by_round: list, full_rounds: list[int]) -> list:
    """Best running mean after each full round among candidates not yet taken."""
    leaders: list = []
    for last in full_rounds:
        totals: dict = {}
        for x in by_round:
            if x["round"] <= last and x["candidate_id"] not in leaders:
                correct, n = totals.get(x["candidate_id"], (0.0, 0))
                totals[x["candidate_id"]] = (correct + x["correct"], n + x["n"])
        if totals:
            leaders.append(min(totals, key=lambda c: (-totals[c][0] / totals[c][1], c)))
    return leaders
