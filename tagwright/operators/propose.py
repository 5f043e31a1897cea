"""Searching prompts by proposals: scores so far tell which candidates are tried next.

A candidate is one of some instructions with one of some demonstration sets.  A small
model of the scores, fitted on the driver from one pair of numbers per candidate tried,
expects of a candidate what its instruction, its demonstrations and its own rows have
shown, each drawn towards the mean by a number of rows assumed beforehand.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.operators.rows import SMALL, sample_n
from tagwright.operators.score import score
from tagwright.operators.search import Budget, Run, minibatch_sample
from tagwright.session import small_frame, write_once

# How much an instruction or a demonstration set tried on few rows is preferred.
CURIOSITY = 0.5
# Expectations are compared up to this many decimals, so that ties do not hang on the order of addition.
DECIMALS = 9


@dataclass(frozen=True)
class Candidate:
    """One choice of instruction and demonstration set, all numbered from 1."""

    candidate_id: int
    instruction: int
    demo_set: int


def grid(instructions: int, demo_sets: int) -> list[Candidate]:
    """Every instruction with every demonstration set."""
    if instructions < 1 or demo_sets < 1:
        raise ValueError("a search needs an instruction and a demonstration set")
    return [Candidate((i - 1) * demo_sets + s, i, s) for i in range(1, instructions + 1) for s in range(1, demo_sets + 1)]


class Surrogate:
    """What to expect of candidates after some have been scored."""

    def __init__(self, candidates: list[Candidate], prior_rows: float, curiosity: float = CURIOSITY) -> None:
        self.candidates = {c.candidate_id: c for c in candidates}
        self.prior_rows = prior_rows
        self.curiosity = curiosity
        self.seen: dict[int, tuple[float, int]] = {}

    def observe(self, candidate_id: int, correct: float, n: int) -> None:
        """Scores of a candidate, in place of earlier ones."""
        self.seen[candidate_id] = correct, n

    def _sums(self, part: str, value: int) -> tuple[float, int]:
        mine = [self.seen[c] for c in sorted(self.seen) if getattr(self.candidates[c], part) == value]
        return sum(correct for correct, _ in mine), sum(n for _, n in mine)

    def _parts(self, candidate_id: int) -> list[tuple[float, int]]:
        chosen = self.candidates[candidate_id]
        return [self._sums(part, getattr(chosen, part)) for part in ("instruction", "demo_set")]

    def expected(self, candidate_id: int) -> float:
        """Expected accuracy; without any scores 0."""
        rows = sum(n for _, n in self.seen.values())
        mean = sum(correct for correct, _ in self.seen.values()) / rows if rows else 0.0
        base = mean + sum((c - mean * n) / (n + self.prior_rows) for c, n in self._parts(candidate_id))
        correct, n = self.seen.get(candidate_id, (0.0, 0))
        return base + (correct - n * base) / (n + self.prior_rows)

    def promise(self, candidate_id: int) -> float:
        """The expectation, raised for what has been tried on few rows."""
        return self.expected(candidate_id) + self.curiosity * sum(
            1 / math.sqrt(n + self.prior_rows) for _, n in self._parts(candidate_id)
        )

    def propose(self, n: int, tried: set[int]) -> list[int]:
        """The most promising candidates not tried yet; ties go to the first by id."""
        open_ones = [c for c in self.candidates if c not in tried]
        return sorted(open_ones, key=lambda c: (-round(self.promise(c), DECIMALS), c))[:n]

    def leader(self, among: set[int]) -> int | None:
        return min(among, key=lambda c: (-round(self.expected(c), DECIMALS), c), default=None)


def first_candidates(candidates: list[Candidate], most: int) -> list[int]:
    """A start in which every instruction and every demonstration set occurs, as far as ``most`` goes."""
    instructions, sets = ({getattr(c, part) for c in candidates} for part in ("instruction", "demo_set"))
    by_parts = {(c.instruction, c.demo_set): c.candidate_id for c in candidates}
    ordered = [sorted(instructions), sorted(sets)]
    size = min(most, max(len(instructions), len(sets)))
    diagonal = [tuple(part[t % len(part)] for part in ordered) for t in range(size)]
    return [by_parts[at] for at in diagonal if at in by_parts]


_ROUNDS = "round int, candidate_id int, kind string, correct double, num_examples long, expected double"


def search_proposed(validation: DataFrame, candidates: list[Candidate], run: Run, plan: Budget, width: int = 2,
                    seed: object = 42) -> tuple[DataFrame, DataFrame]:
    """What was tried in each round, and the accuracy of the leaders on the whole pool.

    The first round spreads over instructions and demonstration sets with half of the
    ``plan.candidates``; each later one tries the ``width`` most promising on a
    minibatch of its own.  After every ``plan.full_every`` rounds and after the last,
    the leader is scored on the rest of the pool and its scores there count from then
    on.  No candidate is asked about a row twice.  The driver sees one pair of numbers
    per candidate tried.
    """
    if width < 1:
        raise ValueError(f"a round needs a candidate, got a width of {width}")
    spark = validation.sparkSession
    pool = write_once(sample_n(validation, plan.pool_rows, f"pool:{seed}"), "proposal-pool")
    model = Surrogate(candidates, float(plan.minibatch))
    tried: dict[int, int] = {}
    recorded: list[tuple] = []
    full: dict[int, tuple[float, int]] = {}

    def chosen_rows(number: int) -> DataFrame:
        ids = minibatch_sample(pool, plan.minibatch, number, seed).select("example_id")
        return F.broadcast(ids) if plan.minibatch <= SMALL else ids

    def asked(rows: DataFrame, ids: list[int]) -> dict[int, tuple[float, int]]:
        sums = score(run(rows, ids)).groupBy("candidate_id").agg(F.sum("correct").alias("correct"), F.count(F.lit(1)).alias("n"))
        return {row["candidate_id"]: (row["correct"], row["n"]) for row in sums.collect()}

    picked = first_candidates(candidates, max(2, plan.candidates // 2))
    number = 0
    while picked:
        number += 1
        found = asked(pool.join(chosen_rows(number), "example_id", "left_semi"), picked)
        hoped = {c: model.expected(c) if tried else None for c in picked}
        for c in picked:
            tried[c] = number
            correct, n = found.get(c, (0.0, 0))
            recorded.append((number, c, "minibatch", correct, n, hoped[c]))
        for c in picked:
            model.observe(c, *found.get(c, (0.0, 0)))
        left = min(width, plan.candidates - len(tried))
        coming = model.propose(left, set(tried)) if left > 0 else []
        if number % plan.full_every == 0 or not coming:
            leader = model.leader(set(tried) - set(full))
            if leader is not None:
                hope = model.expected(leader)
                rest = pool.join(chosen_rows(tried[leader]), "example_id", "left_anti")
                more = asked(rest, [leader]).get(leader, (0.0, 0))
                before = model.seen[leader]
                full[leader] = before[0] + more[0], before[1] + more[1]
                model.observe(leader, *full[leader])
                recorded.append((number, leader, "pool", *full[leader], hope))
                # What the pool has shown may change the next proposals.
                coming = model.propose(left, set(tried)) if left > 0 else []
        picked = coming
    trials = [(c, correct / n if n else 0.0, n) for c, (correct, n) in sorted(full.items())]
    return (
        small_frame(spark, recorded, _ROUNDS),
        small_frame(spark, trials, "candidate_id int, full_accuracy double, full_examples long"),
    )
