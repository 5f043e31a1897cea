"""The proposing search: its expectations, fewer calls than trying everything, and the same winner where that is known."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tagwright.functions.text import hash_key
from tagwright.operators import propose, search
from tagwright.operators.predictors import predictor
from tagwright.spec import TaskSpec
from tests.conftest import make_examples

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TASK = TaskSpec("t", ("allergy", "malaria", "migraine"), label_noun="diagnosis")


def test_expectations_by_hand():
    space = propose.grid(2, 2)
    model = propose.Surrogate(space, 10.0, curiosity=0.0)
    assert model.expected(1) == 0.0 and [c.candidate_id for c in space] == [1, 2, 3, 4]
    model.observe(1, 9, 10)
    model.observe(4, 3, 10)
    # Mean 0.6; instruction 1 and set 1 are 3 rows above it, drawn to 3 / 20 each; own rows add 0.05 * 10 / 20 less.
    base = 0.6 + 0.15 + 0.15
    assert model.expected(1) == pytest.approx(base + (9 - 10 * base) / 20)
    assert model.expected(2) == pytest.approx(0.6 + 0.15 - 0.15) == model.expected(3)
    assert model.propose(2, {1, 4}) == [2, 3] and model.propose(1, {1, 2, 4}) == [3] and model.leader({1, 4}) == 1
    model.observe(1, 0, 10)
    assert model.leader({1, 4}) == 4 and model.leader(set()) is None


def test_curiosity_prefers_what_is_new():
    model = propose.Surrogate(propose.grid(3, 1), 5.0, curiosity=5.0)
    model.observe(1, 5, 5)
    assert model.propose(1, set()) == [2]


def test_start_covers_every_part():
    space = propose.grid(3, 5)
    by_id = {c.candidate_id: c for c in space}
    start = [by_id[c] for c in propose.first_candidates(space, 9)]
    assert {c.instruction for c in start} == {1, 2, 3} and {c.demo_set for c in start} == {1, 2, 3, 4, 5} and len(start) == 5
    assert len(propose.first_candidates(space, 2)) == 2
    with pytest.raises(ValueError):
        propose.grid(0, 3)


#: Shares right by instruction and by demonstration set; they add up.
WORDINGS, SETS = (0.2, 0.5, 0.35, 0.25), (0.0, 0.1, 0.4, 0.15, 0.05)


def additive(space, asked):
    """Candidates that are right on the rows whose hash is below their share."""
    shares = {c.candidate_id: WORDINGS[c.instruction - 1] + SETS[c.demo_set - 1] for c in space}

    def run(frame, ids):
        asked.append((frame.count(), list(ids)))
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(shares[c]).alias("share")) for c in ids]))
        rows = frame.select("example_id", F.col("diagnosis").alias("actual"), each.alias("x"))
        place = F.conv(F.substring(hash_key(F.col("example_id"), "right"), 1, 8), 16, 10).cast("long") / float(1 << 32)
        right = F.when(place < F.col("x.share"), F.col("actual")).otherwise("none")
        return rows.select("example_id", "actual", F.col("x.c").alias("candidate_id"), right.alias("predicted"))

    return run


def test_finds_the_known_winner_with_fewer_calls(spark):
    rows = make_examples(spark, 900)
    space = propose.grid(len(WORDINGS), len(SETS))
    plan = search.Budget(candidates=12, pool_rows=300, minibatch=60, full_every=2)
    asked, everything = [], []
    rounds, trials = propose.search_proposed(rows, space, additive(space, asked), plan)
    winner = search.best_candidate(trials, "full_accuracy").first()
    best = next(c.candidate_id for c in space if (c.instruction, c.demo_set) == (2, 3))
    pool = propose.sample_n(rows, 300, "pool:42")
    exhaustive = search.candidate_scores(propose.score(additive(space, everything)(pool, [c.candidate_id for c in space])))
    known = search.best_candidate(exhaustive).first()
    assert winner.candidate_id == best == known.candidate_id and winner.full_accuracy == known.accuracy
    calls, all_calls = (sum(n * len(ids) for n, ids in done) for done in (asked, everything))
    assert calls < all_calls / 3
    found = rounds.collect()
    # Nobody is asked twice about a row, and every trial is recorded.
    tried = [r.candidate_id for r in found if r.kind == "minibatch"]
    assert len(tried) == len(set(tried)) == 12 and all(r.num_examples == 60 for r in found if r.kind == "minibatch")
    assert {r.num_examples for r in found if r.kind == "pool"} == {300}


def test_small_spaces_end_early(spark):
    rows = make_examples(spark, 50)
    space = propose.grid(1, 1)
    rounds, trials = propose.search_proposed(rows, space, additive(space, []), search.Budget(candidates=6, pool_rows=100))
    assert [(r.round, r.kind, r.num_examples) for r in rounds.collect()] == [(1, "minibatch", 35), (1, "pool", 50)]
    assert trials.count() == 1
    with pytest.raises(ValueError, match="width"):
        propose.search_proposed(rows, space, additive(space, []), search.Budget(2, 10), width=0)


def build(model):
    """Answers right where the prompt says so."""

    def complete(system, messages):
        if "Think." in system:
            return [next((x for x in TASK.vocabulary if x in m), "none") for m in messages]
        return ["allergy"] * len(messages)

    return complete


def test_predictor_with_proposals(spark):
    rows = make_examples(spark, 120)
    chosen = predictor("callable", build=build, optimizer="propose", candidate_instructions=("Guess.", "Think."), auto=None,
                       num_candidates=6, pool_rows=40, minibatch=10, max_retries=0)
    model = chosen.fit(rows, TASK, rows)
    assert model.prompt.instructions == "Think." and model.trials.count() >= 6 and chosen.requires_training
    assert model.predict(rows).filter("predicted = actual").count() == 120
