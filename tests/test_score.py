import pytest
from pyspark.sql import functions as F

from tagwright.operators import compare, search
from tagwright.operators import score as scoring
from tests.conftest import make_examples, plan_of


def test_fixture(spark, scoring_fixture):
    scored = scoring.score(scoring_fixture)
    assert {r.example_id: r.correct for r in scored.collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert tuple(scoring.accuracy(scored).first()) == (0.4, 5)
    assert "Exchange" not in plan_of(scored)


def test_empty(spark, scoring_fixture):
    empty = scoring.score(scoring_fixture.limit(0))
    assert tuple(scoring.accuracy(empty).first()) == (0.0, 0)
    with pytest.raises(Exception, match="num_examples out of bounds"):
        scoring.checked(scoring.accuracy(empty)).collect()


def texts(spark):
    return spark.createDataFrame([(i, f"text {i}") for i in range(1, 6)], "example_id long, symptoms string")


def test_disagreements_and_sample(spark, scoring_fixture):
    scored = scoring.score(scoring_fixture).withColumn("split", F.lit("test"))
    wrong = scoring.disagreements(scored, texts(spark)).collect()
    assert {(r.example_id, r.symptoms) for r in wrong} == {(3, "text 3"), (4, "text 4"), (5, "text 5")}
    assert scoring.disagreement_count(scored).first().disagreements == 3
    right = scored.filter("correct = 1")
    assert scoring.disagreement_count(right).first().disagreements == 0
    sample = scoring.prediction_sample(scored, texts(spark), 3).orderBy("example_id").collect()
    assert [(r.example_id, r.symptoms, r.correct) for r in sample] == [
        (1, "text 1", True), (2, "text 2", True), (3, "text 3", False),
    ]
    stacked = scoring.samples_by_split(scored, texts(spark), ["test", "train"], 2)
    assert [r.example_id for r in stacked.orderBy("example_id").collect()] == [1, 2]


def test_accuracy_is_one_minus_disagreements(spark):
    df = make_examples(spark, 100).withColumnRenamed("diagnosis", "actual")
    scored = scoring.score(df.withColumn("predicted", F.when(F.col("example_id") % 3 == 0, F.col("actual"))))
    for r in scoring.accuracy_by_split(scored).collect():
        assert r.accuracy == pytest.approx(1 - r.disagreements / r.num_examples)


def test_missing_predictions_are_wrong(spark):
    df = make_examples(spark, 10)
    answers = df.filter("example_id < 4").select("example_id", F.upper("diagnosis").alias("predicted"))
    scored = scoring.score_rows(df, answers)
    assert scored.count() == 10 and scored.agg(F.sum("correct")).first()[0] == 4


def test_own_metric(spark, scoring_fixture):
    import pandas as pd

    @F.pandas_udf("double")
    def same_first_letter(actual: pd.Series, predicted: pd.Series) -> pd.Series:
        return (actual.str[0].str.lower() == predicted.str[0].str.lower()).astype(float)

    assert scoring.accuracy(scoring.score(scoring_fixture, same_first_letter)).first().accuracy == 0.4


def metrics(spark, rows):
    return spark.createDataFrame(rows, "run_id string, split string, metric string, value double")


FIXTURE = [
    ("a", "train", "accuracy", 0.80),
    ("a", "validation", "accuracy", 0.70),
    ("b", "train", "accuracy", 0.90),
    ("b", "validation", "accuracy", 0.705),
]


def test_comparison(spark):
    m = metrics(spark, FIXTURE)
    wide = {r.run_id: r for r in compare.compare_runs(m).collect()}
    assert wide["b"].train_accuracy == 0.9 and wide["a"].test_accuracy is None
    diff = {r.split: r.difference for r in compare.metric_diff(m, "a", "b").collect()}
    assert diff["train"] == pytest.approx(0.1) and diff["validation"] == pytest.approx(0.005)
    assert compare.winner(m, "a", "b").first().winner == "tie"
    assert compare.winner(m, "a", "b", split="train").first().winner == "b"
    assert compare.winner(m, "b", "a", split="train").first().winner == "b"
    assert compare.best_run(m).first().run_id == "b"
    tied = metrics(spark, [(r, "validation", "accuracy", 0.5) for r in ("z", "y")])
    assert compare.best_run(tied).first().run_id == "y"


def test_budgets():
    assert [(b.candidates, b.pool_rows) for b in search.BUDGETS.values()] == [(6, 100), (12, 300), (18, 1000)]
    assert search.budget("light").minibatch == 35 and search.budget("light").full_rounds == [5, 6]
    assert search.budget(None, candidates=2, pool_rows=10, full_every=1).full_rounds == [1, 2]
    with pytest.raises(ValueError, match="light, medium, heavy"):
        search.budget("huge")
    with pytest.raises(ValueError, match="minibatch"):
        search.budget("light", minibatch=0)
    with pytest.raises(ValueError, match="needs pool_rows"):
        search.budget(None, candidates=3)


def known_skill(skills):
    """Candidate c is right on the first skills[c] per cent of ids."""
    def run(rows, candidates):
        trial = F.explode(F.array(*[F.lit(c) for c in candidates]))
        level = F.create_map(*[F.lit(x) for c in candidates for x in (c, skills[c])])
        tried = rows.withColumnRenamed("diagnosis", "actual").withColumn("candidate_id", trial)
        right = F.col("example_id") % 100 < level[F.col("candidate_id")]
        return tried.withColumn("predicted", F.when(right, F.col("actual")))

    return run


def test_search_finds_the_best(spark):
    df = make_examples(spark, 400)
    skills = {1: 20, 2: 95, 3: 50, 4: 5}
    plan = search.budget(None, candidates=4, pool_rows=200, minibatch=20, full_every=2)
    table = search.search(df, [1, 2, 3, 4], known_skill(skills), plan)
    best = search.best_candidate(table, "full_accuracy").first()
    assert best.candidate_id == 2 and best.full_examples == 200
    got = {r.candidate_id: r for r in table.collect()}
    assert len(got) == 4 and got[4].full_accuracy is None
    assert got[2].minibatch_accuracy > got[3].minibatch_accuracy > got[4].minibatch_accuracy


def test_search_tries_each_row_once_per_candidate(spark):
    df = make_examples(spark, 50)
    seen = []

    def run(rows, candidates):
        seen.append((rows.count(), rows.select("example_id").distinct().count(), list(candidates)))
        return known_skill({1: 50, 2: 60})(rows, candidates)

    search.search(df, [1, 2], run, search.budget(None, candidates=2, pool_rows=30, minibatch=10))
    assert all(n == distinct for n, distinct, _ in seen) and len(seen) == 2
    with pytest.raises(ValueError, match="allows 1"):
        search.search(df, [1, 2], run, search.budget(None, candidates=1, pool_rows=30))


def test_minibatches_differ_by_round_and_repeat(spark):
    df = make_examples(spark, 300)
    def batch(frame, r):
        return {x.example_id for x in search.minibatch_sample(frame, 35, r).collect()}

    assert len(batch(df, 1)) == 35 and batch(df, 1) != batch(df, 2)
    assert batch(df, 1) == batch(df.repartition(11), 1)
