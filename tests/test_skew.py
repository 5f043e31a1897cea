"""A third and more of all rows under one text, label, run or word."""

from collections import Counter

from pyspark.sql import functions as F

from tagwright.operators import profile, rows, validate
from tagwright.operators.predictors import predictor
from tagwright.operators.score import accuracy_by_split, score
from tagwright.sources import tracking
from tagwright.spec import TaskSpec
from tests.conftest import make_examples

TASK = TaskSpec("t", ("allergy", "malaria", "migraine"))


def test_one_text_holds_half_of_the_rows(spark):
    df = make_examples(spark, 400, hot=200)
    top = {r.column_name: r for r in profile.describe_categorical(df).collect()}["symptoms"]
    assert (top.top, top.freq, top.unique, top["count"]) == ("same text", 200, 201, 400)
    assert rows.assign_ids(df.drop("example_id"), chunk=16).select("example_id").distinct().count() == 400
    assert validate.validation_report(df, TASK, check_ids=True).first().valid == 400


def test_predictions_of_copies_agree_and_none_is_lost(spark):
    df = make_examples(spark, 400, hot=200)
    for name, options in (("words", {}), ("words", {"broadcast_bytes": 0}), ("nearest_demo", {})):
        got = predictor(name, **options).fit(df, TASK).predict(df).collect()
        assert Counter(r.example_id for r in got) == Counter(range(400))
        assert len({r.predicted for r in got if r.example_id < 200}) == 1


def test_one_label_holds_most_rows(spark):
    df = make_examples(spark, 300).withColumn(
        "diagnosis", F.when(F.col("example_id") % 10 < 9, "malaria").otherwise(F.col("diagnosis"))
    )
    counts = Counter(r.diagnosis for r in df.collect())
    by_split = accuracy_by_split(score(predictor("majority").fit(df, TASK).predict(df))).collect()
    assert sum(r.num_examples - r.disagreements for r in by_split) == counts["malaria"]


def test_one_run_logged_most_values(spark):
    logged = [("hot" if i % 3 else f"run{i}", "test", "accuracy", float(i), i) for i in range(3000)]
    log = spark.createDataFrame(logged, "run_id string, split string, metric string, value double, logged_at long")
    got = {r.run_id: r.value for r in tracking.metrics_latest(log.repartition(9)).collect()}
    assert got["hot"] == 2999.0 and len(got) == 1001


def test_rows_that_are_alike_stay_as_many(spark):
    df = spark.createDataFrame([(1, "calls malaria", "malaria", "train")] * 50, "example_id long, symptoms string, diagnosis string, split string")
    for options in ({}, {"broadcast_bytes": 0}):
        assert predictor("words", **options).fit(df, TASK).predict(df).count() == 50


def test_a_word_frequent_only_in_the_scored_rows(spark):
    """No task of the join by word gets its occurrences."""
    train = make_examples(spark, 60)
    flooded = make_examples(spark, 400).withColumn("symptoms", F.concat("symptoms", F.lit(" flood" * 40)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = predictor("words", broadcast_bytes=0).fit(train.withColumn("symptoms", F.concat("symptoms", F.lit(" flood"))), TASK)
        got = model.predict(flooded)
        assert got.count() == 400
        plain = predictor("words").fit(train.withColumn("symptoms", F.concat("symptoms", F.lit(" flood"))), TASK).predict(flooded)
        assert {(r.example_id, r.predicted) for r in got.collect()} == {(r.example_id, r.predicted) for r in plain.collect()}
        plan = got._jdf.queryExecution().toString()
        assert "LeftAnti" in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
