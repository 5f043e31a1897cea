import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagwright.operators import demos, predictors
from tagwright.operators.predict import carried
from tagwright.operators.rows import first_ids_by_hash
from tagwright.operators.score import accuracy, score
from tagwright.spec import TaskSpec
from tests.conftest import make_examples, plan_of

TASK = TaskSpec("t", ("allergy", "malaria", "migraine"))


def predicted(model, rows):
    return {r.example_id: r.predicted for r in model.predict(rows).collect()}


def test_registry():
    assert {"callable", "column", "majority", "nearest_demo", "words"} <= set(predictors.available())
    with pytest.raises(ValueError, match=f"available: {', '.join(predictors.available())}$"):
        predictors.predictor("nothing")
    with pytest.raises(TypeError):
        predictors.predictor("majority", unknown_option=1)
    assert predictors.predictor("words").requires_training
    assert not predictors.predictor("callable").requires_training
    assert predictors.predictor("callable", optimizer="bootstrap").requires_training


def test_a_predictor_of_ones_own_comes_and_goes():
    class Own(predictors.ColumnPredictor):
        name = "own"

    before = predictors.available()
    with predictors.registered(Own):
        assert "own" in predictors.available() and isinstance(predictors.predictor("own"), Own)
    assert predictors.available() == before
    with predictors.registered(type("Majority", (Own,), {"name": "majority"})):
        assert predictors.predictor_class("majority") is not predictors.MajorityPredictor
    assert predictors.predictor_class("majority") is predictors.MajorityPredictor


def test_candidates_are_compared_once(spark):
    """No condition computed from the answers reaches the scan; it would compare every row once more."""
    train = make_examples(spark, 60)
    sets = demos.demo_sets(train, 3, 4)
    plan = plan_of(predictors.nearest_by_candidate(train, sets))
    assert "Condition" not in plan or "array_intersect" not in "".join(x for x in plan.splitlines() if x.startswith("Condition"))
    assert plan.split("Subqueries")[0].count("regexp_extract_all") <= 2


def test_column(spark):
    df = make_examples(spark, 6).withColumn("answer", F.col("diagnosis"))
    model = predictors.predictor("column", column="answer").fit(df, TASK)
    assert accuracy(score(model.predict(df))).first().accuracy == 1.0


def test_majority_breaks_ties_by_name(spark):
    df = make_examples(spark, 9)
    assert set(predicted(predictors.predictor("majority").fit(df, TASK), df).values()) == {"allergy"}
    more = df.union(df.filter("diagnosis = 'migraine'"))
    assert set(predicted(predictors.predictor("majority").fit(more, TASK), df).values()) == {"migraine"}


def naive_bayes(train, rows):
    """The words predictor spelled out in plain Python."""
    def tokens(t):
        return "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()

    counts = {l: Counter() for l in TASK.ordered}
    n = Counter()
    for _, text, label in train:
        counts[label].update(tokens(text))
        n[label] += 1
    words = set().union(*counts.values())
    result = {}
    for row_id, text, _ in rows:
        scores = []
        for i, l in enumerate(TASK.ordered):
            s = round(math.log((n[l] + 1) / (len(train) + 3)) * 1e6)
            total = sum(counts[l].values())
            s += sum(round(math.log((counts[l][w] + 1) / (total + len(words))) * 1e6) for w in tokens(text) if w in words)
            scores.append((s, -i, l))
        result[row_id] = max(scores)[2]
    return result


TEXTS = [
    (1, "fever and shivers, fever again", "malaria"),
    (2, "a runny nose and itchy eyes", "allergy"),
    (3, "throbbing head, light hurts", "migraine"),
    (4, "itchy skin after eating nuts", "allergy"),
    (5, "head aches and a fever", "malaria"),
]
UNSEEN = [
    (10, "itchy nose", None),
    (11, "the head hurts", None),
    (12, "fever fever fever itchy", None),
    (13, "wholly unknown words", None),
    (14, "", None),
    (15, None, None),
    (16, "12345 !!", None),
]


@pytest.mark.parametrize("broadcast_bytes", [predictors.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("hot_share", [predictors.HOT_SHARE, 0.1, 2.0])
def test_words_equals_plain_python(spark, monkeypatch, broadcast_bytes, hot_share):
    monkeypatch.setattr(predictors, "HOT_SHARE", hot_share)
    schema = "example_id long, symptoms string, diagnosis string"
    train, rows = spark.createDataFrame(TEXTS, schema), spark.createDataFrame(UNSEEN + TEXTS, schema)
    model = predictors.predictor("words", broadcast_bytes=broadcast_bytes).fit(train, TASK)
    assert predicted(model, rows) == naive_bayes(TEXTS, UNSEEN + TEXTS)


@pytest.mark.parametrize("broadcast_bytes", [predictors.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("block", [1, 2, 64])
def test_words_in_blocks_of_labels_equals_plain_python(spark, monkeypatch, broadcast_bytes, block):
    monkeypatch.setattr(predictors, "BLOCK", block)
    schema = "example_id long, symptoms string, diagnosis string"
    odd = [(6, "words of an unlisted label", "scurvy"), (7, "and of none", None)]
    train, rows = spark.createDataFrame(TEXTS, schema), spark.createDataFrame(UNSEEN + TEXTS + UNSEEN, schema)
    model = predictors.predictor("words", broadcast_bytes=broadcast_bytes).fit(train, TASK)
    answers = model.predict(rows).collect()
    want = naive_bayes(TEXTS, UNSEEN + TEXTS)
    assert len(answers) == len(UNSEEN) * 2 + len(TEXTS) and all(r.predicted == want[r.example_id] for r in answers)
    # Words of rows without a listed label are known words all the same.
    more = predictors.predictor("words", broadcast_bytes=broadcast_bytes).fit(train.union(spark.createDataFrame(odd, schema)), TASK)
    assert more.size == model.size + 6 and more.priors == model.priors


def test_words_with_thousands_of_labels(spark):
    labels = tuple(f"label {i:04d}" for i in range(2000))
    task = TaskSpec("many", labels)
    rows = [(i, f"common word w{i % 2000} x{i % 50}", labels[i % 2000]) for i in range(4000)]
    df = spark.createDataFrame(rows, "example_id long, symptoms string, diagnosis string").repartition(4)
    model = predictors.predictor("words").fit(df, task)
    # A row per word and block of labels it occurs with, not a column per label.
    assert len(model.counts.columns) == 2 + predictors.BLOCK
    assert model.counts.filter("word = 'w'").count() == 32 and model.size == 4
    labelled = df.withColumn("symptoms", F.concat("symptoms", F.lit(" "), F.translate(F.lpad((F.col("example_id") % 2000).cast("string"), 4, "0"), "0123456789", "abcdefghij")))
    model = predictors.predictor("words").fit(labelled, task)
    done = model.predict(labelled.limit(300))
    assert done.filter("predicted = actual").count() == done.count() == 300
    stored = predictors.predictor("words").restore(model.counts, model.artifact()[1], task)
    assert stored.predict(labelled.limit(20)).filter("predicted = actual").count() == 20


def test_words_does_not_depend_on_partitioning(spark):
    df = make_examples(spark, 300)
    first = predicted(predictors.predictor("words").fit(df, TASK), df)
    other = df.repartition(17)
    assert predicted(predictors.predictor("words").fit(other, TASK), other) == first


def test_large_weight_tables_are_not_broadcast_whole(spark):
    df = make_examples(spark, 60)
    # Whatever is broadcast now is broadcast because the code says so.
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = predictors.predictor("words").fit(df, TASK).predict(df)
        assert "SortMergeJoin" not in plan_of(whole) and ") BroadcastHashJoin" in plan_of(whole)
        split = predictors.predictor("words", broadcast_bytes=0).fit(df, TASK).predict(df)
        plan = plan_of(split)
        assert ") SortMergeJoin" in plan
        # What is broadcast is the list of frequent words, or weights that were joined with it.
        for exchange in plan.split(") BroadcastExchange")[1:]:
            assert "Input" in exchange
        assert "octet_length(word" in plan and "LeftAnti" in plan and "LeftSemi" in plan
        assert accuracy(score(whole)).first().accuracy == accuracy(score(split)).first().accuracy == 1.0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_nearest_demo(spark):
    schema = "example_id long, symptoms string, diagnosis string"
    model = predictors.NearestDemoModel(
        spark.createDataFrame(
            [(1, "fever and shivers", "malaria"), (2, "itchy skin", "allergy"), (3, "itchy skin", "migraine")],
            "ord int, symptoms string, diagnosis string",
        )
    )
    rows = spark.createDataFrame(
        [(1, "Skin so itchy", None), (2, "shivers", None), (3, "nothing alike", None), (4, "", None)], schema
    )
    assert predicted(model, rows) == {1: "allergy", 2: "malaria", 3: "malaria", 4: "malaria"}


def test_candidates_see_their_own_demos(spark):
    df = make_examples(spark, 60)
    sets = demos.demo_sets(df, 3, 4)
    assert {r.demo_set_id: r.n for r in sets.groupBy("demo_set_id").agg(F.count("*").alias("n")).collect()} == {
        1: 4, 2: 4, 3: 4,
    }
    together = predictors.nearest_by_candidate(df, sets)
    for c in (1, 2, 3):
        alone = predicted(predictors.NearestDemoModel(sets.filter(F.col("demo_set_id") == c)), df)
        assert {r.example_id: r.predicted for r in together.filter(F.col("candidate_id") == c).collect()} == alone


def test_labeled_demos_are_seeded_and_excluding(spark):
    df = make_examples(spark, 80)
    first = {r.example_id: r.ord for r in demos.labeled_demos(df, 5).collect()}
    assert sorted(first.values()) == [1, 2, 3, 4, 5]
    assert first == {r.example_id: r.ord for r in demos.labeled_demos(df.repartition(9), 5).collect()}
    assert set(first) != {r.example_id for r in demos.labeled_demos(df, 5, seed=7).collect()}
    assert not set(first) & {r.example_id for r in demos.labeled_demos(df, 5, exclude=list(first)).collect()}
    assert demos.labeled_demos(df, 0).count() == 0


@pytest.mark.parametrize("right", [set(range(200)), {3, 50, 111, 160}, {7}, set()])
@pytest.mark.parametrize("first_slice", [2, 64, 10_000])
def test_bootstrap_takes_the_first_right_rows(spark, right, first_slice):
    df = make_examples(spark, 200)
    def teacher(rows):
        ok = F.col("example_id").isin(list(right)) if right else F.lit(False)
        return carried(rows).withColumn("predicted", F.when(ok, F.col("actual")))

    scored = score(teacher(df)).filter("correct = 1")
    want = first_ids_by_hash(scored, 3, "bootstrap:42")
    assert demos.bootstrap_ids(df, teacher, 3, first_slice=first_slice) == want


def test_demo_set_puts_bootstrapped_first(spark):
    df = make_examples(spark, 100)
    got = demos.demo_set(df, predictors.predictor("words").fit(df, TASK).predict).orderBy("ord").collect()
    assert [r.kind for r in got] == ["bootstrapped"] * 3 + ["labeled"] * 4
    assert len({r.example_id for r in got}) == 7
