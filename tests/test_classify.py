import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tagwright.operators.predictors import predictor
from tagwright.plans.classify import evaluate, evaluate_best, tune
from tagwright.session import new_folder
from tagwright.sources import tracking
from tagwright.sources.examples import Dataset
from tagwright.spec import ModelOptions, TaskSpec
from tests.conftest import make_examples

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TASK = TaskSpec("t", ("allergy", "malaria", "migraine"), label_noun="diagnosis")


@pytest.fixture
def store(spark):
    return tracking.RunStore(spark, new_folder(spark, "store"))


@pytest.fixture(scope="module")
def data(spark):
    return Dataset(make_examples(spark, 200), TASK, source="made")


def params(store, run_id):
    return {r.key: r.value for r in store.table("run_params").filter(F.col("run_id") == run_id).collect()}


def test_tune_and_evaluate(spark, store, data):
    result = tune(data, predictor("words"), store, model_name="m", project="p", experiment="e", aliases=["live"])
    assert result.train_accuracy == result.validation_accuracy == 1.0 and result.version == 1
    assert result.num_train_examples + result.num_val_examples == 160
    logged = params(store, result.run_id)
    assert logged["framework"] == "words" and logged["train_size"] == str(result.num_train_examples)
    assert logged["dataset_train_source"] == "made"
    run = store.table("runs").first()
    assert run.experiment == "/tagwright/p/e" and run.tags["project"] == "p" and run.tags["trainable"] == "true"
    kept = {(r.split, r.metric): r.value for r in store.latest_metrics().collect()}
    assert kept[("train", "accuracy")] == 1.0 and kept[("validation", "disagreements")] == 0.0

    folder = f"{store.root}/artifacts/{result.run_id}"
    sample = spark.read.parquet(f"{folder}/predictions_sample/parquet")
    assert sample.groupBy("split").count().filter("count = 10").count() == 2
    csv = spark.read.options(header=True, multiLine=True, escape='"').csv(f"{folder}/predictions_sample/csv")
    assert csv.count() == 20 and "symptoms" in csv.columns
    text = "\n".join(r.value for r in spark.read.text(f"{folder}/prompt_details", wholetext=True).collect())
    assert "OPTIMIZED PROMPT DETAILS" in text and "ACTUAL PROMPT EXAMPLE" in text

    second = tune(data, predictor("majority"), store, model_name="m")
    assert second.version == 2
    latest = evaluate(data, store, "m")
    assert latest.num_examples == 40 and latest.accuracy < 1.0
    assert evaluate(data, store, "m", "live").accuracy == 1.0
    assert evaluate(data, store, "m", 1, "validation").accuracy == 1.0
    assert evaluate(data, store, "m", 1, "train_full").num_examples == 160
    best = evaluate_best(data, store, ["m", "m"], eval_size=10)
    assert best.num_examples == 10 and best.split == "test" and best.model_name == "m"
    assert evaluate_best(data, store, ["m"]).num_examples == 40
    capped = evaluate(data, store, "m", "1", "train", eval_size=5, run_id="r5")
    assert (capped.num_examples, capped.run_id) == (5, "r5")
    assert params(store, "r5")["eval_size"] == "5"
    with pytest.raises(ValueError, match="no version '9'"):
        evaluate(data, store, "m", 9)
    with pytest.raises(ValueError, match="cannot be evaluated; there are train"):
        evaluate(data, store, "m", split="dev")


def test_invalid_rows_stop_the_job(spark, store, data):
    bad = spark.createDataFrame([(1000, "   ", "malaria", "train")], data.examples.schema)
    broken = Dataset(data.examples.union(bad), TASK)
    with pytest.raises(Exception, match="row 1000: empty_text"):
        tune(broken, predictor("majority"), store)
    odd = spark.createDataFrame([(1001, "text", "scurvy", "test")], data.examples.schema)
    tune(data, predictor("majority"), store, model_name="ok")
    with pytest.raises(Exception, match="row 1001: label_not_in_vocabulary"):
        evaluate(Dataset(data.examples.union(odd), TASK), store, "ok")


def test_missing_and_repeated_ids_stop_the_job(spark, store, data):
    for extra in ([(None, "text", "malaria", "train")], [(0, "text", "malaria", "train")]):
        schema = "example_id long, symptoms string, diagnosis string, split string"
        broken = Dataset(data.examples.union(spark.createDataFrame(extra, schema)), TASK)
        with pytest.raises(ValueError, match="null_ids=1" if extra[0][0] is None else "repeated_ids=1"):
            tune(broken, predictor("majority"), store)
    assert store.table("runs").isEmpty()


def test_aliases_are_checked(store, data):
    tune(data, predictor("majority"), store, model_name="named")
    for alias, version in (("latest", 1), ("7", 1), ("", 1), ("live", 99)):
        with pytest.raises(ValueError):
            store.set_alias("named", alias, version)
    store.set_alias("named", "live", 1)
    assert store.resolve("named", "live")["version"] == 1


def test_comparisons_take_the_latest_value(store):
    from tagwright.operators import compare

    for run, framework in (("a", "words"), ("b", "majority")):
        store.start_run("p", "e", framework, True, run_id=run)
    store.log_metrics("a", [("validation", "accuracy", 0.9)])
    store.log_metrics("b", [("validation", "accuracy", 0.6)])
    store.log_metrics("a", [("validation", "accuracy", 0.5)])
    log = store.table("run_metrics")
    got = {r.run_id: (r.validation_accuracy, r.framework) for r in compare.compare_runs(log, runs=store.table("runs")).collect()}
    assert got == {"a": (0.5, "words"), "b": (0.6, "majority")}
    assert compare.metric_diff(log, "a", "b").first().difference == pytest.approx(0.1)
    assert compare.winner(log, "a", "b").first().winner == "b"
    assert tuple(compare.best_run(log).first()) == ("b", 0.6)
    store.log_metrics("a", [("validation", "accuracy", 0.6)])
    tied = store.table("run_metrics")
    assert compare.best_run(tied).first().run_id == "a" and compare.best_run(tied, order=["b", "a"]).first().run_id == "b"


def test_tokens_and_errors_are_recorded(spark, store, data):
    from tagwright.operators.predict import Reply

    def counting(model):
        def complete(system, messages):
            if any("case 7 " in m for m in messages):
                raise ConnectionError("down")
            return [Reply("malaria", 10, 1) for m in messages]

        return complete

    result = tune(data, predictor("callable", build=counting, max_retries=0), store)
    kept = {(r.split, r.metric): r.value for r in store.latest_metrics().collect()}
    failed = result.scored.filter("error is not null").first()
    sizes = {"train": result.num_train_examples, "validation": result.num_val_examples}
    for split, n in sizes.items():
        errors = 1.0 if failed.split == split else 0.0
        assert kept[split, "errors"] == errors and kept[split, "prompt_tokens"] == 10 * (n - errors)
    assert result.scored.filter("error is not null and correct = 1").count() == 0


def test_search_asks_each_candidate_about_each_row_once(spark, data):
    from tagwright.operators import search
    from tagwright.operators.score import score  # noqa: F401

    asked = spark.sparkContext.accumulator(0)

    def run(rows, candidates):
        def count(batches):
            for batch in batches:
                asked.add(len(batch) * len(candidates))
                for c in candidates:
                    yield batch.assign(candidate_id=c, actual=batch["diagnosis"], predicted="malaria")[
                        ["example_id", "candidate_id", "actual", "predicted"]
                    ]

        return rows.mapInPandas(count, "example_id long, candidate_id int, actual string, predicted string")

    plan = search.Budget(candidates=3, pool_rows=40, minibatch=5, full_every=2)
    trials = search.search(data.population("train"), [1, 2, 3], run, plan)
    trials.collect(), trials.count()
    chosen = search.write_once(search.sample_n(data.population("train"), 40, "pool:42"), "pool")
    rounds = [search.minibatch_sample(chosen, 5, r) for r in (1, 2, 3)]
    tried = len({r.example_id for part in rounds for r in part.collect()})
    leaders = len(trials.filter("full_accuracy is not null").collect())
    assert asked.value == 3 * tried + leaders * (40 - tried)
    assert {r.full_examples for r in trials.collect()} - {None} == {40}


def test_wrong_rows_are_kept_with_their_text(spark, store, data):
    texts = {r.example_id: r.symptoms for r in data.examples.collect()}
    schema = "example_id long, actual string, predicted string, symptoms string, split string"
    for chosen in (
        predictor("majority"), predictor("nearest_demo"), predictor("words"), predictor("callable", build=build)
    ):
        result = tune(data, chosen, store)
        folder = f"{store.root}/artifacts/{result.run_id}/disagreements/parquet"
        kept = {r.example_id: r.symptoms for r in spark.read.schema(schema).parquet(folder).collect()}
        wrong = {r.example_id for r in result.scored.filter("correct = 0").collect()}
        assert kept == {i: texts[i] for i in wrong}
        if "symptoms" in result.scored.columns:
            assert result.scored.filter("correct = 1 and symptoms is not null").count() == 0


def test_caps(store, data):
    result = tune(data, predictor("nearest_demo"), store, train_size=5, val_size=3)
    assert (result.num_train_examples, result.num_val_examples) == (5, 3)
    with pytest.raises(ValueError):
        tune(data, predictor("majority"), store, train_size=0)


def build(model):
    def complete(system, messages):
        found = []
        for m in messages:
            entry = m.split("\n\n")[0]
            label = next((l for l in TASK.vocabulary if l in entry), "none")
            # Without instructions that ask for care it only knows one label.
            found.append(label if "careful" in system else "malaria")
        return found

    return complete


def test_bootstrap_shows_right_rows(spark, store, data):
    chosen = predictor("callable", build=build, optimizer="bootstrap", model=ModelOptions("local/echo", 0.5, 10))
    result = tune(data, chosen, store, model_name="boot")
    logged = params(store, result.run_id)
    assert logged["lm_model"] == "local/echo" and logged["lm_temperature"] == "0.5"
    entry = store.resolve("boot")
    shown = entry["config"]["description"]["demos"]
    # The model is only right on malaria, so those come first.
    assert [d["diagnosis"] for d in shown[:3]] == ["malaria"] * 3 and len(shown) == 7
    assert evaluate(data, store, "boot", build=build).accuracy == pytest.approx(
        data.population("test").filter("diagnosis = 'malaria'").count() / 40
    )


def test_search_picks_the_better_instructions(store, data):
    chosen = predictor(
        "callable", build=build, optimizer="search", candidate_instructions=["Be careful."], minibatch=10
    )
    result = tune(data, chosen, store, model_name="found")
    assert result.validation_accuracy == 1.0
    assert store.resolve("found")["config"]["description"]["instructions"] == "Be careful."
    trials = store.spark.read.parquet(f"{store.root}/artifacts/{result.run_id}/trials")
    assert trials.count() == 6
    assert evaluate(data, store, "found", build=build).accuracy == 1.0
    alone = predictor(
        "callable", build=build, optimizer="search", auto=None, num_candidates=1, pool_rows=20, max_labeled=0
    )
    assert tune(data, alone, store, model_name="alone", val_size=20).num_val_examples == 20
    with pytest.raises(ValueError, match="needs 'build'"):
        evaluate(data, store, "found")


def test_versions_and_aliases(spark):
    schema = "name string, version long, run_id string"
    versions = spark.createDataFrame([("m", 1, "a"), ("m", 2, "b")], schema)
    assert tuple(tracking.latest_model_version(versions).first()) == ("m", 2, "b")
    names = spark.createDataFrame([("m",), ("new",), ("m",)], "name string")
    assert {tuple(r) for r in tracking.next_model_version(names, versions).collect()} == {("m", 3), ("new", 1)}
    aliases = spark.createDataFrame(
        [("m", "test", 1, 1), ("m", "test", 2, 2)], "name string, alias string, version long, updated_at long"
    )
    assert tuple(tracking.alias_resolve(aliases).first()) == ("m", "test", 2)


def test_resumed_runs_keep_the_latest_value(store):
    run = store.start_run("p", "e", "words", True, run_id="again")
    store.log_metrics(run, [("test", "accuracy", 0.5)])
    assert store.start_run("p", "e", "words", True, run_id="again") == "again"
    store.log_metrics(run, [("test", "accuracy", 0.75)])
    assert store.table("runs").count() == 1 and store.table("run_metrics").count() == 2
    assert [r.value for r in store.latest_metrics().collect()] == [0.75]
    assert tracking.runs_by_tag(store.table("runs"), project="p", trainable="true").count() == 1
    assert tracking.runs_by_tag(store.table("runs"), project="q").count() == 0


def test_params_long(spark):
    runs = spark.createDataFrame([("r", 1, True)], "run_id string, n int, flag boolean")
    assert {tuple(r) for r in tracking.params_long(runs, ["n", "flag"]).collect()} == {
        ("r", "n", "1"), ("r", "flag", "true"),
    }


def test_writers_at_once_get_numbers_of_their_own(spark, store):
    """Several sessions register under one name; numbers are distinct and without gaps."""
    import threading

    found, failed = [], []

    def writer(i):
        try:
            mine = tracking.RunStore(spark.newSession(), store.root)
            for j in range(3):
                found.append(mine.register("shared", f"run-{i}-{j}", {}, {"a": 1.0}))
                mine.log_metrics(f"run-{i}-{j}", [("test", "accuracy", 0.5)])
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=writer, args=(i,)) for i in range(4)]
    [t.start() for t in writers]
    [t.join() for t in writers]
    assert not failed and sorted(found) == list(range(1, 13))
    rows = store.table("model_versions").collect()
    assert sorted(r.version for r in rows) == list(range(1, 13)) and len({r.run_id for r in rows}) == 12
    assert store.table("run_metrics").count() == 12 and store.register("other", "r", {}, {}) == 1


def test_a_claimed_number_is_passed_over(store):
    assert store._claimed("m", 1) == 1 and store._claimed("m", 1) == 2
    assert store.register("m", "r", {}, {}) == 3 and store.resolve("m")["version"] == 3


def test_compacting_keeps_every_row(spark, store):
    assert store.compact("run_metrics") == 0
    for i in range(5):
        store.log_metrics("r", [("test", "accuracy", i / 10)])
    before = sorted(store.table("run_metrics").collect())
    assert store.compact("run_metrics") == 5 and store.compact("run_metrics") == 1
    assert sorted(store.table("run_metrics").collect()) == before
    store.log_metrics("r", [("test", "accuracy", 0.9)])
    assert store.table("run_metrics").count() == 6 and store.latest_metrics().first().value == 0.9


def _jobs(spark, work):
    """How many Spark jobs some work takes."""
    import uuid

    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_the_source_is_read_once_and_jobs_are_few(spark, store):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = make_examples(spark, 200)
    data = Dataset(rows.mapInPandas(counted, rows.schema), TASK, source="counted")
    jobs = _jobs(spark, lambda: tune(data, predictor("words"), store, model_name="m"))
    assert read.value == 200 and jobs <= 32
    jobs = _jobs(spark, lambda: evaluate(data, store, "m"))
    assert read.value == 400 and jobs <= 21
