"""One call per distinct prompt, calls in flight, and what both do when calls fail."""

import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tagwright.functions.prompts import Prompt
from tagwright.operators import predict
from tagwright.operators.answers import AnswerStore, predict_distinct, prompt_digest
from tagwright.operators.predict import in_order
from tagwright.operators.predictors import predictor
from tagwright.spec import ModelOptions
from tests.conftest import make_examples, plan_of
from tests.test_predict import TASK, cue_call, fragile_call, stubborn_call

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ["example_id", "predicted", "raw_output", "attempts", "valid", "prompt_tokens", "completion_tokens", "error"]


def counted(spark, inner):
    calls = spark.sparkContext.accumulator(0)

    def build():
        complete = inner()

        def count(system, messages):
            calls.add(len(messages))
            return complete(system, messages)

        return count

    return calls, build


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=repr)


def test_a_third_of_equal_texts_costs_one_call(spark, tmp_path):
    df = make_examples(spark, 300, hot=100).repartition(6)
    calls, build = counted(spark, cue_call)
    store = AnswerStore(spark, f"{tmp_path}/answers")
    done = predict_distinct(df, build, Prompt(TASK), store)
    assert rows_of(done) == rows_of(predict.predict(df, cue_call, Prompt(TASK)))
    assert calls.value == 201 and store.table().count() == 201
    # A later run asks for what is new alone; another prompt or model is another question.
    more = df.union(spark.createDataFrame([(999, "malaria once more", "malaria", "test"), (1000, None, "malaria", "test")], df.schema))
    assert predict_distinct(more, build, Prompt(TASK), store).count() == 302 and calls.value == 203
    predict_distinct(df.limit(1), build, Prompt(TASK, "reasoned"), store)
    predict_distinct(df.limit(1), build, Prompt(TASK), store, model={"model": "other"})
    assert calls.value == 205


def test_hot_texts_are_broadcast_and_others_joined(spark, tmp_path):
    df = make_examples(spark, 300, hot=100)
    done = predict_distinct(df, cue_call, Prompt(TASK), AnswerStore(spark, f"{tmp_path}/answers"), keep_text=True)
    assert "BroadcastHashJoin" in plan_of(done) and done.filter("symptoms = 'same text'").count() == 100


def test_failed_calls_are_made_again(spark, tmp_path):
    df = make_examples(spark, 60)
    store = AnswerStore(spark, f"{tmp_path}/answers")
    first = predict_distinct(df, fragile_call, Prompt(TASK), store)
    assert first.filter("error is not null").count() == 20 and store.table().count() == 40
    calls, build = counted(spark, cue_call)
    again = predict_distinct(df, build, Prompt(TASK), store)
    assert again.filter("valid").count() == 60 and calls.value == 20


def test_retries_and_empty_tables(spark, tmp_path):
    df = make_examples(spark, 30)
    store = AnswerStore(spark, f"{tmp_path}/answers")
    got = predict_distinct(df, stubborn_call, Prompt(TASK), store, max_retries=1)
    assert {(r.attempts, r.predicted) for r in got.collect()} == {(2, "allergy")}
    assert predict_distinct(df.limit(0), cue_call, Prompt(TASK), store).collect() == []
    assert prompt_digest(Prompt(TASK)) != prompt_digest(Prompt(TASK), max_retries=1)


def test_two_runs_at_once_leave_one_answer_each(spark, tmp_path):
    df = make_examples(spark, 40)
    store = AnswerStore(spark, f"{tmp_path}/answers")
    done = []
    runs = [threading.Thread(target=lambda: done.append(rows_of(predict_distinct(df, cue_call, Prompt(TASK), store)))) for _ in range(3)]
    [t.start() for t in runs]
    [t.join() for t in runs]
    assert len(done) == 3 and done[0] == done[1] == done[2] and store.table().count() == 40


def test_candidates_and_the_predictor(spark, tmp_path):
    df = make_examples(spark, 30, hot=10)
    calls, build = counted(spark, cue_call)
    prompts = {1: Prompt(TASK), 2: Prompt(TASK, instructions="Other.")}
    got = predict_distinct(df, build, prompts, AnswerStore(spark, f"{tmp_path}/a"))
    assert got.groupBy("candidate_id").count().orderBy("candidate_id").collect() == [(1, 30), (2, 30)] and calls.value == 42
    chosen = predictor("callable", build=lambda model: build(), model=ModelOptions("local/x"), answers=f"{tmp_path}/b", max_retries=0)
    assert "answers" not in chosen.options()
    model = chosen.fit(df, TASK)
    before = calls.value
    assert model.predict(df).count() == 30 and model.predict(df).count() == 30
    assert calls.value == before + 21


# --- calls in flight ------------------------------------------------------------


def test_in_order_holds_no_more_than_asked_for():
    lock, out, most, taken = threading.Lock(), [0], [0], [0]

    def items():
        for i in range(40):
            taken[0] += 1
            yield i

    def work(i):
        with lock:
            out[0] += 1
            most[0] = max(most[0], out[0])
        time.sleep(0.01 * (i % 3))
        with lock:
            out[0] -= 1
        return i

    got = []
    for i in in_order(work, items(), 4):
        got.append(i)
        assert taken[0] <= len(got) + 4
    assert got == list(range(40)) and most[0] == 4


def test_in_order_raises_in_place_and_stops():
    begun = []

    def work(i):
        begun.append(i)
        if i == 5:
            raise KeyError("five")
        return i

    got = []
    with pytest.raises(KeyError):
        for i in in_order(work, iter(range(1000)), 3):
            got.append(i)
    assert got == [0, 1, 2, 3, 4] and len(begun) <= 9


def slow_call():
    inner = cue_call()

    def complete(system, messages):
        time.sleep(0.2)
        return inner(system, messages)

    return complete


def test_calls_overlap_within_a_task(spark):
    df = make_examples(spark, 64).coalesce(1)
    want = predict.predict(df, cue_call, Prompt(TASK), batch_size=4).select(*COLUMNS).collect()

    def timed(at_once):
        start = time.perf_counter()
        got = predict.predict(df, slow_call, Prompt(TASK), batch_size=4, in_flight=at_once).select(*COLUMNS).collect()
        assert got == want
        return time.perf_counter() - start

    # Sixteen calls of 0.2 s, one after the other and eight at a time.
    assert timed(1) > 3.2 and timed(8) < 2.4


def test_errors_and_retries_in_flight(spark):
    df = make_examples(spark, 60).coalesce(2)
    for at_once in (1, 5):
        done = predict.predict(df, fragile_call, Prompt(TASK), max_retries=1, batch_size=6, in_flight=at_once)
        assert done.filter("error is not null").count() == 20 and done.filter("valid").count() == 40
    with pytest.raises(ValueError, match="must be positive"):
        predict.predict(df, cue_call, Prompt(TASK), in_flight=0)


def test_profile_of_a_stage(spark):
    profile = predict.call_profile(3)
    assert profile.taskResources["cpus"].amount == 3.0
    with pytest.raises(ValueError, match="one core"):
        predict.call_profile(0)
    seen = []

    class Rows:
        schema = make_examples(spark, 1).schema

        def withColumnRenamed(self, *names):
            return self

        def mapInPandas(self, run, schema, profile=None):
            seen.append(profile)

    predict.predict(Rows(), cue_call, Prompt(TASK), profile=profile)
    assert seen == [profile]


def test_token_sums_are_those_of_every_row(spark, tmp_path):
    df = make_examples(spark, 50, hot=20)
    plain = predict.predict(df, stubborn_call, Prompt(TASK)).agg(F.sum("prompt_tokens")).first()[0]
    once = predict_distinct(df, stubborn_call, Prompt(TASK), AnswerStore(spark, f"{tmp_path}/a"))
    assert once.agg(F.sum("prompt_tokens")).first()[0] == plain
