import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tagwright.functions.prompts import Demo, Prompt, feedback_column, numbered
from tagwright.operators import output, predict, report
from tagwright.operators.predict import Reply
from tagwright.spec import SYMPTOM_TASK, ModelOptions, TaskSpec
from tests.conftest import make_examples

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TASK = TaskSpec("t", ("allergy", "malaria", "migraine"), label_noun="diagnosis", input_label="Patient symptoms")
LABELS = TASK.vocabulary


def cue_call():
    """Names the label a message mentions; case and blanks as a model might."""
    def complete(system, messages):
        return [next((f" {l.title()}\n" for l in LABELS if l in m.split("\n\n")[0]), "none") for m in messages]

    return complete


def stubborn_call():
    """Answers outside the vocabulary until it is told so."""
    def complete(system, messages):
        return [Reply("allergy" if "Invalid diagnosis" in m else "9. flu", len(m), 2) for m in messages]

    return complete


def test_prompt_text():
    prompt = Prompt(SYMPTOM_TASK)
    assert "1. allergy\n2. arthritis" in prompt.system and "22. varicose veins" in prompt.system
    assert numbered(["b", "a"]) == "1. a\n2. b"
    assert prompt.user("cough") == "Patient symptoms: cough"
    shown = Prompt(SYMPTOM_TASK, "reasoned", "Be brief.", (Demo("itch", "allergy"),))
    assert shown.system.startswith("Be brief.") and "Example 1\nPatient symptoms: itch\ndiagnosis: allergy" in shown.system
    with pytest.raises(ValueError, match="unknown prompt style"):
        Prompt(SYMPTOM_TASK, "verse")


def test_feedback_is_worded_alike(spark):
    prompt = Prompt(TASK)
    for answer in ("9. flu", "", None):
        column = spark.range(1).select(feedback_column(TASK, F.lit(answer).cast("string"))).first()[0]
        assert column == prompt.feedback(answer)
    assert prompt.feedback("x") == 'Invalid diagnosis "x". Must be one of: allergy, malaria, migraine'


def test_predict_answers_every_row_once(spark):
    df = make_examples(spark, 120)
    calls = spark.sparkContext.accumulator(0)

    def build():
        inner = cue_call()

        def complete(system, messages):
            calls.add(len(messages))
            return inner(system, messages)

        return complete

    kept = predict.predict_once(predict.predict(df, build, Prompt(TASK), parallelism=5, batch_size=7))
    assert kept.count() == 120 and kept.filter("valid").count() == 120
    assert kept.filter("lower(predicted) = actual").count() == 120
    assert calls.value == 120
    assert "symptoms" not in kept.columns and {"example_id", "split", "actual"} <= set(kept.columns)


def test_retry_with_feedback(spark):
    df = make_examples(spark, 40)
    once = predict.predict(df, stubborn_call, Prompt(TASK), max_retries=0)
    assert once.filter("valid").count() == 0 and once.agg(F.max("attempts")).first()[0] == 1
    assert predict.retry_rows(once, TASK).count() == 40
    again = predict.predict(df, stubborn_call, Prompt(TASK), max_retries=2).collect()
    assert {(r.attempts, r.valid, r.predicted, r.completion_tokens) for r in again} == {(2, True, "allergy", 4)}


def test_rows_never_right_stay_invalid(spark):
    def build():
        return lambda system, messages: [None] * len(messages)

    got = predict.predict(make_examples(spark, 5), build, Prompt(TASK), max_retries=2).collect()
    assert {(r.attempts, r.valid, r.predicted, r.prompt_tokens) for r in got} == {(3, False, None, None)}


def test_structured_and_reasoned_answers(spark):
    def build():
        return lambda system, messages: ['{"reasoning": "because", "diagnosis": " Malaria "}'] * len(messages)

    for style, reasoning in (("structured", "because"), ("reasoned", "because"), ("answer_only", None)):
        row = predict.predict(make_examples(spark, 1), build, Prompt(TASK, style)).first()
        assert row.reasoning == reasoning
        assert row.valid == (style != "answer_only")


def test_wrong_number_of_replies_fails(spark):
    def build():
        return lambda system, messages: []

    with pytest.raises(Exception, match="asked for 3 replies, got 0"):
        predict.predict(make_examples(spark, 3).coalesce(1), build, Prompt(TASK)).collect()


def test_several_prompts_share_one_pass(spark):
    prompts = {1: Prompt(TASK), 7: Prompt(TASK, instructions="Other.")}
    got = predict.predict(make_examples(spark, 30), cue_call, prompts)
    assert {(r.candidate_id, r.n) for r in got.groupBy("candidate_id").agg(F.count("*").alias("n")).collect()} == {
        (1, 30), (7, 30),
    }


def test_token_usage(spark):
    df = make_examples(spark, 10)
    counted = predict.predict(df, stubborn_call, Prompt(TASK)).withColumn("run_id", F.lit("r"))
    used = {r.split: r.completion_tokens for r in output.token_usage(counted).collect()}
    assert used == {"train": 16, "test": 4}
    silent = predict.predict(df, cue_call, Prompt(TASK)).withColumn("run_id", F.lit("r"))
    assert {r.prompt_tokens for r in output.token_usage(silent).collect()} == {None}


def test_label_vocabulary(spark):
    df = make_examples(spark, 30)
    got = report.label_vocabulary(df).orderBy("ord").collect()
    assert [r.line for r in got] == ["1. allergy", "2. malaria", "3. migraine"]
    with pytest.raises(Exception, match="more than 2 labels"):
        report.label_vocabulary(df, limit=2).collect()


def test_render_prompt(spark):
    prompts = [Prompt(TASK, s) for s in ("answer_only", "reasoned")]
    got = report.render_prompt(make_examples(spark, 4), prompts).collect()
    assert len(got) == 8
    assert {r.system_prompt for r in got if r.style == "reasoned"} == {prompts[1].system}
    assert all(r.user_prompt.startswith("Patient symptoms: case") for r in got)


def test_model_options_reach_the_call(spark):
    from tagwright.operators.predictors import predictor

    def build(model):
        return lambda system, messages: [model.model.split("/")[1]] * len(messages)

    chosen = predictor("callable", build=build, model=ModelOptions("local/malaria"))
    assert chosen.fit(make_examples(spark, 5), TASK).predict(make_examples(spark, 5)).first().predicted == "malaria"


def fragile_call():
    """Fails for a batch in which any message speaks of malaria."""
    inner = cue_call()

    def complete(system, messages):
        if any("malaria" in m.split("\n\n")[0] for m in messages):
            raise ConnectionError("down")
        return inner(system, messages)

    return complete


def test_a_failing_call_costs_its_own_rows_alone(spark):
    df = make_examples(spark, 60)
    done = predict.predict_once(predict.predict(df, fragile_call, Prompt(TASK), max_retries=1))
    bad = done.filter("error is not null").collect()
    assert len(bad) == 20 and {(r.actual, r.error, r.valid, r.attempts, r.predicted) for r in bad} == {
        ("malaria", "ConnectionError: down", False, 2, None)
    }
    assert done.filter("valid").count() == 40
    asked = spark.sparkContext.accumulator(0)

    def build():
        inner = cue_call()

        def complete(system, messages):
            asked.add(len(messages))
            return inner(system, messages)

        return complete

    whole = predict.predict_once(
        predict.predict_missing(df, done.filter("example_id <> 0"), lambda rows: predict.predict(rows, build, Prompt(TASK)))
    )
    assert whole.count() == 60 and whole.filter("valid").count() == 60 and asked.value == 21


def test_odd_reasoning_is_kept_as_text(spark):
    def build():
        return lambda system, messages: ['{"reasoning": ["a", 1], "diagnosis": "malaria"}'] * len(messages)

    row = predict.predict(make_examples(spark, 1), build, Prompt(TASK, "reasoned")).first()
    assert (row.reasoning, row.predicted) == ('["a", 1]', "malaria")


def test_validator_decides_on_retries(spark):
    got = predict.predict(
        make_examples(spark, 10), stubborn_call, Prompt(TASK), max_retries=1, validator=lambda label: label.startswith("9")
    ).collect()
    assert {(r.attempts, r.valid, r.predicted) for r in got} == {(1, True, "9. flu")}
