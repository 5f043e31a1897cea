import pytest

from tagwright.operators import validate
from tagwright.sources.examples import to_examples
from tagwright.spec import DIAGNOSES, SYMPTOM_TASK, ModelOptions, TaskSpec
from tests.conftest import make_examples


def test_report(validation_fixture):
    got = validate.validation_report(validation_fixture, SYMPTOM_TASK, check_ids=True).first().asDict()
    assert got == {
        "total": 6, "null_text": 1, "empty_text": 1, "null_label": 1, "label_not_in_vocabulary": 1,
        "valid": 2, "rejected": 4, "repeated_ids": 0,
    }


def test_report_of_nothing(validation_fixture):
    got = validate.validation_report(validation_fixture.limit(0), SYMPTOM_TASK, check_ids=True).first()
    assert got.total == 0 and got.valid == 0 and got.repeated_ids == 0


def test_partition_valid(validation_fixture):
    valid, rejected = validate.partition_valid(validation_fixture, SYMPTOM_TASK)
    assert {r.example_id for r in valid.collect()} == {1, 2}
    assert {r.example_id: r.problem for r in rejected.collect()} == {
        3: "label_not_in_vocabulary", 4: "empty_text", 5: "null_text", 6: "null_label",
    }
    assert validate.validation_report(valid, SYMPTOM_TASK).first().rejected == 0


def test_require_valid(validation_fixture):
    with pytest.raises(ValueError, match="null_text=1"):
        validate.require_valid(validation_fixture, SYMPTOM_TASK)
    valid, _ = validate.partition_valid(validation_fixture, SYMPTOM_TASK)
    assert to_examples(validate.require_valid(valid, SYMPTOM_TASK)).orderBy("example_id").first().symptoms == (
        "I have a headache"
    )
    with pytest.raises(ValueError, match="repeated_ids=2"):
        validate.require_valid(valid.union(valid), SYMPTOM_TASK, check_ids=True)


def test_vocabulary():
    assert len(DIAGNOSES) == 22 and SYMPTOM_TASK.ordered == tuple(sorted(DIAGNOSES))
    for bad in ((), ("a", "A "), ("a", " ")):
        with pytest.raises(ValueError):
            TaskSpec("t", bad)


def test_invalid_labels(validation_fixture):
    got = validate.invalid_labels(validation_fixture, SYMPTOM_TASK).collect()
    assert [(r.example_id, r.diagnosis) for r in got] == [(3, "invalid_diagnosis")]


def test_coverage_both_ways(spark):
    df = make_examples(spark, 30)
    same = TaskSpec("t", ("allergy", "malaria", "migraine"))
    assert validate.vocab_coverage(df, same).count() == 0
    other = TaskSpec("t", ("allergy", "malaria", "dengue"))
    got = {r.label: r.problem for r in validate.vocab_coverage(df, other).collect()}
    assert got == {"migraine": "missing_from_vocabulary", "dengue": "missing_from_data"}


def test_conservation(spark):
    df = make_examples(spark, 50)
    assert validate.row_conservation(df).first().conserved
    odd = df.union(spark.createDataFrame([(99, "x", "allergy", "extra")], df.schema))
    assert not validate.row_conservation(odd).first().conserved


def test_flag_invalid_output(scoring_fixture):
    got = {r.example_id: r for r in validate.flag_invalid_output(scoring_fixture, SYMPTOM_TASK).collect()}
    assert [i for i, r in sorted(got.items()) if r.valid] == [1, 2, 3]
    assert got[4].feedback.startswith('Invalid diagnosis "1. migraine". Must be one of: allergy, arthritis')
    assert got[5].feedback.startswith('Invalid diagnosis "". Must')
    assert got[1].feedback is None


def test_own_validator(spark, scoring_fixture):
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("boolean")
    def short(answer: pd.Series) -> pd.Series:
        return answer.str.len() < 9

    got = validate.flag_invalid_output(scoring_fixture, SYMPTOM_TASK, validator=short).collect()
    assert {r.example_id for r in got if r.valid} == {2, 3}


def test_model_options():
    assert ModelOptions("a/b").temperature == 0.0
    for bad in ({"temperature": 2.5}, {"temperature": -0.1}, {"max_tokens": 0}):
        with pytest.raises(ValueError):
            ModelOptions("a/b", **bad)


def test_counts_are_taken_by_the_job_that_writes(spark, validation_fixture):
    watched, seen = validate.observed(validation_fixture, SYMPTOM_TASK)
    watched.write.format("noop").mode("overwrite").save()
    report = validate.validation_report(validation_fixture, SYMPTOM_TASK).first().asDict()
    assert validate.observed_counts(seen) == report
    with pytest.raises(ValueError, match="6 rows checked: null_text=1.*row 3: label_not_in_vocabulary"):
        validate.write_valid(validation_fixture, SYMPTOM_TASK)
    written, counts = validate.write_valid(validation_fixture.filter("example_id < 3"), SYMPTOM_TASK)
    assert counts["valid"] == counts["total"] == 2 and written.count() == 2
    none, counts = validate.write_valid(validation_fixture.limit(0), SYMPTOM_TASK)
    assert none.count() == counts["total"] == 0
