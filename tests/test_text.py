import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagwright.functions import text
from tagwright.functions.metrics import bounded
from tagwright.operators.output import parse_output
from tagwright.operators.predict import read_answer


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",))), min_size=1, max_size=30))
def test_strip_is_python_strip(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", text.strip(F.col("t")).alias("s"), text.is_blank(F.col("t")).alias("b")).collect()
    assert {r.i: (r.s, r.b) for r in got} == {i: (t.strip(), not t.strip()) for i, t in enumerate(texts)}


def test_every_unicode_blank_is_stripped(spark):
    blanks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    assert "".join(blanks) == text.WHITESPACE
    inner = "a\u00a0b"
    padded = "".join(blanks) + inner + "".join(blanks)
    assert spark.range(1).select(text.strip(F.lit(padded))).first()[0] == inner
    df = spark.createDataFrame([(c,) for c in blanks], "t string")
    assert df.filter(text.is_blank(F.col("t"))).count() == len(blanks)


def test_normalize_label(spark):
    got = spark.range(1).select(
        text.normalize_label(F.lit(" Common Cold\n")), text.normalize_label(F.lit(None))
    ).first()
    assert tuple(got) == ("common cold", None)


def test_content_key_tells_apart_nulls_and_boundaries(spark):
    rows = [(None, ""), ("", None), ("a", "bc"), ("ab", "c"), ("a1:b", "c"), ("a", "1:bc")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(text.content_key(F.col("a"), F.col("b")).alias("k")).distinct().count() == len(rows)


def test_provider_prefix(spark):
    df = spark.createDataFrame([("local/small:8b",), ("plain",), ("a/b/c",)], "m string")
    got = df.select(text.provider(F.col("m")), text.strip_provider(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [("local", "small:8b"), (None, "plain"), ("a", "b/c")]


def test_experiment_name(spark):
    got = spark.range(1).select(text.experiment_name(F.lit("s"), F.lit("p"), F.lit("e"))).first()[0]
    assert got == "/s/p/e"


def test_answers_are_read_alike_in_tasks_and_in_columns(spark):
    raws = [" Flu \u3000", '{"diagnosis": " flu ", "reasoning": "why"}', "not json", '{"other": 1}', '"text"', "", None]
    for style in ("answer_only", "structured", "reasoned"):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw_output string")
        parsed = {r.i: r for r in parse_output(df, style).collect()}
        for i, raw in enumerate(raws):
            label, reasoning = read_answer(raw, style)
            assert parsed[i].predicted == label
            if style == "reasoned":
                assert parsed[i].reasoning == reasoning


def test_bounded_fails_outside(spark):
    import pytest

    df = spark.createDataFrame([(1.5,)], "v double")
    assert df.select(bounded(F.col("v"), "v", 0, 2)).first()[0] == 1.5
    with pytest.raises(Exception, match="v out of bounds"):
        df.select(bounded(F.col("v"), "v", 0, 1)).collect()


def test_config_json_round_trip(spark):
    from tagwright.sources.tracking import config_json

    df = spark.createDataFrame([("r", 3, 0.5)], "run_id string, n int, t double")
    assert json.loads(df.select(config_json(["run_id", "n", "t"])).first()[0]) == {"run_id": "r", "n": 3, "t": 0.5}
