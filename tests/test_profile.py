import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagwright.operators import profile
from tests.conftest import make_examples, plan_of


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


def described(df, **kw):
    return profile.describe_numeric(df, **kw).first().asDict()


@pytest.mark.parametrize("small", [4, 10_000])
def test_numeric_equals_pandas(spark, monkeypatch, small):
    monkeypatch.setattr(profile, "SMALL", small)
    monkeypatch.setattr(profile.exact_quantiles, "__defaults__", (small,))
    rng = random.Random(3)
    values = [rng.lognormvariate(0, 3) for _ in range(301)] + [5.0] * 40 + [None, float("nan")]
    got = described(frame(spark, values))
    want = pd.Series(values, dtype=float).describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert got[ours] == pytest.approx(want[theirs], rel=1e-12)


@pytest.mark.parametrize("values", [
    [-1.7e308, 1.7e308, 0.0, 1.0, 2.0],
    [float("-inf"), 1.0, 2.0, float("inf"), 3.0, 4.0],
    [10.0 ** -i for i in range(300)],
    [7.0] * 50,
    [1.0],
])
def test_order_statistics_of_awkward_values(spark, values):
    df = frame(spark, values)
    ranks = [("v", r) for r in range(len(values))]
    found = profile._order_statistics(df, {"v": len(values)}, ranks, small=1)
    assert [found[t] for t in ranks] == sorted(values)


def test_several_columns_at_once(spark):
    rows = [(i, float(i * i), None) for i in range(101)]
    df = spark.createDataFrame(rows, "a int, b double, c double")
    quantiles = profile.exact_quantiles(df, {"a": 101, "b": 101, "c": 0}, (0.25, 0.5), small=3)
    assert quantiles == {"a": [25.0, 50.0], "b": [625.0, 2500.0], "c": [None, None]}


def test_no_values_and_no_columns(spark):
    got = described(frame(spark, [None, None]))
    assert got["count"] == 0 and got["q50"] is None
    assert profile.describe_numeric(make_examples(spark, 5).drop("example_id")).count() == 0


def test_approximate_quartiles_are_close(spark):
    got = described(frame(spark, [float(i) for i in range(1001)]), approximate=True)
    assert math.isclose(got["q50"], 500, abs_tol=2)


def test_profile_columns(spark):
    df = spark.createDataFrame(
        [("a", "x", 1), ("a", None, 2), (None, "y", 3), ("b", "y", 4)], "s string, t string, n int"
    )
    want = {"s": (2, 1), "t": (2, 1)}
    for approximate in (False, True):
        got = profile.profile_columns(df, approximate=approximate).collect()
        assert {r.column_name: (r.unique_count, r.null_count) for r in got} == want
    assert profile.numeric_columns(df) == ["n"] and profile.other_columns(df) == ["s", "t"]


def test_categorical(spark):
    rows = [(3, "b"), (1, "a"), (2, "b"), (4, "a"), (5, None), (6, "c")]
    df = spark.createDataFrame(rows, "example_id long, s string")
    got = profile.describe_categorical(df).first()
    # a and b occur twice each; a comes first by id.
    assert (got.column_name, got["count"], got.unique, got.top, got.freq) == ("s", 5, 3, "a", 2)


def test_categorical_without_values(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x")], "example_id long, s string, t string")
    got = {r.column_name: (r["count"], r.unique, r.top, r.freq) for r in profile.describe_categorical(df).collect()}
    assert got == {"s": (0, 0, None, None), "t": (2, 1, "x", 2)}


def test_most_frequent_equals_counting(spark):
    """Hot, level, unique, missing and tied values; the sketch is of use for some columns only."""
    rng = random.Random(7)
    n = 30_000
    rows = [
        (i, "hot" if rng.random() < 0.3 else f"cold {rng.randrange(20_000)}", f"level {i % 7000}", f"one {n - i}",
         None, "b" if i % 2 else "a", 5 if i < 3 else None)
        for i in range(n)
    ]
    columns = ["hot", "level", "one", "missing", "tied", "few"]
    df = spark.createDataFrame(
        rows, "example_id long, hot string, level string, one string, missing string, tied string, few int"
    ).repartition(6)
    got = {r.column_name: (r.top, r.freq) for r in profile.most_frequent(df, columns).collect()}
    for i, c in enumerate(columns, 1):
        counts, first = {}, {}
        for row in rows:
            if row[i] is not None:
                counts[row[i]] = counts.get(row[i], 0) + 1
                first.setdefault(row[i], row[0])
        best = min(counts, key=lambda v: (-counts[v], first[v]), default=None)
        assert got[c] == (None if best is None else str(best), counts.get(best)), c
    roughly = {r.column_name: r for r in profile.describe_categorical(df, columns, approximate=True).collect()}
    for r in profile.describe_categorical(df, columns).collect():
        near = roughly[r.column_name]
        assert (near["count"], near.top, near.freq) == (r["count"], r.top, r.freq)
        assert near.unique == pytest.approx(r.unique, rel=5 * profile.DISTINCT_ERROR)
    empty = profile.most_frequent(df.limit(0), ["hot", "few"]).collect()
    assert {(r.column_name, r.top, r.freq) for r in empty} == {("hot", None, None), ("few", None, None)}


def test_a_hot_value_is_found_without_a_shuffle_of_all_values(spark, monkeypatch):
    """No more cells are counted than the tasks' summaries hold, however many values there are."""
    df = spark.range(0, 60_000, numPartitions=4).select(
        F.col("id").alias("example_id"), F.when(F.col("id") % 10 == 0, "hot").otherwise(F.col("id").cast("string")).alias("s")
    )
    met = []
    value_counts = profile._value_counts

    def counted(df, columns, id_column, wanted=None):
        met.append((wanted is not None, value_counts(df, columns, id_column, wanted).count()))
        return value_counts(df, columns, id_column, wanted)

    monkeypatch.setattr(profile, "_value_counts", counted)
    assert profile.most_frequent(df).first().asDict() == {"column_name": "s", "top": "hot", "freq": 6000}
    assert len(met) == 1 and met[0][0] and met[0][1] <= profile.TRACKED


def test_texts_are_not_shuffled(spark, small_folder):
    documents = spark.read.parquet(f"{small_folder}/documents.parquet").select("doc_id", "text", "lang")
    plan = plan_of(profile._value_counts(documents, ["text", "lang"], "doc_id"))
    exchanges = [s for s in plan.split("\n\n") if ") Exchange" in s and "Input [" in s]
    assert exchanges and all("text#" not in s for s in exchanges)
    assert "PushedFilters: [In(doc_id" in plan_of(profile.describe_categorical(documents, ["text", "lang"], "doc_id"))


def test_summary(spark):
    got = profile.summary(make_examples(spark, 30))
    table = got.table.first()
    assert (table.total_rows, table.total_columns, table.columns) == (30, 3, ["symptoms", "diagnosis", "split"])
    assert got.numeric.count() == 0
    assert {r.column_name: r.unique for r in got.categorical.collect()} == {"symptoms": 30, "diagnosis": 3, "split": 2}
    assert {r.column_name: r.null_count for r in got.other_columns.collect()} == {
        "symptoms": 0, "diagnosis": 0, "split": 0,
    }
    assert np.isfinite(table.total_rows)
