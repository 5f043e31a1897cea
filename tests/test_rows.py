import hashlib
import math
import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tagwright.operators import rows
from tests.conftest import make_examples, plan_of


def strings(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


@pytest.mark.parametrize("small", [1, 5, 10_000])
def test_kth_smallest_equals_sorting(spark, small):
    values = [hashlib.md5(str(i).encode()).hexdigest() for i in range(500)]
    df = strings(spark, values)
    for k in (1, 2, 250, 499, 500):
        assert rows.kth_smallest(df, k, width=2, small=small) == sorted(values)[k - 1]
    assert rows.kth_smallest(df, 501, small=small) is None
    assert rows.kth_smallest(df, 0) is None


def test_kth_smallest_with_keys_of_many_lengths_and_alphabets(spark):
    rng = random.Random(1)
    values = list({"".join(rng.choice("aé漢😀") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    df = strings(spark, values)
    ordered = sorted(values)
    for k in range(1, len(values) + 1, 37):
        assert rows.kth_smallest(df, k, width=1, small=2) == ordered[k - 1]


@pytest.mark.parametrize(
    ("kind", "make"),
    [
        ("bigint", lambda i: i - 40),
        ("double", lambda i: i / 4 - 7.5),
        ("decimal(10,2)", lambda i: Decimal(i) / 4),
        ("date", lambda i: date(2020, 1, 1) + timedelta(days=i)),
        ("string", lambda i: "shared prefix of many characters " + f"{i * 7919 % 1000:04d}é"),
    ],
)
def test_caps_on_both_sides_of_the_switch(spark, monkeypatch, kind, make):
    """The plan may differ with the size of the cap; the rows may not.  Rows without an id are never among the first."""
    ids = [make(i) for i in range(150)]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)] * 5, f"example_id {kind}").repartition(4)
    for n in (1, 7, 60, 150, 151):
        expected = sorted(ids)[:n]
        for small in (1000, 5):
            monkeypatch.setattr(rows, "SMALL", small)
            assert sorted(r.example_id for r in rows.first_n(df, n).collect()) == expected
    sampled = []
    for small in (1000, 5):
        monkeypatch.setattr(rows, "SMALL", small)
        sampled.append(sorted(r.example_id for r in rows.sample_n(df, 40, "s").collect()))
    assert sampled[0] == sampled[1] and len(sampled[0]) == 40
    monkeypatch.setattr(rows, "SMALL", 1000)
    assert None not in rows.first_ids_by_hash(df, 12, "s")


def test_first_n(spark):
    df = make_examples(spark, 100).repartition(7)
    assert sorted(r.example_id for r in rows.first_n(df, 3).collect()) == [0, 1, 2]
    assert rows.first_n(df, 1000).count() == 100
    assert rows.first_n(df, None) is df
    with pytest.raises(ValueError):
        rows.first_n(df, 0)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_large_caps_take_the_same_rows(spark, monkeypatch, kind):
    df = make_examples(spark, 300).withColumn("example_id", F.col("example_id").cast(kind))
    expected = sorted(r.example_id for r in rows.first_n(df, 120).collect())
    monkeypatch.setattr(rows, "SMALL", 10)
    assert sorted(r.example_id for r in rows.first_n(df, 120).collect()) == expected
    sampled = sorted(r.example_id for r in rows.sample_n(df, 120, "s").collect())
    monkeypatch.undo()
    assert sorted(r.example_id for r in rows.sample_n(df, 120, "s").collect()) == sampled
    assert len(sampled) == 120


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_nth_smallest_without_sorting_keys(spark, monkeypatch, kind):
    """Half of the rows share one key; others are skewed, negative and repeated."""
    rng = random.Random(5)
    values = [int(rng.lognormvariate(0, 4)) - 50 for _ in range(3000)] + [17] * 3000
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 9, "key long").select(F.col("key").cast(kind))
    ordered = sorted(str(v) for v in values) if kind == "string" else sorted(values)

    def refuse(*args):
        raise AssertionError("the keys are sorted")

    monkeypatch.setattr(type(df), "orderBy", refuse)
    for n in (101, 3500, 5000, 6000):
        assert rows.nth_smallest(df, n, small=100) == ordered[n - 1]
    assert rows.nth_smallest(df, 6001, small=100) is None


def test_a_sample_that_misses_costs_a_round_only(spark, monkeypatch):
    """Splitters far from the place, or none at all."""
    df = spark.range(5000).select(F.col("id").alias("key"))
    drawn = iter([[], [4990, 4995], [1], [], [2000, 2040]])
    monkeypatch.setattr(rows, "_splitters", lambda *args: next(drawn))
    assert rows.nth_smallest(df, 2021, small=50) == 2020
    drawn = iter([[10, 2020, 4000]])
    assert rows.nth_smallest(df, 2021, small=50) == 2020


def test_nan_is_the_largest_key(spark):
    df = spark.createDataFrame([(float(i),) for i in range(200)] + [(float("nan"),)] * 200, "key double")
    assert math.isnan(rows.nth_smallest(df, 300, small=20))
    assert rows.nth_smallest(df, 200, small=20) == 199.0


def test_cap_reaches_the_scan(spark, small_folder):
    documents = spark.read.parquet(f"{small_folder}/documents.parquet")
    plan = plan_of(rows.first_n(documents, 5, "doc_id"))
    assert "LessThanOrEqual(doc_id" in plan


def test_list_rows(spark):
    got = rows.list_rows(make_examples(spark, 50), 4).orderBy("example_id").collect()
    assert [r.example_id for r in got] == [0, 1, 2, 3]
    assert {r.total_rows for r in got} == {50}


def test_fetch_keeps_the_given_order(spark):
    got = rows.fetch(make_examples(spark, 20), [7, 3, 11]).collect()
    assert {r.example_id: r.ord for r in got} == {7: 1, 3: 2, 11: 3}
    assert rows.fetch(make_examples(spark, 20), []).count() == 0


@pytest.mark.parametrize("chunk", [3, 1000])
def test_assign_ids_to_copies(spark, chunk):
    texts = [("a", "x")] * 10 + [("a", "y"), (None, "x"), ("", "x")] + [("b", "z")] * 4
    df = spark.createDataFrame(texts, "symptoms string, diagnosis string")
    got = rows.assign_ids(df, chunk=chunk)
    assert got.select("example_id").distinct().count() == len(texts)
    assert sorted((r.symptoms or "~", r.diagnosis) for r in got.collect()) == sorted((t or "~", d) for t, d in texts)
    again = {r.example_id for r in rows.assign_ids(df.repartition(5), chunk=7).collect()}
    assert again == {r.example_id for r in got.collect()}


def test_a_hot_row_is_numbered_by_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("same").alias("symptoms"), F.lit("x").alias("diagnosis"))
    got = rows.assign_ids(df, chunk=100).withColumn("task", F.spark_partition_id())
    share = [r.n for r in got.groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert sum(share) == 20_000 and len(share) > 4 and max(share) < 10_000
