"""Histogram sort: laws of the assignment, whatever the ties."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from tagwright.llm import sharding


def check(spark, rows, shards, ratio):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.assigned(docs, shards).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert Counter((i, size(t), crc(t)) for i, t in rows) == Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(shards))
    for held in slots.values():
        assert sorted(held) == list(range(len(held)))
    largest = max(r.size for r in got)
    mean = sum(sizes.values()) / shards
    for s in range(shards):
        assert abs(sizes[s] - mean) <= 2 * ratio * mean + 2 * largest
    return got


def test_sizes_are_near_equal(spark):
    draw = random.Random(1)
    rows = [(i, "é" * draw.randrange(200)) for i in range(2000)]
    check(spark, rows, 16, sharding.GROUP_TOLERANCE)


def test_a_third_is_one_text(spark):
    draw = random.Random(2)
    rows = [(i, "copy" * 30) for i in range(1000)] + [(i, str(draw.random()) * 5) for i in range(1000, 3000)]
    got = check(spark, rows, 16, sharding.GROUP_TOLERANCE)
    assert len({r.shard for r in got if r.doc_id < 1000}) > 3


def test_one_row_over_and_over(spark):
    check(spark, [(7, "same")] * 500 + [(None, None)] * 500 + [(8, "")] * 20, 4, sharding.GROUP_TOLERANCE)


def test_groups_stay_whole_where_sizes_allow(spark):
    rows = [(i, f"text number {i // 4}") for i in range(8000)]
    got = check(spark, rows, 8, sharding.GROUP_TOLERANCE)
    shards = defaultdict(set)
    for r in got:
        shards[r.doc_id // 4].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_slots_follow_shards_over_tasks(spark):
    rows = [(i, str(i) * 20) for i in range(300)]
    check(spark, rows, 1, sharding.GROUP_TOLERANCE)
    check(spark, rows, 100, sharding.GROUP_TOLERANCE)


def test_few_and_no_rows(spark):
    check(spark, [(1, "a"), (2, None)], 16, 1.0)
    docs = spark.createDataFrame([], "doc_id long, text string, size int, shard string")
    assert sharding.digest(docs).collect() == []
    with pytest.raises(ValueError):
        sharding.assigned(docs, 0)


def test_digest_columns_and_native_plan(spark, small_folder):
    done = sharding.digest(spark.read.parquet(f"{small_folder}/documents.parquet").withColumn("slot", F.lit("clash")))
    assert done.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert dict(done.dtypes)["grown_shard"] == "int" and dict(done.dtypes)["shard"] == "int" and dict(done.dtypes)["slot"] == "bigint"
    text = done._sc._jvm.PythonSQLUtils.explainString(done._jdf.queryExecution(), "formatted")
    assert "Python" not in text and "Cartesian" not in text and "Window" not in text


def test_rows_are_exchanged_by_the_splitters(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(i, "copy" * 30) for i in range(700)] + [(i, str(draw.random()) * 5) for i in range(700, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    exchanges = []
    write = sharding.write_once

    def noted(df, name):
        exchanges.append(df._jdf.queryExecution().toString())
        return write(df, name)

    monkeypatch.setattr(sharding, "write_once", noted)
    got = sharding.assigned(docs, 3).collect()
    assert sum("rangepartitioning" in plan for plan in exchanges) == 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-tasks // 3)
    assert any(f", {3 * parts}), REPARTITION_BY_NUM" in plan for plan in exchanges)
    assert Counter(r.shard for r in got).keys() == {0, 1, 2}


def test_splitters_of_tasks_lie_between_those_of_shards(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, "same text" if i % 3 else str(draw.random())) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.selectExpr(
        "length(text) + 1L AS size", "xxhash64(text) AS by_text", "xxhash64(doc_id) AS by_id", "0L AS by_place"
    ).cache()
    few = sharding.splitters(keyed, 4, 0.002, 0.02)
    monkeypatch.setattr(sharding, "COUNTS", 16)
    many = sharding.splitters(keyed, 4, 0.002, 0.02, parts=5)
    assert len(many) == 19 and many == sorted(many)
    size = [0] * 20
    for r in keyed.collect():
        key = sum((v + (1 << 63)) << (64 * (2 - i)) for i, v in enumerate((r.by_text, r.by_id, r.by_place)))
        size[sum(cut <= key for cut in many)] += r.size
    mean = sum(size) / 20
    assert all(abs(s - mean) <= 0.35 * mean + 10 for s in size)
    for k, cut in enumerate(few):
        below = sum(size[: 5 * (k + 1)])
        assert abs(below - sum(size) * (k + 1) / 4) <= 0.02 * sum(size) / 4 + 10
    keyed.unpersist()
