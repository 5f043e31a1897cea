"""Profiles from merged states against profiles of the whole table."""

import random
import statistics

import pytest

from tagwright.operators import profile, states

SCHEMA = "example_id long, split string, batch int, text string, n double"


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(3)
    rows = [
        (i, draw.choice(["train", "test"]), i % 7, None if i % 11 == 0 else f"text {draw.randrange(3000)}",
         draw.choice([None, float("nan"), draw.gauss(1e6, 2.0), draw.gauss(1e6, 2.0), 5.0]))
        for i in range(20_000)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_union_of_parts_equals_the_whole(spark, table, tmp_path):
    # Batches arrive one after the other; what is merged is read from files that hold no text.
    for odd in (0, 1):
        part = table.filter(f"batch % 2 = {odd}")
        states.profile_states(part, ["split", "batch"], ["text", "n"]).write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 2 * 7 * 2
    for by in ((), ("split",)):
        got = {(*[r[k] for k in by], r.column_name): r for r in states.described(states.merge_states(stored, by)).collect()}
        for split in ("train", "test") if by else (None,):
            rows = table.filter(f"split = '{split}'") if split else table
            key = (split,) if split else ()
            text = next(iter(profile.profile_columns(rows.select("text")).collect()))
            merged = got[(*key, "text")]
            assert merged.null_count == text.null_count and merged.rows == rows.count() and merged["mean"] is None
            assert merged.unique_count == pytest.approx(text.unique_count, rel=states.DISTINCT_ERROR)
            values = sorted(r.n for r in rows.select("n").collect() if r.n is not None and r.n == r.n)
            n = got[(*key, "n")]
            assert (n["count"], n.min, n.max) == (len(values), values[0], values[-1])
            assert n["mean"] == pytest.approx(statistics.fmean(values)) and n.std == pytest.approx(statistics.stdev(values))
            for q in profile.QUARTILES:
                at = n[f"q{int(q * 100)}"]
                below, upto = (sum(f(v) for v in values) / len(values) for f in (lambda v: v < at, lambda v: v <= at))
                assert below <= q + states.RANK_ERROR and upto >= q - states.RANK_ERROR


def test_merging_merged_states_changes_nothing(table):
    parts = states.profile_states(table, ["split", "batch"], ["text", "n"])
    once = states.described(states.merge_states(parts)).orderBy("column_name").collect()
    twice = states.described(states.merge_states(states.merge_states(parts, ["split"]))).orderBy("column_name").collect()
    for a, b in zip(once, twice):
        assert (a["count"], a.null_count, a.min, a.max) == (b["count"], b.null_count, b.min, b.max)
        assert a.std == (None if b.std is None else pytest.approx(b.std))


def test_parts_without_values(spark):
    rows = [(1, "a", 0, None, None), (2, "b", 0, "x", 4.0), (3, None, 0, "", float("nan"))]
    parts = states.profile_states(spark.createDataFrame(rows, SCHEMA), ["split"], ["text", "n"])
    got = {(r.split, r.column_name): r for r in states.described(states.merge_states(parts, ["split"])).collect()}
    assert (got["a", "n"]["count"], got["a", "n"].q50, got["a", "n"].unique_count, got["a", "n"].null_count) == (0, None, 0, 1)
    assert (got["b", "n"].q50, got["b", "n"].std, got["b", "n"]["mean"]) == (4.0, None, 4.0)
    assert (got[None, "n"]["count"], got[None, "n"].null_count, got[None, "text"].unique_count) == (0, 0, 1)
    whole = {r.column_name: r for r in states.described(states.merge_states(parts)).collect()}
    assert (whole["n"].rows, whole["n"]["count"], whole["n"]["mean"], whole["n"].q25) == (3, 1, 4.0, 4.0)


def test_empty_table_and_no_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert states.described(states.merge_states(states.profile_states(empty, ["split"], ["n"]), ["split"])).collect() == []
    row = states.described(states.merge_states(states.profile_states(empty, (), ["n"]))).first()
    assert (row.rows, row["count"], row["mean"], row.q50) == (0, 0, None, None)
    with pytest.raises(ValueError, match="a column"):
        states.profile_states(empty, ["split"], [])


def test_merging_reads_no_text(spark, small_folder, tmp_path):
    docs = spark.read.parquet(f"{small_folder}/documents.parquet")
    states.profile_states(docs, ["lang"], ["text"]).write.parquet(str(tmp_path / "s"))
    plan = states.described(states.merge_states(spark.read.parquet(str(tmp_path / "s"))))._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and "distinct_state" in plan
