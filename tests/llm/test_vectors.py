"""Embedding near-dedup against all pairs."""

import math

import numpy as np
import pytest

from tagwright.llm import vectors


def expected(rows, threshold=0.9):
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        a /= np.abs(a).max()
        return a / np.linalg.norm(a)

    units = [unit(v) for _, v in rows]
    linked = [
        [j for j, b in enumerate(units) if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold]
        for i, a in enumerate(units)
    ]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, len(linked[i]), component, vec_id == component))
    return sorted(out, key=repr)


def corpus(n=200, size=16, seed=1):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = draw.standard_normal(size)
        rows.append((len(rows), v.tolist()))
        for _ in range(int(draw.integers(0, 4))):
            rows.append((len(rows), (v + draw.standard_normal(size) * draw.choice([0.01, 0.2, 0.4])).tolist()))
    rows += [(5000, rows[3][1]), (5001, rows[3][1]), (5002, [2 * x for x in rows[4][1]]), (5003, [0.0] * size)]
    rows += [(5004, None), (5005, []), (5006, [1.0, None]), (5007, [float("nan")] * size), (5008, [float("inf"), 1.0])]
    rows += [(5009, [1.0, 0.0]), (5010, [0.95, 0.1]), (5011, [1e-300, 0.0]), (5012, [1e300, 1e299]), (None, [0.0, 1.0])]
    rows += [(5003, [0.0] * size), (9, rows[9][1])]
    return rows


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    return sorted((tuple(r) for r in vectors.near_duplicates(frame, **options).collect()), key=repr)


def test_equals_all_pairs(spark):
    rows = corpus()
    # Tables enough for every pair, however near the threshold.
    assert found(spark, rows, tables=120, projections=4) == expected(rows)


def test_blocks_of_large_buckets(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centre = draw.standard_normal(8)
    rows = [(i, (centre + draw.standard_normal(8) * 0.05).tolist()) for i in range(150)]
    rows += [(1000 + i, draw.standard_normal(8).tolist()) for i in range(50)]
    monkeypatch.setattr(vectors, "BLOCK", 16)
    assert found(spark, rows, tables=60, projections=4) == expected(rows)


def test_no_false_links_and_recall(spark):
    rows = corpus(n=400, seed=3)[:800]
    got, want = found(spark, rows), expected(rows)
    links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert links[0] >= 0.97 * links[1]
    assert vectors.recall(0.9) > 0.99 and vectors.recall(0.95) > 0.999


def test_collision_probability():
    draw = np.random.default_rng(1)
    a = np.zeros(16)
    a[0] = 1
    b = np.zeros(16)
    b[:2] = 0.9, math.sqrt(1 - 0.81)
    directions, shifts = draw.standard_normal((16, 20_000)), draw.uniform(0, 2, 20_000)
    same = np.floor((a @ directions + shifts) / 2) == np.floor((b @ directions + shifts) / 2)
    assert same.mean() == pytest.approx(vectors.collision_probability(0.9, 2.0), abs=0.01)


def test_floats_and_empty_table(spark):
    frame = spark.createDataFrame([(1, [0.6, 0.8], 7), (2, [0.6, 0.8], 7)], "vec_id int, embedding array<float>, node int")
    assert sorted(tuple(r) for r in vectors.near_duplicates(frame).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert vectors.near_duplicates(frame.limit(0)).collect() == []


def test_null_vectors_keep_their_rows(spark):
    rows = [(1, None), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (4, None), (None, None)]
    assert found(spark, rows) == expected(rows)
    assert len(found(spark, rows)) == 6
