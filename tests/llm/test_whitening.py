"""Whitening against a dense eigensolver, and the parts of the contour integration one by one."""

import math

import numpy as np
import pytest

from tagwright.llm import whitening


def spectrum(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T, q


SPECTRA = [
    np.arange(1.0, 13.0),
    np.array([5.0, 5.0, 5.0, 4.0, 1.0, 1.0, 0.5, 0.1]),
    np.array([100.0, 1e-3, 1e-4, 1e-5, 1e-6]),
    np.array([1.0, 1 - 1e-5, 1 - 2e-5, 1 - 3e-5, 1 - 4e-5, 0.2]),
    1 / np.arange(1.0, 65.0) ** 0.1,
    np.array([3.0, 2.0, 0.0, 0.0, 0.0]),
    np.array([7.0]),
    np.array([2.0, 1.0]),
]


@pytest.mark.parametrize("values", SPECTRA, ids=range(len(SPECTRA)))
def test_largest(values):
    matrix, _ = spectrum(values)
    got, vectors = whitening.largest(matrix, 4)
    want = np.sort(values)[::-1][:4]
    want = want[want > 0]
    assert got == pytest.approx(want, rel=1e-11, abs=1e-12 * values.max())
    assert np.abs(matrix @ vectors - vectors * got).max() <= 1e-12 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() <= 1e-12


def test_inertia_counts():
    for values in SPECTRA:
        diagonal, side = whitening.tridiagonal(spectrum(values, 3)[0])
        for at in (-1.0, 0.05, 0.999, 1.5, 4.5, 1000.0):
            assert whitening.above(diagonal, side, at) == (values > at).sum()


def test_intervals_hold_what_was_counted():
    values = np.array([9.0, 8.0, 8.0, 7.9999999999, 3.0, 1.0]) / 20
    diagonal, side = whitening.tridiagonal(spectrum(values)[0])
    found = whitening.intervals(diagonal, side, 2, 1.5)
    assert [n for _, _, n in found] == [1, 3]
    assert sum((values > found[-1][0])) == 4


def test_projection_keeps_the_interval():
    values = np.array([4.0, 3.0, 1.0, 0.5])
    matrix, q = spectrum(values)
    filtered = q.T @ whitening.project(matrix, 2.0, 5.0, q)
    assert np.abs(filtered[:2, :2] - np.eye(2)).max() < 1e-2 and np.abs(filtered[2:, 2:]).max() < 0.1


def test_missed_eigenvalues_raise():
    matrix, _ = spectrum(np.array([4.0, 3.0, 1.0]))
    with pytest.raises(RuntimeError, match="counted but not found"):
        whitening.feast(matrix, 2.0, 5.0, 3)


def steps(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def expected(rows, width):
    usable = [(i, steps(v)) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in usable})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    centred = np.array(listed, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in usable:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        white = (np.array(x) - np.array(sums) / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))
        out.setdefault(i, []).append((n, deviation, white, values / values.sum()))
    return out


def corpus():
    draw = np.random.default_rng(7)
    base = draw.standard_normal((300, 8)) * np.array([3, 2.5, 1, 0.8, 0.5, 0.3, 0.2, 0.1])
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [None] * 8), (2004, [float("nan")] + [0.0] * 7)]
    rows += [(2005, [float("inf")] + [0.0] * 7), (None, rows[7][1]), (3, rows[8][1]), (2006, [0.0] * 8), (2007, [-0.0] * 8)]
    return rows


def test_equals_dense_solver(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' x", "7 n").repartition(5)
    got, want = whitening.whitened(frame).collect(), expected(rows, 8)
    assert len(got) == 4 * sum(map(len, want.values()))
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        match = [w for w in want[r.vec_id] if w[1] == r.deviation]
        assert match and r.n == match[0][0]
        white, explained = match[0][2][r.component - 1], match[0][3][r.component - 1]
        sign = signs.setdefault(r.component, math.copysign(1, white * r.whitened))
        assert r.whitened == pytest.approx(sign * white, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-10
    assert {r.component for r in got} == {1, 2, 3, 4}


def test_few_equal_and_no_vectors(spark):
    def found(rows, **options):
        return whitening.whitened(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), **options).collect()

    assert found([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == [] and found([(1, None)]) == []
    assert whitening.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    two = found([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])])
    assert [(r.component, r.n, round(abs(r.whitened), 9), r.explained) for r in two] == [(1, 2, 1.0, pytest.approx(1.0))] * 3
    assert sorted(r.deviation for r in two) == [2 * 256**2] * 3


def test_sums_beyond_a_long(spark):
    rows = [(i, [float(2**40) * (i % 3), float(i)]) for i in range(30)] + [(99, [1e300, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened(frame).collect()
    # Beside entries as large as these the second dimension is below rounding.
    assert all(r.deviation is None for r in got if r.vec_id == 99) and len(got) == 31
    plain = whitening.whitened(frame.filter("vec_id < 99")).collect()
    want = expected([(i, v) for i, v in rows[:30]], 2)
    assert all(r.deviation in (want[r.vec_id][0][1], None) for r in plain)
