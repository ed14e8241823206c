"""Whitening against a dense eigendecomposition, rank-one updates against whole matrices."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haulplan.llm import whitening
from haulplan.llm.whitening import Spectrum, rank_one

chance = random.Random(11)


def table_of(spark, vectors, folder):
    rows = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    rows = rows.withColumns({c: F.lit(7) for c in ("x", "n", "id", "values", "vectors", "size", "label")})
    rows.repartition(5).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def numbers(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def brute(vectors, dimensions):
    """Rows that take part, and number, sums, eigenvalues and eigenvectors of the distinct ones."""
    good = [(i, v) for i, v in vectors if v and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)]
    rows = [(i, numbers(v)) for i, v in good]
    fit = np.array(sorted({tuple(x) for _, x in rows}), float)
    n = len(fit)
    sums = [int(s) for s in fit.sum(axis=0)]
    off = (n * fit - np.array(sums)) / n
    values, basis = np.linalg.eigh(off.T @ off / n)
    return rows, n, sums, values[::-1], basis[:, ::-1]


def check(rows, vectors, dimensions, count):
    known, n, sums, values, basis = brute(vectors, dimensions)
    got = sorted(rows, key=lambda r: (r.component, str(r.vec_id), r.deviation))
    want = [(c, str(i), sum((n * a - s) ** 2 for a, s in zip(x, sums)), x) for c in range(1, count + 1) for i, x in known]
    want.sort(key=lambda w: w[:3])
    assert [(r.component, str(r.vec_id), r.deviation) for r in got] == [w[:3] for w in want]
    assert {r.n for r in got} == {n}
    for c in range(1, count + 1):
        white = np.array([r.whitened for r in got if r.component == c])
        exact = np.array([(np.array(w[3]) - np.array(sums) / n) @ basis[:, c - 1] / math.sqrt(values[c - 1]) for w in want if w[0] == c])
        assert min(np.abs(white - exact).max(), np.abs(white + exact).max()) < 1e-8
        assert all(abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-10 for r in got if r.component == c)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_query_equals_dense_solution(spark, tmp_path):
    vectors = [(i, [chance.gauss(0, 0.3 / (k + 1)) + k for k in range(12)]) for i in range(300)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(200)] + [(3, vectors[4][1]), (None, vectors[5][1])]
    vectors += [(2000, None), (2001, []), (2002, [None] * 12), (2003, [float("nan")] + [0.0] * 11), (2004, [float("inf")] * 12), (2005, [1.0] * 11)]
    rows = whitening.query(spark, table_of(spark, vectors, tmp_path)).collect()
    check(rows, vectors, 12, 4)


def test_few_dimensions_ties_and_no_variance(spark, tmp_path):
    square = [(i, [float(i % 2), float(i // 2 % 2), 5.0]) for i in range(8)]
    rows = whitening.query(spark, table_of(spark, square, tmp_path / "a")).collect()
    assert {r.component for r in rows} == {1, 2} and len(rows) == 16 and rows[0].identity_error < 1e-12
    assert all(abs(r.explained - 0.5) < 1e-12 for r in rows)
    assert whitening.query(spark, table_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], tmp_path / "b")).collect() == []
    assert whitening.query(spark, table_of(spark, [], tmp_path / "c")).collect() == []


def test_large_entries_stay_exact(spark, tmp_path):
    vectors = [(i, [float(np.float32(1e5 * chance.random())), chance.random()]) for i in range(50)]
    rows = whitening.query(spark, table_of(spark, vectors, tmp_path)).collect()
    check(rows, vectors, 2, 2)
    vectors = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 2.0])]
    rows = whitening.query(spark, table_of(spark, vectors, tmp_path / "d")).collect()
    assert {r.vec_id for r in rows if r.deviation is None} == {1, 2}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(0, 60), st.integers(0, 10**6), st.sampled_from([1, 3, 1000]))
def test_updates_equal_the_scatter(dimensions, count, seed, spread):
    """Few distinct values, so that equal eigenvalues and zero weights are common."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (count, dimensions)).astype(float)
    if dimensions > 2:
        x[:, 2] = x[:, 0]
    whole, half = Spectrum.empty(dimensions), Spectrum.empty(dimensions)
    for row in x[: count // 2]:
        whole.add(row)
    for row in x[count // 2 :]:
        half.add(row)
    if whole.n and half.n:
        whole.combine(half)
    elif half.n:
        whole = half
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) if count else np.zeros((dimensions, dimensions))
    scale = max(1.0, np.abs(scatter).max())
    assert np.abs((whole.vectors * whole.values) @ whole.vectors.T - scatter).max() < 1e-11 * scale
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(dimensions)).max() < 1e-10


@pytest.mark.parametrize("gap", [0.0, 1e-16, 1e-13, 1e-8, 1.0])
def test_near_equal_eigenvalues(gap):
    values = np.array([1.0, 1.0 + gap, 1.0 + 2 * gap, 3.0])
    v = np.array([1e-9, 0.5, 0.5, 1e-20])
    new, vectors = rank_one(values, np.eye(4), v)
    assert np.abs((vectors * new) @ vectors.T - np.diag(values) - np.outer(v, v)).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
