"""Whitening against numpy's eigendecomposition of the covariance, and its rank-one updates against dense sums."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF001
from tidemark.llm import whitening as Wh
from tidemark.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<float>, label string, x string, n string, deviation string, whitened string"


def _rows(n, d, seed=0, spread=None):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * (rng.uniform(0.05, 0.4, d) if spread is None else spread)).astype(np.float32)


def _frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], *"abcde") for i, v in vectors], SCHEMA)


def _expected(vectors, k=4):
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    distinct = np.array(sorted(set(x)), object)
    n, sums = len(distinct), distinct.sum(0)
    off = distinct.astype(float) - np.array([s / n for s in sums])
    cov = off.T @ off / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-9 * max(np.trace(cov), 1e-300)).sum()))
    deviation = [int(((n * np.array(r, object) - sums) ** 2).sum()) for r in x]
    white = (np.array(x, float) - np.array([s / n for s in sums])) @ u[:, :k] / np.sqrt(e[:k])
    return n, deviation, white, e[:k] / np.trace(cov)


def _compare(model, got, ids, vectors, k=4, tol=1e-9):
    n, deviation, white, share = _expected(vectors, k)
    assert model.n == n and len(model.values) == white.shape[1]
    np.testing.assert_allclose(model.values / model.trace, share, rtol=1e-9)
    assert model.identity_error <= 1e-9
    assert [got[i][0] for i in ids] == deviation
    found = np.array([got[i][1] for i in ids])
    sign = np.sign((found * white).sum(0))
    np.testing.assert_allclose(found, white * sign, atol=tol)


def test_whitening_equals_numpy(spark):
    base = _rows(400, 9)
    vectors = list(enumerate(base)) + [(1000 + i, base[7]) for i in range(250)] + [(None, base[3])]  # a hot vector, a null id
    bad = [(2000, None), (2001, []), (2002, [None] * 9), (2003, [float("nan")] * 9), (2004, [float("inf")] + [0.0] * 8), (2005, [1.0] * 5)]
    df = _frame(spark, vectors + bad).repartition(20)
    model = Wh.fit(df)
    got = {r[0]: (r[1], r[2]) for r in Wh.whiten(df, model).collect()}
    assert len(got) == len(vectors)
    _compare(model, got, [i for i, _ in vectors], [v for _, v in vectors])


def test_a_smaller_basis_converges_to_the_same_components(spark):
    base = _rows(300, 16, 4, spread=np.array([3, 2, 1.5, 1.1, *[0.2] * 12]))
    df = _frame(spark, enumerate(base)).repartition(5)
    model = Wh.fit(df, rank=7)
    got = {r[0]: (r[1], r[2]) for r in Wh.whiten(df, model).collect()}
    _compare(model, got, range(300), base, tol=1e-7)
    with pytest.raises(ValueError, match="rank"):
        Wh.fit(df, rank=2)


def test_less_variance_than_components(spark):
    line = [[0.25 * i, 0.5 * i, 1.0] for i in range(20)]
    df = _frame(spark, enumerate(line))
    model = Wh.fit(df)
    assert len(model.values) == 1
    got = {r[0]: (r[1], r[2]) for r in Wh.whiten(df, model).collect()}
    _compare(model, got, range(20), line)
    same = _frame(spark, [(i, [0.5, 0.5]) for i in range(5)])
    assert Wh.fit(same) is None and Wh.whiten(same, None).collect() == []
    assert Wh.fit(same.limit(0)) is None and Wh.whiten(same.limit(0), None).columns == ["vec_id", "deviation", "whitened"]


def test_large_numbers_are_exact(spark):
    base = [[c * 2.0 ** 13 for c in v] for v in _rows(60, 5, 2)] + [[1e30, 0, 0, 0, 0], [-1e30, 0, 0, 0, 0]]
    df = _frame(spark, enumerate(base[:60]))
    model = Wh.fit(df)
    got = {r[0]: (r[1], r[2]) for r in Wh.whiten(df, model).collect()}
    _compare(model, got, range(60), base[:60])
    far = _frame(spark, enumerate(base))
    model = Wh.fit(far)
    deviation = {r[0]: r[1] for r in Wh.whiten(far, model).collect()}
    assert model.n == 62 and deviation[60] is None  # saturated entries: their squares are beyond a long


def test_query_on_the_small_table(spark):
    got = op13_whitening(spark, SF001).collect()
    rows = spark.read.parquet(f"{SF001}/embeddings.parquet").collect()
    n, deviation, white, share = _expected([r["embedding"] for r in rows])
    ids = [r["vec_id"] for r in rows]
    assert len(got) == 4 * len(ids) and {r["component"] for r in got} == {1, 2, 3, 4}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(4):
        column = np.array([by[i, c + 1]["whitened"] for i in ids])
        np.testing.assert_allclose(column * np.sign(column @ white[:, c]), white[:, c], atol=1e-9)
        assert all(abs(by[i, c + 1]["explained"] - share[c]) < 1e-12 for i in ids)
    assert [by[i, 1]["deviation"] for i in ids] == deviation
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 8), st.integers(0, 30), st.sampled_from([1.0, 3.0, 1e4]))
def test_rank_one_updates_equal_dense_sums(seed, d, n, size):
    """Whole numbers of few values: equal eigenvalues and untouched directions are common."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)) * rng.choice([0, 1, size], d)) * 1.0
    s, parts = Wh.Spectrum.empty(d), [Wh.Spectrum.empty(d) for _ in range(3)]
    for i, v in enumerate(x):
        s.add(v)
        parts[i % 3].add(v)
    whole = parts[0]
    for p in parts[1:]:
        whole.merge(p)
    off = x - x.mean(0) if n else x
    want = off.T @ off
    for got in (s, whole):
        assert got.n == n
        np.testing.assert_allclose(got.vectors @ np.diag(got.values) @ got.vectors.T, want, atol=1e-9 * max(1.0, np.abs(want).max()))
        np.testing.assert_allclose(got.vectors.T @ got.vectors, np.eye(len(got.values)), atol=1e-10)


def test_secular_roots():
    rng = np.random.default_rng(1)
    for k in (1, 2, 5, 40):
        values, z = np.sort(rng.uniform(0, 10, k)), rng.normal(size=k)
        if k > 4:
            values[1] = values[0] + 1e-13
            z[2] = 1e-9
        roots, off = Wh.secular_roots(values, z)
        np.testing.assert_allclose(roots, np.linalg.eigvalsh(np.diag(values) + np.outer(z, z)), rtol=1e-12, atol=1e-12)
        np.testing.assert_allclose(off, values[:, None] - roots[None, :], atol=1e-12)
