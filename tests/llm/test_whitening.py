from __future__ import annotations

import numpy as np
import pytest

from tickloom.llm.queries import all_queries
from tickloom.llm.whitening import Spectrum, secular_roots, updated, whiten

SCHEMA = "vec_id long, embedding array<float>"


def table_of(rng, n, d, rank):
    spread = rng.normal(size=(rank, d)) * np.exp(rng.normal(size=(rank, 1)))
    return np.floor(64 * rng.normal(size=(n, rank)) @ spread).astype(np.int64) + 1_000_000


@pytest.mark.parametrize("gap", [1.0, 1e-3, 1e-9])
def test_secular_roots_interlace(gap):
    rng = np.random.default_rng(1)
    d = np.cumsum(gap + gap * rng.random(20))
    z = rng.normal(size=20) * 10.0 ** rng.integers(-6, 3, 20)
    roots = d - np.diag(secular_roots(d, z))
    want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
    assert np.allclose(roots, want, rtol=1e-12, atol=1e-12 * want[-1])
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()


def test_equal_eigenvalues_are_deflated():
    values, basis = updated(np.array([0.0, 2, 2, 2, 5]), np.eye(5), np.array([0.0, 1, 2, 2, 0]))
    assert np.allclose(values, [0, 2, 2, 5, 11])
    assert np.allclose(basis.T @ basis, np.eye(5))


@pytest.mark.parametrize("d,rank", [(1, 1), (7, 7), (9, 3), (64, 64)])
def test_spectra_of_parts_merge_to_that_of_all(d, rank):
    x = table_of(np.random.default_rng(d), 1500, d, rank)
    x[:300] = x[0]
    total = Spectrum(d)
    for part in (x[:1], x[1:40], x[40:41], x[41:1200], x[1200:]):
        mine = Spectrum(d)
        mine.add(part)
        total.merge(mine)
    away = x - x.mean(axis=0)
    scatter = away.T @ away
    assert total.n == 1500 and total.sums == x.sum(axis=0).tolist()
    assert np.allclose(total.basis * total.values @ total.basis.T, scatter, atol=1e-11 * np.abs(scatter).max())


def held_against_numpy(rows, x, ids):
    """Whitened rows against one eigendecomposition of the whole covariance, up to sign."""
    n, d = x.shape
    away = x - x.sum(axis=0) / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(32, d)
    assert len(rows) == n * k
    got = np.zeros((n, k))
    at = {v: i for i, v in enumerate(ids)}
    sums = [int(s) for s in x.sum(axis=0)]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    for r in rows:
        i, c = at[r["vec_id"]], r["component"] - 1
        got[i, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert abs(r["explained"] / (values[c] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9
    want = away @ vectors[:, :k] / np.sqrt(values[:k])
    sign = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * sign, want, atol=1e-6)


@pytest.mark.parametrize("d", [5, 40])
def test_whiten_equals_one_decomposition(spark, d):
    x = table_of(np.random.default_rng(d), 700, d, d)
    x[100:350] = x[3]
    rows = [(i, [float(v) for v in (row - 1_000_000) / 64]) for i, row in enumerate(x)]
    bad = [(900, None), (901, []), (902, [None] * d), (903, [float("nan")] * d), (904, [1.0] * (d - 1) + [float("inf")])]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(23)
    held_against_numpy(whiten(df).collect(), x, list(range(700)))


def test_query_equals_one_decomposition(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [r for r in rows if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"])]
    x = np.floor(64 * np.array([r["embedding"] for r in rows])).astype(np.int64) + 1_000_000
    held_against_numpy(all_queries()["op12_whitening"](spark, sf).collect(), x, [r["vec_id"] for r in rows])


def test_edges(spark):
    heads = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 5, SCHEMA)
    for df in (none, one, same):
        found = whiten(df)
        assert found.columns == heads and found.isEmpty()
    # one direction varies, ids repeat or lack, columns clash
    line = spark.createDataFrame([(None, [1.0, 2.0], 1), (7, [2.0, 4.0], 2), (7, [2.0, 4.0], 3)], SCHEMA + ", component int")
    rows = whiten(line).collect()
    assert [r["component"] for r in rows] == [1, 1, 1] and {r["vec_id"] for r in rows} == {None, 7}
    assert all(abs(r["explained"] - 1) < 1e-12 for r in rows)
    with pytest.raises(Exception, match="differ in length"):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA).coalesce(1)).collect()


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e9 * i, 0.5 * i]) for i in range(4)]
    x = [[64 * 10**9 * i + 10**6, 32 * i + 10**6] for i in range(4)]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * a - s) ** 2 for a, s in zip(row, sums)) for i, row in enumerate(x)}
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    if max(want.values()) >= 2**63:
        with pytest.raises(Exception):
            whiten(df).collect()
    else:
        assert {r["vec_id"]: r["deviation"] for r in whiten(df).collect()} == want
