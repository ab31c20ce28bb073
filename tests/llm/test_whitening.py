"""Whitening against numpy's eigenvectors of the covariance; rows that can't take part, ties, huge entries, few rows."""

import math

import numpy as np
import pytest

from genmeta.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, x long, n string"


def solved(x):
    """Of rows of whole numbers: eigenvalues falling, vectors, trace, n, sums."""
    fit = np.unique(x, axis=0)
    y = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / len(fit))
    return values[::-1], vectors[:, ::-1], np.trace(y.T @ y / len(fit)), len(fit), fit.sum(axis=0)


@pytest.mark.parametrize("rows,dim,spread", [(3000, 64, None), (2000, 200, "falling"), (400, 8, None), (300, 2, None), (5, 30, None), (900, 64, "tight"), (2500, 96, "far")])
def test_solver(rows, dim, spread):
    rng = np.random.default_rng(rows + dim)
    x = rng.standard_normal((rows, dim)) * 60
    x = {"falling": x * np.linspace(40, 1, dim), "tight": x / 20, "far": x + 1e7, None: x}[spread]
    x = np.floor(x)
    y = x - x.mean(axis=0)
    passes = []
    values, vectors = whitening.leading(lambda u: passes.append(u.shape[1]) or y.T @ (y @ u) / rows, dim, 4)
    want = np.linalg.eigvalsh(y.T @ y / rows)[::-1][:4]
    assert np.abs(values - want).max() < 1e-12 * want[0]
    residual = np.linalg.norm(y.T @ (y @ vectors) / rows - vectors * values, axis=0)
    assert residual.max() < 4e-16 * dim * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert len(passes) < 200


def test_equal_eigenvalues():
    a = np.diag([5.0, 5, 5, 3, 3, *np.linspace(2, 1, 60)])
    values, vectors = whitening.leading(lambda u: a @ u, 65, 4)
    assert np.abs(values - [5, 5, 5, 3]).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-13


def check(got, rows):
    """rows: (vec_id, usable vector)."""
    x = np.floor(np.array([v for _, v in rows], float) * 256)
    values, vectors, trace, n, sums = solved(x)
    k = min(4, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == k * len(rows)
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-4
    assert sorted(by) == list(range(1, k + 1))
    for i in range(k):
        own = by[i + 1]
        want = (x - sums / n) @ vectors[:, i] / math.sqrt(values[i])
        have = np.array([own[v][0]["whitened"] for v, _ in rows])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        for (v, _), row in zip(rows, x.astype(int).tolist(), strict=True):
            assert own[v][0]["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(row, sums, strict=True))
            assert abs(own[v][0]["explained"] - values[i] / trace) < 1e-9


def test_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(24) * np.linspace(3, 0.2, 24)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(200)]  # many copies count once
    odd = [(2000, None), (2001, [None] * 24), (2002, [math.nan] + [0.0] * 23), (2003, [math.inf] * 24), (2004, []), (2005, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in rows + odd], SCHEMA).repartition(7)
    check(whitening.whitened(df).collect(), rows)


def test_few_rows_and_none(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame([(i, v, 1, "n") for i, v in rows], SCHEMA)).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [0.0, 0.0])]) == []
    assert make([(1, [2.0, -0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.001])]) == []  # equal once they are whole numbers
    check(make([(1, [0.0, 0.0, 1.0]), (2, [3.0, 0.5, 1.0])]), [(1, [0.0, 0.0, 1.0]), (2, [3.0, 0.5, 1.0])])
    (a, b) = make([(None, [0.0]), (None, [1.0])])
    assert a["component"] == b["component"] == 1 and a["whitened"] == -b["whitened"] and abs(abs(a["whitened"]) - 1) < 1e-12
    huge = make([(1, [1e300, 0.0]), (2, [0.0, 1.0])])
    assert [r["deviation"] for r in huge] == [None] * len(huge) and all(math.isfinite(r["whitened"]) for r in huge)


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.op11_whitening(spark, sf).collect(), rows)
