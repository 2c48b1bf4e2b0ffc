"""Whitening against whole numbers and fractions in plain Python."""

import math
import random

import numpy as np
import pytest

from quire.llm.whitening import components, whiten

SF = "/root/testdata/sf0.01"


def checked(rows, vectors, most=32):
    """vectors: (id, entries) of the sound ones; ids are distinct."""
    n, d = len(vectors), len(vectors[0][1])
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in vectors}
    s = [sum(v[j] for v in x.values()) for j in range(d)]
    # exact covariance, times n ** 3
    y = np.array([[n * a - b for a, b in zip(v, s, strict=True)] for v in x.values()], dtype=object)
    v = (y.T @ y).astype(float) / n**3
    e, u = components(v)
    k = min(most, d)
    assert len(rows) == n * k
    place = {i: r for r, i in enumerate(x)}
    w = np.full((n, k), np.nan)
    for r in rows:
        assert r.n == n and int(r.deviation) == int(sum(a * a for a in y[place[r.vec_id]]))
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-9)
        w[place[r.vec_id], r.component - 1] = r.whitened
    expected = (y.astype(float) / n) @ u[:, :k] / np.sqrt(e[:k])
    assert np.abs(np.abs(w) - np.abs(expected)).max() < 1e-6
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_whole_table(spark):
    from quire.llm.queries import op13_whitening

    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    df = op13_whitening(spark, SF)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    checked(df.collect(), vectors)


def test_short_and_odd_vectors(spark):
    rng = random.Random(3)
    good = [(i, [rng.gauss(0, 3 ** (j - 1)) + (i % 7) for j in range(3)]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 0.5, 7) for i, v in good + bad], "vec_id long, embedding array<double>, x string, whitened double, n long")
    checked(whiten(df).collect(), good)
    assert whiten(df, key="x").select("x").distinct().collect()[0].x == "x"


def test_no_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = whiten(df).collect()
    assert len(rows) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 3 for r in rows)
    flat = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(8)], "vec_id long, embedding array<float>")
    rows = whiten(flat).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in rows)
    assert {round(r.explained, 9) for r in rows} == {0.0, 1.0} and rows[0].identity_error < 1e-9


def test_repeated_rows_and_large_entries(spark):
    same = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<float>")
    assert len(whiten(same).collect()) == 6
    large = [(i, [float(i) * 1e9, float(-i)]) for i in range(40)]
    rows = whiten(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in large]
    s = [sum(v[j] for v in x) for j in range(2)]
    assert {r.vec_id: int(r.deviation) for r in rows} == {i: sum((40 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for (i, _), v in zip(large, x, strict=True)}


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whiten(df).collect() == [] and whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
