"""Whitening against numpy's eigenvectors and whole-number arithmetic."""

import math

import numpy as np
import pytest

from inkwarden.llm import whitening as w

DATA = "/root/testdata/sf0.01"


def plain(vectors):
    """x, covariance, falling eigenvalues and eigenvectors of the rows that take part."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors])
    y = x - np.array([sum(map(int, col)) / len(x) for col in x.T])
    values, rows = np.linalg.eigh(y.T @ y / len(x))
    return x, y, values[::-1], rows.T[::-1]


def test_query_against_numpy(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x, y, values, rows = plain([r["embedding"] for r in table])
    got = w.op13_whitening(spark, DATA).toPandas().sort_values(["vec_id", "component"])
    n = len(x)
    assert len(got) == 8 * n and list(got["component"][:8]) == list(range(1, 9)) and (got["n"] == n).all()
    total = x.sum(axis=0)
    assert got["deviation"].tolist() == [v for row in x for v in [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True))] * 8]
    whitened = got["whitened"].to_numpy().reshape(n, 8)
    expected = y @ rows[:8].T / np.sqrt(values[:8])
    for k in range(8):
        sign = np.sign(whitened[:, k] @ expected[:, k])
        assert np.allclose(whitened[:, k], sign * expected[:, k], atol=1e-9)
    assert np.allclose(got["explained"].to_numpy()[:8], values[:8] / values.sum(), rtol=1e-12)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-11


@pytest.mark.parametrize("kind", ["random", "equal", "clusters", "low rank", "diagonal", "two", "one", "wide", "graded", "split"])
def test_components(kind):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    matrix = {
        "random": (lambda a: a @ a.T)(rng.standard_normal((40, 60))),
        "equal": np.eye(12) * 3,
        "clusters": q @ np.diag(np.concatenate([[5] * 4, 5 + 1e-13 * np.arange(3), 5 - 1e-9 * np.arange(3), np.ones(30)])) @ q.T,
        "low rank": q[:, :3] @ np.diag([9, 4, 1]) @ q[:, :3].T,
        "diagonal": np.diag(np.arange(20.0)),
        "two": np.array([[2, 1], [1, 2.0]]), "one": np.array([[7.0]]),
        "wide": (lambda a: a @ a.T)(rng.standard_normal((300, 400))),
        "graded": q @ np.diag(10.0 ** -np.arange(40)) @ q.T,
        "split": np.kron(np.eye(8), np.array([[2, 1], [1, 2.0]])),
    }[kind]
    matrix = (matrix + matrix.T) / 2
    values, rows = w.leading_components(matrix)
    exact = np.linalg.eigvalsh(matrix)[::-1]
    assert len(values) == {"low rank": 3, "two": 2, "one": 1}.get(kind, 8)
    assert np.allclose(values, exact[:len(values)], atol=1e-13 * exact[0] * len(matrix))
    assert np.abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-13
    assert np.abs(matrix @ rows.T - rows.T * values).max() < 1e-13 * exact[0] * len(matrix)


def test_sturm_counts():
    rng = np.random.default_rng(8)
    diagonal, off = rng.standard_normal(30), rng.standard_normal(29)
    exact = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-4, 4, 50)
    assert (w.below(diagonal, off, at) == (exact[None] < at[:, None]).sum(axis=1)).all()


SHAPE = "vec_id bigint, embedding array<float>, n string, component int"


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(v)) for v in rng.standard_normal(3)]) for i in range(40)]
    good += [(3, good[3][1]), (None, [1.0, 2.0, 3.0])]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [nan, 0.0, 0.0]), (54, [inf, 0.0, 0.0]), (55, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x", 9) for i, v in good + odd], SHAPE).repartition(3)
    got = w.whiten(frame).toPandas()
    assert len(got) == 3 * len(good) and (got["n"] == 42).all() and got["vec_id"].isna().sum() == 3
    assert got["explained"].drop_duplicates().sum() == pytest.approx(1)
    same = got[got["vec_id"] == 3].sort_values("component")["whitened"].to_numpy()
    assert (same[::2] == same[1::2]).all()
    assert w.whiten(frame.limit(0)).count() == 0
    assert w.whiten(frame.where("vec_id >= 50 and vec_id < 55")).count() == 0
    assert w.whiten(frame.where("vec_id = 3")).count() == 0, "equal vectors have no direction"


def test_values_beyond_a_long(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.5, 2.0]), (4, [1e12, 3.0])]
    got = w.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).toPandas()
    assert got["deviation"].isna().all() and np.isfinite(got["whitened"]).all()
    small = spark.createDataFrame([(1, [1e4]), (2, [2e4]), (3, [-1e6])], "vec_id bigint, embedding array<float>")
    x = [1024 * v + 100000 for v in (10**4, 2 * 10**4, -10**6)]
    assert sorted(w.whiten(small).toPandas()["deviation"]) == sorted((3 * v - sum(x)) ** 2 for v in x)
