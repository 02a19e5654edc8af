import numpy as np
import pytest

from quarry.operators.information import digamma, neighbour_information
from pyspark.sql import functions as F


def psi(m):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, int(m)))


def brute(xs, cs, k=3):
    """All distances of every row."""
    rows = [(x, c) for x, c in zip(xs, cs) if x is not None and np.isfinite(x) and c is not None]
    names = [c for _, c in rows]
    rows = [(x, c) for x, c in rows if names.count(c) > 1]
    x = np.array([r[0] for r in rows])
    c = np.array([str(r[1]) for r in rows])
    total = 0.0
    for i in range(len(rows)):
        own = np.sort(np.abs(np.delete(x, i)[np.delete(c, i) == c[i]] - x[i]))
        kk = min(k, len(own))
        r = own[kk - 1]
        d = np.abs(x - x[i])
        m = np.sum(d == 0) if r == 0 else np.sum(d < r - 2.0 ** -50 * (abs(x[i]) + r))
        total += psi(kk) - psi(len(own) + 1) - psi(m)
    return len(rows), max(0.0, psi(len(rows)) + total / len(rows))


def check(spark, xs, cs, **kw):
    df = spark.createDataFrame(list(zip(xs, cs)), "x double, c string")
    got = neighbour_information(df, ["x"], "c", **kw).collect()
    n, mi = brute(xs, cs, kw.get("k", 3))
    assert len(got) == 1 and got[0]["n"] == n
    assert got[0]["mi"] == pytest.approx(mi, abs=1e-9)
    return got[0]["mi"]


def test_digamma(spark):
    rows = spark.range(1, 400).select("id", digamma(F.col("id")).alias("p")).collect()
    assert max(abs(r["p"] - psi(r["id"])) for r in rows) < 1e-11


def test_continuous_values_against_all_distances(spark):
    rng = np.random.default_rng(5)
    c = rng.choice(["a", "b", "b", "b", "d"], 2000)
    x = rng.normal(size=2000) + (c == "a") * 1.5
    assert check(spark, x.tolist(), c.tolist(), block=64) > 0.05


def test_ties_and_a_hot_value(spark):
    rng = np.random.default_rng(6)
    c = rng.choice(["a", "b"], 600)
    x = np.where(rng.random(600) < 0.4, 7.0, rng.integers(0, 40, 600) / 4 + (c == "b"))
    check(spark, x.tolist(), c.tolist(), block=3)
    check(spark, x.tolist(), c.tolist(), k=7, block=5)


def test_nulls_lone_rows_and_small_classes(spark):
    x = [1.0, None, 2.0, float("nan"), 4.0, 8.0, 8.0, float("inf"), -3.0, 0.5, 0.25]
    c = ["a", "a", "a", "a", "b", "b", None, "b", "lone", "b", "a"]
    check(spark, x, c)


def test_empty(spark):
    df = spark.createDataFrame([], "x double, c string")
    assert neighbour_information(df, ["x"], "c").count() == 0
