"""Exact quantiles from sketch brackets, against numpy, and what their plans leave out."""

import numpy as np
import pytest

from quarry.operators import distribution as D
from quarry.operators import profile as P
from quarry.operators import ranks as K


@pytest.mark.parametrize("n", [1, 2, 3, 7, 30, 211, 5003, 60_000])
def test_equals_numpy(spark, n):
    r = np.random.default_rng(n)
    wide = np.exp(12 * r.standard_normal(n)) * np.where(r.random(n) < 0.5, -1, 1)
    ties = r.integers(0, 5, n).astype(float)
    ties[: n // 3] = 2.0
    rows = [(float(a), float(b), None if i % 3 == 0 else float(i)) for i, (a, b) in enumerate(zip(wide, ties))]
    df = spark.createDataFrame(rows, "wide double, ties double, holes double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {x.variable: x for x in K.quantiles(df, ["wide", "ties", "holes"], probs, names=[f"q{i}" for i in range(7)]).collect()}
    for name, values in (("wide", wide), ("ties", ties), ("holes", np.array([x[2] for x in rows if x[2] is not None]))):
        if len(values):
            want = np.quantile(values, probs)
            assert got[name].n == len(values)
            assert [got[name][f"q{i}"] for i in range(7)] == pytest.approx(want.tolist(), rel=1e-12)
        else:
            assert name not in got


def test_all_null_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert [r.variable for r in K.quantiles(df, ["a", "b"], [0.5]).collect()] == ["b"]
    d = {r.variable: r for r in P.describe(df, ["a", "b"]).collect()}
    assert d["a"]["count"] == 0 and d["a"].median is None and d["a"].nulls == 2 and d["b"].median == 1.5
    empty = df.limit(0)
    assert K.quantiles(empty, ["a"], [0.5]).count() == 0 and D.box_stats(empty, ["a"]).count() == 0 and D.iqr_outliers(empty, ["a"]).count() == 0


def test_no_unpivoted_shuffle(spark):
    """Whole-column profiles neither unpivot the rows nor range-partition them."""
    df = spark.range(1000).selectExpr("id * 1.0 AS a", "id % 7 * 1.0 AS b")
    for out in (P.describe(df, ["a", "b"]), D.box_stats(df, ["a", "b"]), D.iqr_outliers(df, ["a", "b"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "rangepartitioning" not in plan
