"""Statistics at sizes no local table has: count tables of 1e10 rows a cell, tails at 1e15 rows."""

import math

import numpy as np
import pytest

from quarry.functions import pvalues as PV
from quarry.operators import association as A
from quarry.operators import profile as P
from quarry.operators import distribution as D
from quarry.operators import ranks as K
from quarry.operators import regression as RG

CELLS = "variable string, value string, class string, o long"


def test_chi_square_of_huge_counts(spark):
    big = 10_000_000_000
    rows = [("v", x, y, n) for (x, y), n in {("a", "0"): big, ("a", "1"): big + 400_000, ("b", "0"): big + 100_000, ("b", "1"): big}.items()]
    got = A.independence_test(spark.createDataFrame(rows, CELLS), yates=False).first()
    o = np.array([[big, big + 400_000], [big + 100_000, big]], dtype=object)
    n, r, c = o.sum(), o.sum(1), o.sum(0)
    exact = float(sum((o[i][j] * n - r[i] * c[j]) ** 2 / (r[i] * c[j] * n) for i in range(2) for j in range(2)))
    assert got.n == n and got.chi2 == pytest.approx(exact, rel=1e-6)
    assert got.cramers_v == pytest.approx(math.sqrt(exact / n), rel=1e-6)
    assert got.p_value == pytest.approx(math.erfc(math.sqrt(exact / 2)), rel=1e-5)


def test_empty_cells_count(spark):
    """A cell that nobody is in adds its expectation."""
    rows = [("v", "a", "0", 30), ("v", "b", "1", 20), ("v", "b", "0", 10), ("v", "c", "1", 40)]
    got = A.independence_test(spark.createDataFrame(rows, CELLS), yates=False).first()
    o = np.array([[30, 0], [10, 20], [0, 40.0]])
    e = o.sum(1)[:, None] * o.sum(0) / o.sum()
    assert got.chi2 == pytest.approx(((o - e) ** 2 / e).sum()) and got.dof == 2


def test_information_of_huge_counts(spark):
    big = 4_000_000_000_000
    rows = [("v", "a", "0", 3 * big), ("v", "a", "1", big), ("v", "b", "0", big), ("v", "b", "1", 3 * big)]
    got = A.information(spark.createDataFrame(rows, CELLS)).first()
    assert got.mi == pytest.approx(2 * (3 / 8 * math.log(1.5) + 1 / 8 * math.log(0.5)), rel=1e-12)


def test_nominal_columns_and_large_integers(spark):
    df = spark.createDataFrame([("x", 2 ** 53, "no"), ("x", 2 ** 53, "no"), ("y", 2 ** 53 + 1, "yes"), ("y", 2 ** 53 + 1, "yes")] * 5,
                               "name string, code long, target string")
    got = {r.variable: r for r in A.chi_square(df, ["name", "code"], "target", yates=False, with_p=False).collect()}
    assert got["name"].chi2 == pytest.approx(20) and got["code"].chi2 == pytest.approx(20)


def test_chi2_tail():
    for x, k in ((3, 1), (40, 1), (5, 5), (200, 30), (30, 30)):                       # even dof: a finite sum
        want = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k))
        assert PV.chi2_sf_scalar(x, 2 * k) == pytest.approx(want, rel=1e-9)
    for z in (0.01, 1.0, 6.0, 30.0):
        assert PV.chi2_sf_scalar(z * z, 1) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)
    for dof in (1e7, 1e8, 1e9):                                                       # median: 1/2 - 1/(3 sqrt(pi dof)) to first order
        assert PV.chi2_sf_scalar(dof, dof) == pytest.approx(0.5 - 1 / (3 * math.sqrt(math.pi * dof)), abs=1e-10)
    assert math.isnan(PV.chi2_sf_scalar(float("nan"), 2)) and math.isnan(PV.chi2_sf_scalar(1, 0)) and PV.chi2_sf_scalar(0, 3) == 1


def test_t_and_f_tails():
    for t in (0.01, 0.5, 2.0, 6.0, 1e4):
        assert PV.t_two_sided_scalar(t, 1) == pytest.approx(2 / math.pi * math.atan(1 / t), rel=1e-9)
        assert PV.t_two_sided_scalar(t, 2) == pytest.approx(2 / (2 + t * t) / (1 + t / math.sqrt(2 + t * t)), rel=1e-9)
    for n in (1e12, 1e14, 1e15):
        assert PV.t_two_sided_scalar(2.0, n) == pytest.approx(math.erfc(math.sqrt(2)), rel=1e-9)
    for f, d in ((0.5, 7), (3, 1e3), (2, 1e15)):
        assert PV.f_sf_scalar(f, 2, d) == pytest.approx(math.exp(-d / 2 * math.log1p(2 * f / d)), rel=1e-9)
    assert PV.f_sf_scalar(0, 1, 5) == 1 and PV.f_sf_scalar(float("inf"), 1, 5) == 0


def test_null_groups_stay(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4)] + [(None, float(x)) for x in (1, 4, 8, 2, 9)] + [("b", None), (None, None)]
    df = spark.createDataFrame(rows, "g string, x double")
    stats = {r.g: r for r in P.group_stats(df, ["g"], "x").collect()}
    assert set(stats) == {"a", None} and stats[None]["count"] == 5 and stats[None].median == 4
    assert stats[None]["std"] == pytest.approx(np.std([1, 4, 8, 2, 9], ddof=1))
    desc = {r.g: r for r in P.describe(df, ["x"], by=["g"]).collect()}
    assert desc[None].median == 4 and desc[None].nulls == 1 and desc[None].skew is not None and desc["b"]["count"] == 0
    box = {r.g: r for r in D.box_stats(df, ["x"], by=["g"]).collect()}
    assert box[None].median == 4 and box["a"].median == 2.5
    own = D.histogram(df, ["x"], bins=2, by=["g"], shared_edges=False).collect()
    assert sum(r.n for r in own if r.g is None) == 5
    ranked = {(r.g, r.x): r.x_rank for r in K.with_midrank(df, "x", by=["g"]).collect()}
    assert ranked[None, 4.0] == 3 and ranked["a", 4.0] == 4 and ranked["b", None] is None and ranked[None, None] is None


def test_orders(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (2, None), (3, None)], "v int, t string")
    assert [r.v for r in P.value_counts(df, "v").collect()] == [2, 1, 3]
    assert [r.v for r in P.value_counts(df, "v", by_value=True).collect()] == [1, 2, 3]
    assert [r.variable for r in P.null_profile(df, only_missing=False).collect()] == ["t", "v"]
    m = spark.createDataFrame([("a", "b", 0.1, 9), ("c", "a", -0.8, 9), ("b", "c", 0.9, 9), ("a", "d", None, 0)], "var_x string, var_y string, r double, n long")
    assert [r.variable for r in A.with_target(m, "a", "r").collect()] == ["c", "b", "d"]


def test_constant_label_has_no_r2(spark):
    got = RG.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "price double, prediction double")).first()
    assert got.r2 is None and got.mae == 1


def test_cross_validation_never_scores_a_hold_out_row(spark):
    rows = [(i, float(i % 13 + 1), float(i % 7), "train" if i % 3 else "test", i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, price double, x double, split string, fold int")
    folds = RG.cross_validate(df, ["linear"], 5, numeric=["x"], categorical=[]).collect()
    assert [r.n for r in folds] == [sum(1 for r in rows if r[3] == "train" and r[4] == f) for f in range(5)]
    shifted = df.withColumn("price", RG.F.when(df.split == "test", df.price * 1000).otherwise(df.price))
    again = RG.cross_validate(shifted, ["linear"], 5, numeric=["x"], categorical=[]).collect()
    assert [r.rmse for r in again] == [r.rmse for r in folds]
