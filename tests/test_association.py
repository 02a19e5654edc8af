import pytest

from quarry.functions import pvalues as PV
from quarry.operators import association as A


def _counts_df(spark, cells):
    rows = []
    k = 0
    for (a, b), n in cells.items():
        for _ in range(n):
            rows.append((k, a, b))
            k += 1
    return spark.createDataFrame(rows, "k long, a long, t long")


def test_chi_square_2x2_yates_and_plain(spark):
    df = _counts_df(spark, {(0, 0): 30, (0, 1): 10, (1, 0): 15, (1, 1): 25})
    y = A.chi_square(df, ["a"], "t", yates=True).first()
    p = A.chi_square(df, ["a"], "t", yates=False).first()
    assert p["chi2"] == pytest.approx(11.4285714, abs=1e-6)
    assert p["p_value"] == pytest.approx(0.00072323, abs=1e-8)
    assert y["chi2"] == pytest.approx(9.9555556, abs=1e-6)
    assert y["cramers_v"] == pytest.approx((9.9555556 / 80) ** 0.5, abs=1e-6)


def test_chi_square_single_class_is_null(spark):
    df = _counts_df(spark, {(0, 1): 5, (1, 1): 7})
    r = A.chi_square(df, ["a"], "t").first()
    assert r["chi2"] is None and r["cramers_v"] is None


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 2.0), (4.0, 9.0), (5.0, 5.0)], "x double, y double")
    assert A.spearman_matrix(df, ["x", "y"]).first()["rho"] == pytest.approx(0.6578947368, abs=1e-9)


def test_pairwise_complete_pearson_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, 1.0), (3.0, 5.0, 1.0), (4.0, 4.0, 1.0)],
                               "x double, y double, c double")
    m = {(r["var_x"], r["var_y"]): r for r in A.pearson_matrix(df, ["x", "y", "c"]).collect()}
    assert m[("x", "y")]["r"] == pytest.approx(0.7857142857, abs=1e-9) and m[("x", "y")]["n"] == 3
    assert m[("x", "c")]["r"] is None          # zero variance → NULL, no exception


def test_kruskal_wallis_hand_value(spark):
    # groups a: 1,2,3 ; b: 4,5,6 ; no ties → H = 12/(6*7) * (6^2/3 + 15^2/3) - 3*7 = 3.857142857
    rows = [(i, float(v), g) for i, (v, g) in enumerate([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "b")])]
    df = spark.createDataFrame(rows, "k long, v double, g string")
    r = A.kruskal_wallis(df, ["v"], "g").first()
    assert r["h"] == pytest.approx(3.857142857, abs=1e-9)
    assert r["p_value"] == pytest.approx(PV.chi2_sf_scalar(r["h"], 1), abs=1e-12)


def test_anova_hand_value(spark):
    # a: 1,2,3 (mean 2) ; b: 5,6,7 (mean 6): SSB = 24, SSW = 4, F = 24 / (4/4) = 24
    rows = [(float(v), g) for v, g in [(1, "a"), (2, "a"), (3, "a"), (5, "b"), (6, "b"), (7, "b")]]
    r = A.anova_oneway(spark.createDataFrame(rows, "v double, g string"), ["v"], "g").first()
    assert r["f"] == pytest.approx(24.0) and (r["df_between"], r["df_within"]) == (1, 4)


def test_pvalue_special_functions():
    assert PV.chi2_sf_scalar(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert PV.chi2_sf_scalar(11.428571, 1) == pytest.approx(0.00072323, abs=1e-8)
    assert PV.t_two_sided_scalar(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert PV.f_sf_scalar(4.102821015130399, 2, 10) == pytest.approx(0.05, abs=1e-10)
    assert PV.chi2_sf_scalar(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)


def test_mutual_information_independent_is_zero(spark):
    df = _counts_df(spark, {(0, 0): 10, (0, 1): 10, (1, 0): 10, (1, 1): 10})
    assert A.mutual_information(df, ["a"], "t").first()["mi"] == pytest.approx(0.0, abs=1e-12)


def test_kruskal_ties_hot_group_brute_force(spark):
    import random
    rnd = random.Random(9)
    rows = [("hot", float(rnd.randint(0, 6))) for _ in range(300)]
    rows += [(g, float(rnd.randint(0, 9))) for g in ("b", "c") for _ in range(150)]
    df = spark.createDataFrame(rows, "g string, v double")
    # brute force: mid-ranks by sorting, rank sums per group, tie correction
    vals = sorted(v for _, v in rows)
    first = {}
    for i, v in enumerate(vals, start=1):
        first.setdefault(v, []).append(i)
    mid = {v: sum(p) / len(p) for v, p in first.items()}
    n = len(rows)
    sums, counts = {}, {}
    for g, v in rows:
        sums[g] = sums.get(g, 0.0) + mid[v]
        counts[g] = counts.get(g, 0) + 1
    h0 = 12.0 / (n * (n + 1)) * sum(sums[g] ** 2 / counts[g] for g in sums) - 3 * (n + 1)
    ties = sum(len(p) ** 3 - len(p) for p in first.values())
    h = h0 / (1 - ties / (n ** 3 - n))
    got = A.kruskal_wallis(df, ["v"], "g", with_p=False).first()
    assert got["h"] == pytest.approx(h, rel=1e-12) and got["k"] == 3 and got["n"] == n


def test_spearman_pairwise_complete_brute_force(spark):
    import random
    rnd = random.Random(4)
    rows = [(None if rnd.random() < 0.1 else float(rnd.randint(0, 20)),
             None if rnd.random() < 0.1 else float(rnd.randint(0, 5))) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, y double")
    pairs = [(a, b) for a, b in rows if a is not None and b is not None]

    def midranks(vs):
        order = sorted(vs)
        pos = {}
        for i, v in enumerate(order, start=1):
            pos.setdefault(v, []).append(i)
        return [sum(pos[v]) / len(pos[v]) for v in vs]
    rx, ry = midranks([a for a, _ in pairs]), midranks([b for _, b in pairs])
    mx, my = sum(rx) / len(rx), sum(ry) / len(ry)
    cov = sum((a - mx) * (b - my) for a, b in zip(rx, ry))
    rho = cov / (sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry)) ** 0.5
    got = A.spearman_matrix(df, ["x", "y"]).first()
    assert got["n"] == len(pairs) and got["rho"] == pytest.approx(rho, abs=1e-12)
