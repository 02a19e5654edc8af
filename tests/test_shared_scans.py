"""Steps that serve many folds, pairs, groups or columns at once: same results, bounded work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import association as A
from quarry.operators import boosting as B
from quarry.operators import knn
from quarry.operators import missing as MS
from quarry.operators import regression as RG


def test_linear_family_of_all_folds_shares_its_scans(spark):
    rng = np.random.default_rng(3)
    n = 400
    x, g, fold = rng.normal(5, 2, n), rng.integers(0, 3, n), rng.integers(0, 4, n)
    y = 3 * x + np.array([1.0, -2.0, 4.0])[g] + rng.normal(0, 1, n)
    there = rng.random(n) > 0.1
    rows = [(float(a) if ok else None, "abc"[b], int(f), float(c)) for a, ok, b, f, c in zip(x, there, g, fold, y)]
    df = spark.createDataFrame(rows, "x double, g string, fold int, price double").cache()
    sc = spark.sparkContext
    sc.setJobGroup("shared-folds", "cross_validate")
    got = {(r["model"], r["fold"]): r for r in RG.cross_validate(df, ["linear", "ridge", "lasso"], 4, numeric=["x"], categorical=["g"]).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("shared-folds"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 50
    for f in range(4):
        tr = fold != f
        filled = np.where(there, x, np.median(x[tr & there]))
        z = (filled - filled[tr].mean()) / filled[tr].std(ddof=1)
        feats = np.column_stack([z, *(g == v for v in range(3))])
        mean, my = feats[tr].mean(0), y[tr].mean()
        c = feats[tr] - mean
        for model, shift in (("linear", 0.0), ("ridge", 1.0)):
            beta = np.linalg.pinv(c.T @ c + shift * np.eye(4), rcond=1e-12) @ (c.T @ (y[tr] - my))
            e = y[~tr] - my - (feats[~tr] - mean) @ beta
            r = got[model, f]
            assert r["n"] == len(e)
            assert r["mae"] == pytest.approx(np.abs(e).mean(), rel=1e-9)
            assert r["rmse"] == pytest.approx(np.sqrt((e * e).mean()), rel=1e-9)
            assert r["r2"] == pytest.approx(1 - (e * e).sum() / ((y[~tr] - y[~tr].mean()) ** 2).sum(), rel=1e-9)
        assert got["lasso", f]["rmse"] >= 0


def test_spearman_with_nulls_sends_no_row_by_a_frequent_value(spark):
    rng = np.random.default_rng(5)
    n = 300
    cols = {"a": rng.integers(0, 2, n).astype(float), "b": rng.normal(size=n), "c": rng.integers(0, 5, n).astype(float)}
    gone = {"b": rng.random(n) < 0.2, "c": rng.random(n) < 0.1}
    rows = [tuple(None if c in gone and gone[c][i] else float(cols[c][i]) for c in "abc") for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = A.spearman_matrix(df, ["a", "b", "c"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r["var_x"], r["var_y"]): r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 3

    def ranks(v):
        return np.array([(v < w).sum() + ((v == w).sum() + 1) / 2 for w in v])
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        ok = ~gone.get(a, np.zeros(n, bool)) & ~gone.get(b, np.zeros(n, bool))
        assert got[a, b]["n"] == ok.sum()
        assert got[a, b]["rho"] == pytest.approx(np.corrcoef(ranks(cols[a][ok]), ranks(cols[b][ok]))[0, 1], abs=1e-12)


def test_null_injection_derives_its_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v
    once = F.udf(count, "double").asNondeterministic()
    df = spark.range(200).select(F.col("id").alias("k"), once(F.col("id").cast("double")).alias("a"))
    inj = MS.inject_nulls(df, ["a"], "k", 0.1)
    assert inj.where("a IS NULL").count() == 20
    assert inj.agg(F.count("a")).first()[0] == 180
    assert seen.value == 200


def test_donors_of_one_point_are_cut_before_they_are_dealt(spark, monkeypatch):
    rows = [(i, 1.0, 2.0, 3.0) for i in range(500)] + [(900, 9.0, 9.0, 9.0), (1000, None, 2.0, 3.0), (1001, 9.0, None, 9.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    plans, cut = [], knn.cut_lineage
    monkeypatch.setattr(knn, "cut_lineage", lambda d: (plans.append(d._jdf.queryExecution().analyzed().toString()), cut(d))[1])
    got = {(r["key"], r["variable"]): r["value"] for r in knn.knn_fills(df, ["a", "b", "c"], "k", 3).collect()}
    assert got[1000, "a"] == 1.0 and got[1001, "b"] == pytest.approx((9.0 + 2.0 + 2.0) / 3)
    assert plans[1].count("row_number(") >= 2 and "pattern" in plans[1]


def test_sums_of_narrow_and_wide_features_match_plain_ones(spark):
    rng = np.random.default_rng(7)
    n, cuts = 500, [[0.0], [1.0, 2.0, 3.0], [0.5], []]
    bins = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 4, n), rng.integers(0, 2, n), np.zeros(n)]).astype(np.uint8)
    y, pred = rng.normal(size=n), np.zeros(n)
    state = spark.createDataFrame([(bytearray(b.tobytes()), float(v), 0.0) for b, v in zip(bins, y)], "bins binary, y double, pred double").repartition(3)
    shape = {"feature": [1, -1, -1], "cut": [1, 0, 0], "left": [1, -1, -1], "right": [2, -1, -1]}
    node = np.where(bins[:, 1] <= 1, 1, 2)
    for i, (grad, count) in zip([2, 1], B._sums(state, [], cuts)([2, 1], shape)):
        for j in range(4):
            for b in range(4):
                at = (node == i) & (bins[:, j] == b)
                assert count[j, b] == at.sum()
                assert grad[j, b] == pytest.approx((pred - y)[at].sum(), abs=1e-9)
