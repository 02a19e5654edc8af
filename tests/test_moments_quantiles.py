import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.operators.ranks import quantiles, rank_table, with_midrank


def _df(spark, xs, name="x"):
    return spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], f"k long, {name} double")


def test_bias_corrected_moments_and_quartiles(spark):
    d = P.describe(_df(spark, [1, 2, 2, 3, 10, 50]), ["x"]).first()
    assert d["skew"] == pytest.approx(2.3022814009, abs=1e-9)
    assert d["kurtosis"] == pytest.approx(5.3739375610, abs=1e-9)
    assert d["std"] == pytest.approx(19.2215157224, abs=1e-9)
    assert d["q1"] == 2.0 and d["median"] == 2.5


def test_even_count_median_and_quartiles(spark):
    d = P.describe(_df(spark, [1, 2, 3, 10]), ["x"]).first()
    assert (d["median"], d["q1"], d["q3"]) == (2.5, 1.75, 4.75)


def test_all_null_column_profile(spark):
    d = P.describe(_df(spark, [None, None, None]), ["x"]).first()
    assert d["count"] == 0 and d["nulls"] == 3 and d["null_pct"] == 100.0
    assert d["mean"] is None and d["median"] is None


@pytest.mark.parametrize("buckets", [1, 3, 256])
def test_quantiles_match_numpy_for_any_bucketing(spark, buckets):
    rng = np.random.default_rng(7)
    xs = np.round(rng.exponential(3.0, 500), 1).tolist()       # many ties
    got = quantiles(_df(spark, xs), ["x"], [0.1, 0.25, 0.5, 0.9, 1.0], buckets=buckets).first()
    for name, p in zip(["q100", "q250", "q500", "q900", "q1000"], [0.1, 0.25, 0.5, 0.9, 1.0]):
        assert got[name] == pytest.approx(float(np.quantile(xs, p)), abs=1e-12)


def test_midranks_with_ties_and_rank_sum(spark):
    xs = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    df = _df(spark, xs)
    r = {row["x"]: row["x_rank"] for row in with_midrank(df, "x").collect()}
    assert r[1.0] == 1.5 and r[5.0] == 8.0 and r[9.0] == 11.0
    rt = rank_table(df, ["x"], buckets=4)
    total = rt.agg(F.sum(F.col("rank") * F.col("cnt"))).first()[0]
    n = len(xs)
    assert total == n * (n + 1) / 2


def test_result_independent_of_partitioning(spark):
    df = _df(spark, list(range(200)) * 2)
    a = quantiles(df.repartition(1), ["x"], [0.37]).first()[-1]
    b = quantiles(df.repartition(13), ["x"], [0.37]).first()[-1]
    assert a == b == pytest.approx(float(np.quantile(list(range(200)) * 2, 0.37)))


def test_approx_quantiles_and_distinct_opt_ins(spark):
    xs = list(range(1, 1001))
    df = _df(spark, xs)
    q = quantiles(df, ["x"], [0.5], names=["m"], approx=True).first()
    assert abs(q["m"] - 500.5) <= 1.0 and q["n"] == 1000
    prof = {r["variable"]: r for r in P.column_profile(df, "k", ["x"], approx_distinct=True).collect()}
    assert abs(prof["x"]["distinct"] - 1000) <= 150          # 3 sigma at the default 5 % rsd


def test_hot_group_exact_medians_with_forced_buckets(spark):
    """One group holds a third of the rows; grouped exact quantiles must still equal numpy's,
    whether the rank pass uses one bucket or many range buckets."""
    rng = np.random.default_rng(21)
    rows = [("hot", float(v)) for v in np.round(rng.normal(50, 10, 900), 2)]
    rows += [(f"g{i % 40}", float(v)) for i, v in enumerate(np.round(rng.exponential(5, 1800), 2))]
    df = spark.createDataFrame(rows, "g string, x double")
    expect = {}
    for g, v in rows:
        expect.setdefault(g, []).append(v)
    for buckets in (1, 7):
        got = {r["g"]: r["q500"] for r in quantiles(df, ["x"], [0.5], by=["g"], buckets=buckets).collect()}
        assert set(got) == set(expect)
        for g, vs in expect.items():
            assert got[g] == pytest.approx(float(np.median(vs)), abs=1e-9)
