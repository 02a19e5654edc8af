from pyspark.sql import functions as F

from quarry.functions import clean as C
from quarry.operators import distribution as D
from quarry.operators import filters as FL
from quarry.operators import profile as P
from quarry.operators import sampling as SM


def test_currency_cleaner(spark):
    df = spark.createDataFrame([("$1,200.00",), ("",), ("abc",), (None,)], "p string")
    got = [r[0] for r in df.select(C.currency_to_double("p")).collect()]
    assert got == [1200.0, None, None, None]


def test_date_parse_bad_to_null(spark):
    df = spark.createDataFrame([("2024-01-31",), ("bad",), (None,)], "d string")
    got = [r[0] for r in df.select(C.parse_timestamp("d")).collect()]
    assert got[0] is not None and got[1] is None and got[2] is None


def test_label_map_and_profiles(spark):
    df = spark.createDataFrame([(1,), (2,), (99,)], "c int")
    got = [r[0] for r in df.select(C.label_map("c", C.EDUCATION_LABELS)).collect()]
    assert got == ["Never attended", "Elementary", None]
    df = spark.createDataFrame([(1,), (3,), (7,), (40,)], "n int")
    assert [r[0][0] for r in df.select(C.host_profile("n")).collect()] == ["1", "2", "3", "4"]


def test_stars(spark):
    df = spark.createDataFrame([(0.0005,), (0.005,), (0.03,), (0.2,), (None,)], "p double")
    assert [r[0] for r in df.select(C.significance_stars("p")).collect()] == ["***", "**", "*", "ns", None]


def test_slice_empty_selection_and_null_preserving_range(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5.0), (3, "a", 50.0)], "id long, t string, price double")
    assert FL.slice_frame(df, {"t": []}).count() == 3
    kept = FL.slice_frame(df, {"t": ["a"]}, {"price": (0.0, 10.0)}, keep_null_ranges=["price"])
    assert [r["id"] for r in kept.collect()] == [1]


def test_histogram_counts_and_last_bin_closed(spark):
    df = spark.createDataFrame([(None if x is None else float(x),) for x in [0, 1, 2, 3, 4, 10, None]], "x double")
    h = D.histogram(df, ["x"], bins=5).collect()
    assert sum(r["n"] for r in h) == 6
    assert max(r["bin"] for r in h) == 4        # the max value falls in the last bin


def test_shares_sum_to_100(spark):
    df = spark.createDataFrame([(k % 3,) for k in range(100)], "g int")
    assert abs(sum(r["pct"] for r in P.share_by(df, ["g"]).collect()) - 100.0) < 1e-9


def test_folds_partition_rows_and_exact_sample(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    f = SM.with_folds(df, "k").groupBy("fold").count().collect()
    assert sum(r["count"] for r in f) == 1000 and {r["fold"] for r in f} == set(range(5))
    assert SM.sample_exact(df, 37, "k").count() == 37
    by_draw = [r.k for r in df.orderBy(SM.hash_draw("k"), "k").collect()]
    for n in (0, 1, 2, len(by_draw) - 1, len(by_draw), len(by_draw) + 5):
        assert sorted(r.k for r in SM.sample_exact(df, n, "k").collect()) == sorted(by_draw[:n])
    same = df.selectExpr("1 AS k").limit(9)
    assert SM.sample_exact(same, 4, "k").count() == 4 and SM.sample_exact(same.limit(0), 4, "k").count() == 0
    a = {r.k for r in SM.sample_exact(df.repartition(1), 20, "k").collect()}
    b = {r.k for r in SM.sample_exact(df.repartition(7), 20, "k").collect()}
    assert a == b
    tr, te = SM.train_test_split(df, "k")
    assert tr.count() + te.count() == 1000


def test_box_stats_whiskers(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "x double")
    b = D.box_stats(df, ["x"]).first()
    assert (b["q1"], b["median"], b["q3"]) == (3.0, 5.0, 7.0)
    assert b["whisker_hi"] == 8.0 and b["n_outliers"] == 1


def test_null_profile_only_missing(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    rows = P.null_profile(df).collect()
    assert [(r["variable"], r["nulls"], r["null_pct"]) for r in rows] == [("b", 1, 50.0)]
    assert F is not None


def test_density_integrates_to_one_and_group_edges(spark):
    import random
    rnd = random.Random(5)
    rows = [(("a" if i % 3 else "b"), rnd.expovariate(0.3)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, x double")
    h = D.histogram(df, ["x"], bins=12, density=True).collect()
    assert abs(sum(r["density"] * (r["bin_hi"] - r["bin_lo"]) for r in h) - 1.0) < 1e-9
    per = D.histogram(df, ["x"], bins=12, by=["g"], shared_edges=False).collect()
    assert sum(r["n"] for r in per) == 600 and {r["g"] for r in per} == {"a", "b"}


def test_outlier_denominators(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 100.0, None, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    nn = D.iqr_outliers(df, ["x"], denominator="non_null").first()
    allr = D.iqr_outliers(df, ["x"], denominator="rows").first()
    assert nn["n_outliers"] == allr["n_outliers"] == 1
    assert nn["pct_outliers"] == 100.0 / 8 and allr["pct_outliers"] == 100.0 / 10
