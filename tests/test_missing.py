from pyspark.sql import functions as F

from quarry.operators import missing as MS


def test_injection_nulls_exact_count_per_column(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"),
                                  (F.col("id") * 2).cast("double").alias("b"))
    inj = MS.inject_nulls(df, ["a", "b"], "k", rate=0.05)
    c = inj.agg(F.count_if(F.col("a").isNull()), F.count_if(F.col("b").isNull())).first()
    assert tuple(c) == (50, 50)
    # deterministic and independent per column
    again = MS.inject_nulls(df.repartition(5), ["a", "b"], "k", rate=0.05)
    ka = {r.k for r in inj.where("a IS NULL").collect()}
    assert ka == {r.k for r in again.where("a IS NULL").collect()}
    assert ka != {r.k for r in inj.where("b IS NULL").collect()}


def test_imputation_fills_only_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0), (5, None)], "k long, x double")
    med = {r.k: r.x for r in MS.impute(df, ["x"], "median").collect()}
    assert med[5] == 2.5 and med[4] == 10.0
    mean = {r.k: r.x for r in MS.impute(df, ["x"], "mean").collect()}
    assert mean[5] == 4.0


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert [r.c for r in MS.impute(df, ["c"], "mode").collect()].count("a") == 3


def test_injection_matches_brute_force_rule(spark):
    import hashlib
    n, rate = 700, 0.07
    df = spark.range(n).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a"))
    got = {r.k for r in MS.inject_nulls(df, ["a"], "k", rate=rate).where("a IS NULL").collect()}
    h = lambda k: int(hashlib.md5(f"42|a|{k}".encode()).hexdigest()[:13], 16)
    want = {k for _, k in sorted((h(k), k) for k in range(n))[: int(n * rate)]}
    assert got == want
