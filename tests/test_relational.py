from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.operators import relational as RL


def test_top_k_breaks_ties_on_key(spark):
    df = spark.createDataFrame([(3, 10.0), (1, 10.0), (2, 5.0), (4, -20.0)], "id long, v double")
    assert [r.id for r in RL.top_k(df, [F.col("v").desc()], 2, ["id"]).collect()] == [1, 3]
    assert [r.id for r in RL.top_k_abs(df, "v", 1, ["id"]).collect()] == [4]


def test_arg_best_and_stack(spark):
    m = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 2.0)], "model string, rmse double")
    best = RL.arg_best(m, "model", "rmse").first()
    assert (best.model, best.rmse) == ("b", 1.0)
    worst = RL.arg_best(m, "model", "rmse", lowest=False).first()
    assert worst.model == "a"
    s = RL.stack_labelled([("x", m.limit(1)), ("y", m)], "method")
    assert s.groupBy("method").count().orderBy("method").collect()[1]["count"] == 3


def test_transpose_row(spark):
    row = spark.createDataFrame([(5, 2.5)], "n long, mean double")
    got = {r.metric: r.value for r in P.transpose_row(row).collect()}
    assert got == {"n": 5.0, "mean": 2.5}
