import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from quarry.operators import regression as RG


def test_median_imputer_exact(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    m = RG.MedianImputer(inputCols=["x"]).fit(df)
    assert sorted(r.x for r in m.transform(df).collect()) == [1.0, 2.0, 2.5, 3.0, 10.0]


def test_onehot_unseen_and_null_are_all_zero(spark):
    train = spark.createDataFrame([(1.0, "a", 1.0), (2.0, "b", 2.0), (3.0, "a", 3.0)], "x double, c string, y double")
    test = spark.createDataFrame([(1.0, "zzz", 1.0), (2.0, None, 2.0)], "x double, c string, y double")
    m = RG.fit_pipeline(train, "linear", numeric=["x"], categorical=["c"], label="y")
    rows = RG.predict(m, test).select("c__ohe").collect()
    # null is imputed with the mode ("a"); an unseen category encodes as all zeros
    assert rows[0][0].toArray().tolist() == [0.0, 0.0]
    assert rows[1][0].toArray().tolist() == [1.0, 0.0]


def test_linear_matches_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(float(a), float(b), "k", float(t)) for (a, b), t in zip(x, y)],
                               "a double, b double, c string, y double")
    m = RG.fit_pipeline(df, "linear", numeric=["a", "b"], categorical=["c"], label="y")
    pred = np.array([r.prediction for r in RG.predict(m, df).collect()])
    X = np.column_stack([np.ones(200), x])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    assert np.allclose(pred, X @ beta, atol=1e-6)


def test_metrics_and_save(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "price double, prediction double")
    r = RG.regression_metrics(df).first()
    assert r["mae"] == pytest.approx(1 / 3) and r["rmse"] == pytest.approx((1 / 6) ** 0.5)
    assert r["r2"] == pytest.approx(1 - 0.5 / 2)
    train = spark.createDataFrame([(float(i), "a" if i % 2 else "b", float(2 * i)) for i in range(20)],
                                  "x double, c string, y double")
    m = RG.fit_pipeline(train, "tree", numeric=["x"], categorical=["c"], label="y")
    RG.save_model(m, str(tmp_path / "model"), ["x", "c"], spark)
    again = PipelineModel.load(str(tmp_path / "model"))
    assert again.transform(RG._to_double(train, ["x"])).count() == 20
    assert F is not None


def test_ridge_alpha_mapping_matches_closed_form(spark):
    """L5 — regParam = α·sd(y)/n on unstandardised features reproduces the ridge solution
    min ||y − Xw − b||² + α||w||² (intercept not penalised)."""
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType
    rng = np.random.default_rng(11)
    n, alpha = 300, 10.0
    x = rng.normal(size=(n, 3))
    y = 5 + x @ np.array([2.0, -1.0, 0.5]) + rng.normal(scale=0.5, size=n)
    schema = StructType([StructField("features", VectorUDT()), StructField("y", DoubleType())])
    df = spark.createDataFrame([(Vectors.dense(r.tolist()), float(t)) for r, t in zip(x, y)], schema)
    m = RG.make_regressor("ridge", "y", n=n, label_std=float(np.std(y, ddof=1)), alpha=alpha).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-4)
