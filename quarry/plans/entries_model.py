"""Catalogue entries: regression (L-family).  Model outputs have no SQL twin (rows-only check);
the metric aggregation itself is oracle-checked on a fixed prediction rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import regression as RG
from quarry.plans.catalog import R, register
from quarry.sources import views as V

L = ("v_listings",)
LINEAR_FAMILY = ["linear", "ridge", "lasso"]


def _data(spark, d):
    return RG.prepare(V.listings(spark, d))


def _cv_linear(spark, d):
    """Fold metrics of the linear family on the training split (15 small rows)."""
    return RG.cross_validate(_data(spark, d), LINEAR_FAMILY, 5)


@register("listings_regression_cv_linear")
def q_listings_regression_cv_linear(spark, d):
    """L4–L6, L11, L12 — 5-fold CV of the linear family: mean and population std of each metric."""
    return RG.cv_summary(_cv_linear(spark, d))


@register("listings_regression_cv_tree")
def q_listings_regression_cv_tree(spark, d):
    """L7, L11 — 5-fold CV of the depth-8 tree."""
    return RG.cv_summary(RG.cross_validate(_data(spark, d), ["tree"], 5))


@register("listings_model_stability")
def q_listings_model_stability(spark, d):
    """L13 — most stable / most variable / best model over the linear-family CV."""
    return RG.stability(RG.cv_summary(_cv_linear(spark, d)))


@register("listings_ridge_grid")
def q_listings_ridge_grid(spark, d):
    """L14 — Ridge α grid {0.01 … 1000} scored by mean 5-fold CV RMSE."""
    return RG.ridge_grid(_data(spark, d))


@register("listings_regression_holdout")
def q_listings_regression_holdout(spark, d):
    """L16–L18, L22 — best linear-family model by CV RMSE, refit on train, scored on test."""
    data = _data(spark, d)
    summary = RG.cv_summary(RG.cross_validate(data, LINEAR_FAMILY, 5))
    best = summary.first()                       # lowest mean RMSE (one metric row)
    _, met = RG.holdout_report(data, best["model"], cv_rmse=best["rmse_mean"])
    return RG.executive_summary(data, best["model"], met)


@register("listings_linear_coefficients")
def q_listings_linear_coefficients(spark, d):
    """L20 — top 15 coefficients of the linear model by |coef|."""
    data = _data(spark, d)
    m = RG.fit_pipeline(data.where(F.col("split") == "train"), "linear")
    return RG.coefficient_table(m, RG.predict(m, data.where(F.col("split") == "test")))


@register("listings_tree_importances")
def q_listings_tree_importances(spark, d):
    """L21 — top 15 feature importances of a fitted tree model."""
    data = _data(spark, d)
    m = RG.fit_pipeline(data.where(F.col("split") == "train"), "tree")
    return RG.importance_table(m, RG.predict(m, data.where(F.col("split") == "test")))


@register("listings_residual_bins")
def q_listings_residual_bins(spark, d):
    """L19 — mean residual by bins of the prediction, hold-out linear model."""
    data = _data(spark, d)
    m = RG.fit_pipeline(data.where(F.col("split") == "train"), "linear")
    res = RG.residuals(RG.predict(m, data.where(F.col("split") == "test")))
    return RG.residual_bins(res, "predicted", 20)


# One-feature twins: the same operators on one null-free feature, where every model of the linear
# family has a closed form that SQL can state.  With z the standardised feature, Szz = n - 1 and
# Szy = Sxy / sd: linear Szy / Szz, ridge Szy / (Szz + alpha), lasso soft(Szy / n, alpha) / (Szz / n).
ONE = {"numeric": ["availability_365"], "categorical": []}
DIGITS = 3
_BITS = "CAST(('0x' || substr(md5('42|{}' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT)"
_ROWS = (f"r AS (SELECT id, CAST(price AS DOUBLE) AS y, CAST(availability_365 AS DOUBLE) AS x, "
         f"CASE WHEN {_BITS.format('')} % 100 < 70 THEN 'train' ELSE 'test' END AS split, {_BITS.format('fold|')} % 5 AS fold "
         "FROM v_listings WHERE price IS NOT NULL AND price > 0)")
_BETA = {"linear": "szy / szz", "ridge": "szy / (szz + 1)",
         "lasso": "sign(szy) * greatest(abs(szy) / n - 1, 0) / (szz / n)"}
_SCORE = ("COUNT(*) AS n, AVG(abs(y - p)) AS mae, sqrt(AVG((y - p) * (y - p))) AS rmse, "
          "1 - SUM((y - p) * (y - p)) / (COUNT(*) * var_pop(y)) AS r2")
_FIT = ("COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my, stddev_samp(x) AS sd, CAST(COUNT(*) - 1 AS DOUBLE) AS szz, "
        "regr_sxy(y, x) / stddev_samp(x) AS szy")


def _cv_sql(betas):
    """CTEs: rows, the fit without each fold, fold metrics of each model, their summary."""
    models = " UNION ALL ".join(f"SELECT '{m}' AS model, f, mx, my, sd, {b} AS beta FROM fit" for m, b in betas.items())
    return (f"WITH {_ROWS}, fit AS (SELECT f, {_FIT} FROM r, range(5) AS t(f) WHERE split = 'train' AND fold <> f GROUP BY f), "
            f"b AS ({models}), s AS (SELECT model, f, {_SCORE} FROM (SELECT model, f, y, my + beta * (x - mx) / sd AS p "
            "FROM b JOIN r ON r.split = 'train' AND r.fold = b.f) GROUP BY model, f), "
            "c AS (SELECT model, " + ", ".join(f"AVG({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in ("mae", "rmse", "r2"))
            + " FROM s GROUP BY model) ")


_SUMMARY = "SELECT model, " + ", ".join(R(f"{m}_{k}", f"{m}_{k}", DIGITS) for m in ("mae", "rmse", "r2") for k in ("mean", "std")) + " FROM c"
_CV_ONE = _cv_sql(_BETA)


def _rounded(df):
    return df.select(*[F.round(c, DIGITS).alias(c) if t == "double" else c for c, t in df.dtypes])


def _cv_one(spark, d):
    return RG.cross_validate(_data(spark, d), LINEAR_FAMILY, 5, **ONE)


@register("listings_cv_one_feature", _CV_ONE + _SUMMARY, L)
def q_listings_cv_one_feature(spark, d):
    """L3–L6, L11, L12 — 5-fold CV of linear, ridge and lasso on the training split."""
    return _rounded(RG.cv_summary(_cv_one(spark, d)))


@register("listings_cv_one_feature_rows", f"WITH {_ROWS} SELECT m.model, COUNT(*) AS n FROM r, (VALUES ('linear')) AS m(model) "
          "WHERE split = 'train' GROUP BY 1", L)
def q_listings_cv_one_feature_rows(spark, d):
    """L11 — rows scored over all folds: those of the training split, each once."""
    return RG.cross_validate(_data(spark, d), ["linear"], 5, **ONE).groupBy("model").agg(F.sum("n").alias("n"))


@register("listings_stability_one_feature", _CV_ONE + "SELECT (SELECT model FROM c ORDER BY rmse_std, model LIMIT 1) AS most_stable, "
          "(SELECT model FROM c ORDER BY rmse_std DESC LIMIT 1) AS most_variable, "
          "(SELECT model FROM c ORDER BY rmse_mean, model LIMIT 1) AS best", L)
def q_listings_stability_one_feature(spark, d):
    """L13 — most stable, most variable and best model."""
    return RG.stability(RG.cv_summary(_cv_one(spark, d)))


@register("listings_ridge_grid_one_feature",
          _cv_sql({f"ridge_alpha={a:g}": f"szy / (szz + {a})" for a in RG.RIDGE_ALPHAS}) + _SUMMARY, L)
def q_listings_ridge_grid_one_feature(spark, d):
    """L14 — Ridge α grid by mean CV RMSE."""
    return _rounded(RG.ridge_grid(_data(spark, d), **ONE))


_HOLD = (f"WITH {_ROWS}, fit AS (SELECT {_FIT} FROM r WHERE split = 'train'), "
         "p AS (SELECT id, y, my + szy / szz * (x - mx) / sd AS p FROM r, fit WHERE split = 'test') ")


@register("listings_holdout_one_feature", _cv_sql({"linear": _BETA["linear"]}) + ", h AS (SELECT "
          f"{_FIT} FROM r WHERE split = 'train'), m AS (SELECT {_SCORE} FROM (SELECT y, my + szy / szz * (x - mx) / sd AS p "
          "FROM r, h WHERE split = 'test')) SELECT 'linear' AS best_model, "
          + ", ".join(R(c, c, DIGITS) for c in ("mae", "rmse", "r2")) + f", {R('rmse_mean', 'cv_rmse', DIGITS)}, "
          "CAST(abs(rmse - rmse_mean) / rmse_mean < 0.10 AS BIGINT) AS generalises, (SELECT COUNT(*) FROM r) AS rows, "
          "(SELECT COUNT(*) FROM r WHERE split = 'train') AS train_rows, (SELECT COUNT(*) FROM r WHERE split = 'test') AS test_rows FROM m, c", L)
def q_listings_holdout_one_feature(spark, d):
    """L16–L18, L22 — fit on train, score on test, compare with the CV error, sum up."""
    data = _data(spark, d)
    cv = RG.cv_summary(RG.cross_validate(data, ["linear"], 5, **ONE)).first()["rmse_mean"]
    _, met = RG.holdout_report(data, "linear", cv_rmse=cv, **ONE)
    return _rounded(RG.executive_summary(data, "linear", met))


def _one_residuals(spark, d):
    data = _data(spark, d)
    m = RG.fit_pipeline(data.where(F.col("split") == "train"), "linear", **ONE)
    return RG.residuals(RG.predict(m, data.where(F.col("split") == "test"), ONE["numeric"]))


@register("listings_residuals_one_feature", _HOLD + f"SELECT id, {R('y', 'actual', DIGITS)}, {R('p', 'predicted', DIGITS)}, "
          f"{R('y - p', 'residual', DIGITS)} FROM p", L)
def q_listings_residuals_one_feature(spark, d):
    """L19 — residual table of the hold-out."""
    return _rounded(_one_residuals(spark, d))


@register("listings_residual_order_bins", _HOLD + ", q AS (SELECT id, y - p AS e, min(id) OVER () AS lo, max(id) OVER () AS hi FROM p) "
          "SELECT least(CAST(floor((CAST(id AS DOUBLE) - lo) / CAST(hi - lo AS DOUBLE) * 20) AS BIGINT), 19) AS bin, COUNT(*) AS n, "
          f"{R('AVG(e)', 'mean_residual', DIGITS)} FROM q GROUP BY 1", L)
def q_listings_residual_order_bins(spark, d):
    """L19 — mean residual against the order of the keys."""
    return _rounded(RG.residual_bins(_one_residuals(spark, d), "id", 20))


@register("listings_residual_histogram", _HOLD + ", q AS (SELECT y - p AS e FROM p), m AS (SELECT min(e) AS lo, max(e) AS hi, AVG(e) AS a FROM q) "
          f"SELECT least(CAST(floor((e - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin, COUNT(*) AS n, {R('any_value(a)', 'mean_residual', DIGITS)} "
          "FROM q, m GROUP BY 1", L)
def q_listings_residual_histogram(spark, d):
    """L19 — histogram of the residuals with their mean."""
    return _rounded(RG.residual_histogram(_one_residuals(spark, d), 20).select("bin", "n", "mean_residual"))


@register("listings_coefficient_one_feature", f"WITH {_ROWS}, fit AS (SELECT {_FIT} FROM r WHERE split = 'train') SELECT 'availability_365' AS feature, "
          f"{R('szy / szz', 'coef', DIGITS)}, CASE WHEN szy >= 0 THEN '+' ELSE '-' END AS sign FROM fit", L)
def q_listings_coefficient_one_feature(spark, d):
    """L4, L20 — the coefficient of the standardised feature, with name and sign."""
    data = _data(spark, d)
    m = RG.fit_pipeline(data.where(F.col("split") == "train"), "linear", **ONE)
    return _rounded(RG.coefficient_table(m, RG.predict(m, data, ONE["numeric"])))


@register("listings_boosting_holdout")
def q_listings_boosting_holdout(spark, d):
    """L9, L10, L17 — five rounds of depth-wise and of leaf-wise boosting on train, scored on test."""
    data = _data(spark, d)
    depth, leaf = (RG.holdout_report(data, m, rounds=5)[1] for m in ("boost_depthwise", "boost_leafwise"))
    return depth.unionByName(leaf).select("model", "n", "mae", "rmse", "r2")


# One round and one split on a feature of few values, whose cuts are all its values: SQL can try each.
STUMP = {"numeric": ["number_of_reviews"], "categorical": []}


def _stump_sql(model, l2):
    """The best cut by gain of squared gradient sums, and the test rows' predictions from it."""
    return (f"{model}_c AS (SELECT DISTINCT x AS cut FROM t WHERE x < (SELECT max(x) FROM t)), "
            f"{model}_s AS (SELECT cut, SUM(m - y) FILTER (x <= cut) AS gl, COUNT(*) FILTER (x <= cut) AS nl, "
            f"SUM(m - y) FILTER (x > cut) AS gr, COUNT(*) FILTER (x > cut) AS nr FROM t, {model}_c GROUP BY cut), "
            f"{model}_b AS (SELECT * FROM {model}_s ORDER BY gl * gl / (nl + {l2}) + gr * gr / (nr + {l2}) DESC, cut LIMIT 1), "
            f"{model}_p AS (SELECT '{model}' AS model, y, m - 0.1 * CASE WHEN x <= cut THEN gl / (nl + {l2}) ELSE gr / (nr + {l2}) END AS p "
            f"FROM r, (SELECT any_value(m) AS m FROM t), {model}_b WHERE split = 'test')")


@register("listings_boosted_stumps", f"WITH {_ROWS.replace('availability_365', 'number_of_reviews')}, "
          "t AS (SELECT x, y, AVG(y) OVER () AS m FROM r WHERE split = 'train'), "
          + _stump_sql("boost_depthwise", 1) + ", " + _stump_sql("boost_leafwise", 0)
          + ", s AS (SELECT model, " + _SCORE + " FROM (FROM boost_depthwise_p UNION ALL FROM boost_leafwise_p) GROUP BY model) "
          "SELECT model, n, " + ", ".join(R(c, c, DIGITS) for c in ("mae", "rmse", "r2")) + " FROM s", L)
def q_listings_boosted_stumps(spark, d):
    """L9, L10 — one round of one split on one feature, with and without the L2 term."""
    data = _data(spark, d)
    depth = RG.holdout_report(data, "boost_depthwise", rounds=1, maxDepth=1, **STUMP)[1]
    leaf = RG.holdout_report(data, "boost_leafwise", rounds=1, maxLeaves=2, **STUMP)[1]
    return _rounded(depth.unionByName(leaf).select("model", "n", "mae", "rmse", "r2"))


_DRAW = "CAST(('0x' || substr(md5('42|' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 100"


@register("listings_baseline_holdout_metrics",
          f"WITH d AS (SELECT *, CASE WHEN {_DRAW} < 70 THEN 'train' ELSE 'test' END AS split FROM v_listings "
          "WHERE price IS NOT NULL AND price > 0), "
          "m AS (SELECT room_type, AVG(price) AS prediction FROM d WHERE split = 'train' GROUP BY room_type), "
          "p AS (SELECT d.price, m.prediction FROM d JOIN m ON d.room_type = m.room_type WHERE d.split = 'test') "
          f"SELECT COUNT(*) AS n, {R('AVG(abs(price - prediction))', 'mae')}, "
          f"{R('sqrt(AVG((price - prediction) * (price - prediction)))', 'rmse')}, "
          f"{R('1 - SUM((price - prediction) * (price - prediction)) / (COUNT(*) * var_pop(price))', 'r2')} FROM p", L)
def q_listings_baseline_holdout_metrics(spark, d):
    """L17 — hold-out MAE / RMSE / R² of a fixed rule (train mean price per room type)."""
    data = _data(spark, d)
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    rule = train.groupBy("room_type").agg(F.avg("price").alias("prediction"))
    return RG.regression_metrics(test.join(rule, "room_type"))
