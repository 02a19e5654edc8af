"""Regression on Spark ML (L-family): leakage-free preprocessing fitted per fold, seven model
families, k-fold cross-validation with MAE / RMSE / R², tuning, hold-out evaluation, residual
aggregates, coefficient and importance tables, and model persistence.

Data never leaves the executors: every fit is a Spark ML job over the partitioned training
rows; the driver only loops over (model, fold) pairs and sees metric rows and model parameters.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.param.shared import HasInputCols, Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.boosting import BoostedTrees
from quarry.operators.ranks import quantiles
from quarry.operators.sampling import with_folds, with_split
from quarry.session import cut_lineage

# Fixed values of the study: listing features, target, ridge alphas, forest grid.
NUMERIC_FEATURES = ["latitude", "longitude", "number_of_reviews", "reviews_per_month", "availability_365"]
CATEGORICAL_FEATURES = ["neighbourhood", "room_type"]
TARGET = "price"
RIDGE_ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]
FOREST_GRID = {"numTrees": [50, 100, 200], "maxDepth": [10, 20, 30], "min_samples_split": [2, 5]}
# min_samples_split has no Spark twin; mapped onto minInstancesPerNode: 2 → 1, 5 → 2.
MIN_SPLIT_TO_MIN_INSTANCES = {2: 1, 5: 2}


# ------------------------------------------------------------------ imputer stages (L1–L3)
class _FillParams(HasInputCols):
    fills = Param(Params._dummy(), "fills", "JSON object: column -> fill value", TypeConverters.toString)


class _FillModel(Model, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """Transformer that replaces nulls by per-column constants learnt at fit time."""

    @keyword_only
    def __init__(self, inputCols=None, fills=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = json.loads(self.getOrDefault(self.fills))
        for c in self.getInputCols():
            v = fills.get(c)
            if v is not None:
                df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)))
        return df


class MedianImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Exact median imputation (unlike ``ml.feature.Imputer``, whose median is an approximate
    quantile element); numeric columns become DOUBLE."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> _FillModel:
        cols = self.getInputCols()
        df = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
        rows = quantiles(df, cols, [0.5], names=["m"]).select("variable", "m").collect()  # one row per column
        return _FillModel(inputCols=cols, fills=json.dumps({r["variable"]: r["m"] for r in rows}))


class ModeImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Most-frequent imputation; ties → smallest value (value counts + top-1 per column)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> _FillModel:
        cols = self.getInputCols()
        long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "variable", "value")
        counts = long.where(F.col("value").isNotNull()).groupBy("variable", "value").agg(F.count("*").alias("n"))
        top = counts.groupBy("variable").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("m")).collect()  # one row per column
        return _FillModel(inputCols=cols, fills=json.dumps({r["variable"]: r["m"] for r in top}))


def _to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def preprocessing_stages(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """L1/L2 — numeric: exact median impute → assemble → standardise (mean 0, sd 1);
    categorical: most-frequent impute → index (alphabetical, unseen kept) → one-hot whose dropped
    last slot is the unseen bucket, so unseen or null categories encode as all zeros.  The indexer
    gathers the categories on the driver: columns must have a bounded number of them."""
    idx = [f"{c}__idx" for c in categorical]
    ohe = [f"{c}__ohe" for c in categorical]
    nominal = [
        ModeImputer(inputCols=list(categorical)),
        StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True),
    ] if categorical else []
    return [
        MedianImputer(inputCols=list(numeric)),
        *nominal,
        VectorAssembler(inputCols=list(numeric), outputCol="num__vec", handleInvalid="keep"),
        StandardScaler(inputCol="num__vec", outputCol="num__scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["num__scaled", *ohe], outputCol="features"),
    ]


# ------------------------------------------------------------------ models (L4–L10)
def make_regressor(name: str, label: str, n: int | None = None, label_std: float | None = None,
                   **overrides):
    """The seven model families.  Ridge's α maps to Spark's ``regParam = α·sd(y)/n`` (unscaled
    features, L-BFGS), which reproduces the penalised least-squares solution; Lasso keeps α."""
    common = dict(featuresCol="features", labelCol=label, predictionCol="prediction")
    if name == "linear":
        return LinearRegression(regParam=0.0, **common)
    if name == "ridge":
        alpha = overrides.get("alpha", 1.0)
        reg = alpha * (label_std or 1.0) / max(n or 1, 1)
        return LinearRegression(elasticNetParam=0.0, regParam=reg, standardization=False, solver="l-bfgs",
                                maxIter=1000, tol=1e-9, **common)
    if name == "lasso":
        return LinearRegression(elasticNetParam=1.0, regParam=overrides.get("alpha", 1.0), standardization=False,
                                maxIter=5000, tol=1e-9, **common)
    if name == "tree":
        return DecisionTreeRegressor(maxDepth=8, seed=42, **common)
    if name == "forest":
        return RandomForestRegressor(numTrees=overrides.get("numTrees", 100), featureSubsetStrategy="all",
                                     maxDepth=overrides.get("maxDepth", 30),
                                     minInstancesPerNode=overrides.get("minInstancesPerNode", 1),
                                     seed=42, **common)
    if name == "boost_depthwise":
        return BoostedTrees(rounds=overrides.get("rounds", 100), rate=0.1, l2=1.0, maxDepth=overrides.get("maxDepth", 6), **common)
    if name == "boost_leafwise":
        return BoostedTrees(rounds=overrides.get("rounds", 100), rate=0.1, l2=0.0, maxDepth=64, minRows=20,
                            maxLeaves=overrides.get("maxLeaves", 31), **common)
    raise ValueError(f"unknown model {name!r}")


MODEL_NAMES = ["linear", "ridge", "lasso", "tree", "forest", "boost_depthwise", "boost_leafwise"]


def fit_pipeline(train: DataFrame, model: str, numeric: Sequence[str] = NUMERIC_FEATURES,
                 categorical: Sequence[str] = CATEGORICAL_FEATURES, label: str = TARGET, **overrides) -> PipelineModel:
    """L3 — preprocessing + model fitted together on ``train`` only (no leakage)."""
    n = label_std = None
    if model == "ridge":
        st = train.agg(F.count(label).alias("n"), F.stddev_samp(label).alias("sd")).first()
        n, label_std = st["n"], st["sd"]
    reg = make_regressor(model, label, n, label_std, **overrides)
    train = _to_double(train, numeric)
    return Pipeline(stages=[*preprocessing_stages(numeric, categorical), reg]).fit(train)


def predict(model: PipelineModel, df: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    return model.transform(_to_double(df, numeric))


def regression_metrics(pred: DataFrame, label: str = TARGET, prediction: str = "prediction") -> DataFrame:
    """L17 — MAE, RMSE and R² in one aggregation: ``(n, mae, rmse, r2)``; R² of a constant label is NULL."""
    e = F.col(label) - F.col(prediction)
    return pred.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                    (1 - F.try_divide(F.sum(e * e), F.count("*") * F.var_pop(label))).alias("r2"))


def prepare(df: DataFrame, key: str = "id", label: str = TARGET,
            columns: Sequence[str] = (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES),
            materialize: bool = True) -> DataFrame:
    """Valid-target rows (F10) with the R2 split and R3 folds attached, projected to the model
    columns.  Every fit makes many passes over its input (imputers, indexers, scaler, solver
    iterations), so by default the table is written once to the shared checkpoint dir and the
    lineage cut — the passes then read that table instead of re-deriving it."""
    ok = df.where(F.col(label).isNotNull() & (F.col(label) > 0)).select(key, label, *columns)
    out = with_folds(with_split(ok, key), key)
    return cut_lineage(out) if materialize else out


#: Families whose fit and score need only sums of products of the columns, and the longest row
#: (numbers, indicators of nulls and categories) whose products are summed.
MOMENT_FAMILIES, MOMENT_WIDTH = ("linear", "ridge", "lasso"), 200


def _fold_statistics(data: DataFrame, k: int, label: str, slot: Column, numeric: Sequence[str], categorical: Sequence[str]) -> dict | None:
    """What the preprocessing learns on the training rows of every fold, from scans that serve all
    folds: exact medians, means and deviations, modes and categories.  None where a fold trains on
    a column without values, or numbers are not finite.  The driver sees a row per fold, and per
    fold and category."""
    values = [*numeric, label]
    per = data.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), *[g(F.col(c).cast("double")).alias(f"{a}{i}") for i, c in enumerate(values)
                                                                          for a, g in (("n", F.count), ("avg", F.avg), ("var", F.var_pop))]).collect()
    own = {r["slot"]: r for r in per}
    wide = data.select(*[F.when(slot != f, F.col(c).cast("double")).alias(f"m{i}_{f}") for f in range(k) for i, c in enumerate(numeric)])
    medians = {r["variable"]: r["m"] for r in quantiles(wide, wide.columns, [0.5], names=["m"]).collect()} if numeric else {}
    seen = []
    if categorical:
        text = data.select(slot.alias("slot"), *[F.col(c).cast("string").alias(c) for c in categorical])
        seen = text.unpivot(["slot"], list(categorical), "variable", "value").where(F.col("value").isNotNull()).groupBy("slot", "variable", "value").agg(F.count("*").alias("n")).collect()
    folds = []
    for f in range(k):
        train = [r for s, r in own.items() if s != f]
        fold = {"n": sum(r["n"] for r in train), "median": {}, "mean": {}, "sd": {}, "mode": {}, "values": {}}
        for i, c in enumerate(numeric):
            m = medians.get(f"m{i}_{f}")
            if m is None or fold["n"] < 2:
                return None
            parts = [(r[f"n{i}"], r[f"avg{i}"], r[f"var{i}"]) for r in train if r[f"n{i}"]]
            parts.append((fold["n"] - sum(n for n, _, _ in parts), m, 0.0))             # the imputed rows
            mean = sum(n * v for n, v, _ in parts) / fold["n"]
            var = sum(n * (w + (v - mean) ** 2) for n, v, w in parts) / (fold["n"] - 1)
            if not (math.isfinite(mean) and math.isfinite(var)):
                return None
            fold["median"][c], fold["mean"][c], fold["sd"][c] = m, mean, math.sqrt(var)
        for c in categorical:
            counts = Counter()
            for r in seen:
                if r["variable"] == c and r["slot"] != f:
                    counts[r["value"]] += r["n"]
            if not counts:
                return None
            fold["values"][c] = sorted(counts)
            fold["mode"][c] = min(counts, key=lambda v: (-counts[v], v))
        folds.append(fold)
    labels = {s: (r["n"], r[f"n{len(numeric)}"], r[f"avg{len(numeric)}"], r[f"var{len(numeric)}"]) for s, r in own.items()}
    if any(n != there or not math.isfinite(avg) for n, there, avg, _ in labels.values()):
        return None
    every = {c: sorted({r["value"] for r in seen if r["variable"] == c}) for c in categorical}
    return {"folds": folds, "labels": labels, "values": every}


def _fold_features(df: DataFrame, fold: dict, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``preprocessing_stages`` with what ``_fold_statistics`` found: adds ``features``."""
    idx, ohe = [f"{c}__idx" for c in categorical], [f"{c}__ohe" for c in categorical]
    df = _FillModel(inputCols=list(numeric), fills=json.dumps(fold["median"])).transform(df)
    if categorical:
        df = _FillModel(inputCols=list(categorical), fills=json.dumps(fold["mode"])).transform(df)
        known = [fold["values"][c] for c in categorical]
        rows = [tuple(v[min(i, len(v) - 1)] for v in known) for i in range(max(map(len, known)))]     # a row per category
        names = df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` string" for c in categorical))
        df = StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc").fit(names).transform(df)
        df = OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True).fit(df).transform(df)
    scaled = {f"{c}__scaled": (F.col(c) - F.lit(fold["mean"][c])) * F.lit(1 / fold["sd"][c]) if fold["sd"][c] > 0 else F.lit(0.0) for c in numeric}
    return VectorAssembler(inputCols=[*scaled, *ohe], outputCol="features", handleInvalid="keep").transform(df.withColumns(scaled))


class _Moments:
    """Rows as vectors ``1, numbers less a centre (0 if null), their nulls, categories, their nulls``.
    Imputed, standardised and one-hot coded features of any fold are linear in them, so the sums of
    their products per fold, taken in one scan, give the exact fits of the linear family."""

    def __init__(self, stats: dict, label: str, numeric: Sequence[str], categorical: Sequence[str]):
        self.label, self.numeric, self.categorical = label, list(numeric), list(categorical)
        self.values = stats["values"]
        self.centre = {c: stats["folds"][0]["mean"][c] for c in numeric}
        n = sum(v[0] for v in stats["labels"].values())
        self.y0 = sum(v[0] * v[2] for v in stats["labels"].values()) / n
        self.at, self.width = {}, 1 + 2 * len(self.numeric)
        for c in self.categorical:
            self.at[c] = self.width
            self.width += len(self.values[c]) + 1

    def columns(self, slot: Column) -> list[Column]:
        return [slot.cast("int").alias("slot"), F.col(self.label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.numeric)],
                *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(self.categorical)]]

    def rows(self, batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.zeros((batch.num_rows, self.width))
        out[:, 0] = 1
        for i, c in enumerate(self.numeric):
            x = batch.column(f"x{i}")
            out[:, 1 + i] = x.fill_null(self.centre[c]).to_numpy(zero_copy_only=False) - self.centre[c]
            out[:, 1 + len(self.numeric) + i] = x.is_null().to_numpy(zero_copy_only=False)
        for i, c in enumerate(self.categorical):
            code = pc.index_in(batch.column(f"c{i}"), value_set=pa.array(self.values[c], pa.string())).fill_null(len(self.values[c]))
            out[np.arange(len(out)), self.at[c] + code.to_numpy(zero_copy_only=False)] = 1
        return batch.column("slot").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False) - self.y0, out

    def products(self, data: DataFrame, slot: Column) -> dict[int, np.ndarray]:
        """Per slot the sums of products of the vector with the label behind it; one scan."""
        size = self.width + 1

        def run(batches):
            total = {}
            for batch in batches:
                slots, y, x = self.rows(batch)
                both = np.column_stack([x, y])
                for s in np.unique(slots):
                    own = both[slots == s]
                    total[s] = total.get(s, 0) + own.T @ own
            for s, g in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size * size, s, np.int32)), pa.array(np.arange(size * size)), pa.array(g.ravel())], names=["slot", "i", "v"])

        found = data.select(*self.columns(slot)).mapInArrow(run, "slot int, i long, v double").groupBy("slot", "i").agg(F.sum("v").alias("v")).toArrow()
        slots, i, v = (found.column(c).to_numpy() for c in ("slot", "i", "v"))
        out = {}
        for s in np.unique(slots):
            g = np.zeros(size * size)
            g[i[slots == s]] = v[slots == s]
            out[int(s)] = g.reshape(size, size)
        return out

    def coding(self, fold: dict) -> np.ndarray:
        """The matrix that takes a row's vector to the features of a fold."""
        out, p = [], len(self.numeric)
        for i, c in enumerate(self.numeric):
            row = np.zeros(self.width)
            if fold["sd"][c] > 0:
                row[[0, 1 + i, 1 + p + i]] = self.centre[c] - fold["mean"][c], 1, fold["median"][c] - self.centre[c]
                row /= fold["sd"][c]
            out.append(row)
        for c in self.categorical:
            for v in fold["values"][c]:
                row = np.zeros(self.width)
                row[self.at[c] + self.values[c].index(v)] = 1
                if v == fold["mode"][c]:
                    row[self.at[c] + len(self.values[c])] = 1
                out.append(row)
        return np.array(out)

    def weights(self, train: np.ndarray, fold: dict, fits: Sequence[tuple[str, float]]) -> np.ndarray:
        """For each (family, alpha) the weights of the vector in the prediction, less the label's centre."""
        code, n = self.coding(fold), train[0, 0]
        mean, y = code @ train[:-1, 0] / n, train[0, -1] / n
        cov = code @ train[:-1, :-1] @ code.T / n - np.outer(mean, mean)
        with_y = code @ train[:-1, -1] / n - mean * y
        out = []
        for family, alpha in fits:
            coef = _linear_fit(cov, with_y, family, alpha, n, math.sqrt(max(train[-1, -1] / n - y * y, 0.0)))
            w = code.T @ coef
            w[0] += y - coef @ mean
            out.append(w)
        return np.array(out)

    def errors(self, data: DataFrame, slot: Column, weights: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple[int, float, float]]:
        """Per (fold, model) rows, and sums of absolute and squared errors; one scan of the held-out rows."""
        def run(batches):
            total = {}
            for batch in batches:
                slots, y, x = self.rows(batch)
                for s in np.unique(slots):
                    own = slots == s
                    e = y[own, None] - x[own] @ weights[s].T
                    total[s] = total.get(s, 0) + np.array([np.abs(e).sum(0), (e * e).sum(0), np.full(e.shape[1], len(e))])
            for s, t in total.items():
                m = t.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, s, np.int32)), pa.array(np.arange(m, dtype=np.int32)), *map(pa.array, t)], names=["slot", "m", "a", "q", "n"])

        scored = data.where(slot.isin(list(weights))).select(*self.columns(slot)).mapInArrow(run, "slot int, m int, a double, q double, n double")
        return {(r["slot"], r["m"]): (int(r["n"]), r["a"], r["q"]) for r in scored.groupBy("slot", "m").agg(*[F.sum(c).alias(c) for c in "aqn"]).collect()}


def _linear_fit(cov: np.ndarray, with_y: np.ndarray, family: str, alpha: float, n: float, sd: float) -> np.ndarray:
    """Coefficients from covariances: least squares (the shortest of standardised ones where
    features depend on each other), with ``alpha / n`` on their squares, or lasso by coordinate descent."""
    if family == "lasso":
        coef, rest, size = np.zeros(len(cov)), with_y.copy(), np.diag(cov)
        for _ in range(20_000):
            moved = 0.0
            for j in np.flatnonzero(size > 1e-14):
                old = coef[j]
                at = rest[j] + size[j] * old
                coef[j] = math.copysign(max(abs(at) - alpha, 0.0), at) / size[j]
                if coef[j] != old:
                    rest -= cov[:, j] * (coef[j] - old)
                    moved = max(moved, abs(coef[j] - old) * math.sqrt(size[j]))
            if moved <= 1e-10 * sd:
                break
        return coef
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0)) if family == "linear" else np.ones(len(cov))
    inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 1e-12)
    values, vectors = np.linalg.eigh(cov * np.outer(inverse, inverse))
    kept = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    shift = alpha / n if family == "ridge" else 0.0
    v = vectors[:, kept]
    return inverse * (v @ ((v.T @ (inverse * with_y)) / (values[kept] + shift)))


def _moment_metrics(data: DataFrame, stats: dict, specs: Mapping[str, tuple[str, float]], k: int, label: str, slot: Column,
                    numeric: Sequence[str], categorical: Sequence[str]) -> dict[tuple[str, int], tuple]:
    """``(model, fold) -> (n, mae, rmse, r2)`` of the linear family, in two scans for all folds."""
    m = _Moments(stats, label, numeric, categorical)
    sums = m.products(data, slot)
    weights = {f: m.weights(sum(g for s, g in sums.items() if s != f), stats["folds"][f], list(specs.values())) for f in range(k)}
    errors, out = m.errors(data, slot, weights), {}
    for i, name in enumerate(specs):
        for f in range(k):
            n, a, q = errors.get((f, i), (0, 0.0, 0.0))
            spread = stats["labels"][f][3] if n else 0.0
            out[name, f] = (n, a / n, math.sqrt(q / n), 1 - q / (n * spread) if spread else None) if n else (0, None, None, None)
    return out


def cross_validate(data: DataFrame, models: Sequence[str] | Mapping[str, dict], k: int = 5,
                   label: str = TARGET, fold_col: str = "fold", numeric: Sequence[str] = NUMERIC_FEATURES,
                   categorical: Sequence[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """L11 — per fold of the training split (all rows if there is no ``split`` column): fit the
    preprocessing on the other folds only, then fit every model on those features and score the
    held-out fold.  What the preprocessing learns comes from scans that serve all folds.  So do
    the fits and errors of the linear family, solved exactly from sums of products; for the other
    models the fold's feature table is cached, and released after the fold.  Returns the fold
    metric table ``(model, fold, n, mae, rmse, r2)`` (a small driver-built table)."""
    spark = data.sparkSession
    if "split" in data.columns:
        data = data.where(F.col("split") == "train")          # the hold-out rows never take part
    specs = {m: {} for m in models} if not isinstance(models, Mapping) else dict(models)
    data = data.where(F.col(fold_col).isNotNull())
    slot = F.when(F.col(fold_col).between(0, k - 1), F.col(fold_col)).otherwise(k)
    stats = _fold_statistics(data, k, label, slot, numeric, categorical)
    solved = {}
    if stats and 2 + 2 * len(numeric) + sum(len(v) + 1 for v in stats["values"].values()) <= MOMENT_WIDTH:
        by_sums = {name: (p.get("family", name), p.get("alpha", 1.0)) for name, p in specs.items() if p.get("family", name) in MOMENT_FAMILIES}
        solved = _moment_metrics(data, stats, by_sums, k, label, slot, numeric, categorical) if by_sums else {}
    rows = []
    for f in range(k):
        rest = {name: p for name, p in specs.items() if (name, f) not in solved}
        fitted = _fit_fold(data, rest, f, label, fold_col, numeric, categorical, stats and stats["folds"][f]) if rest else {}
        rows += [(name, f, *(solved[name, f] if (name, f) in solved else fitted[name])) for name in specs]
    return spark.createDataFrame(rows, "model string, fold int, n long, mae double, rmse double, r2 double")


def _fit_fold(data: DataFrame, specs: Mapping[str, dict], f: int, label: str, fold_col: str, numeric: Sequence[str],
              categorical: Sequence[str], fold: dict | None) -> dict[str, tuple]:
    """``model -> (n, mae, rmse, r2)`` of models fitted by Spark ML on all folds but ``f``."""
    tr_raw = _to_double(data.where(F.col(fold_col) != f), numeric)
    te_raw = _to_double(data.where(F.col(fold_col) == f), numeric)
    if fold:
        coded = lambda df: _fold_features(df, fold, numeric, categorical)
    else:
        coded = Pipeline(stages=preprocessing_stages(numeric, categorical)).fit(tr_raw).transform
    tr = coded(tr_raw).select("features", label).persist()
    te, out = coded(te_raw).select("features", label), {}
    try:
        n = sd = None
        if any(p.get("family", name) == "ridge" for name, p in specs.items()):
            n, sd = tr.agg(F.count(label), F.stddev_samp(label)).first()
        for name, params in specs.items():
            hp = {kk: v for kk, v in params.items() if kk != "family"}
            m = make_regressor(params.get("family", name), label, n, sd, **hp).fit(tr)
            r = regression_metrics(m.transform(te), label).first()
            out[name] = (r["n"], r["mae"], r["rmse"], r["r2"])
    finally:
        tr.unpersist()
    return out


def cv_summary(folds: DataFrame) -> DataFrame:
    """L11/L12 — mean and population std of each metric per model, sorted by mean RMSE."""
    return (folds.groupBy("model")
                 .agg(*[F.avg(m).alias(f"{m}_mean") for m in ("mae", "rmse", "r2")],
                      *[F.stddev_pop(m).alias(f"{m}_std") for m in ("mae", "rmse", "r2")])
                 .orderBy("rmse_mean", "model"))


def stability(summary: DataFrame) -> DataFrame:
    """L13 — most stable (lowest RMSE std), most variable (highest) and best (lowest RMSE)."""
    return summary.agg(F.min_by("model", F.struct("rmse_std", "model")).alias("most_stable"),
                       F.max_by("model", F.struct("rmse_std", F.lit(0))).alias("most_variable"),
                       F.min_by("model", F.struct("rmse_mean", "model")).alias("best"))


def ridge_grid(data: DataFrame, alphas: Sequence[float] = RIDGE_ALPHAS, k: int = 5, **features) -> DataFrame:
    """L14 — grid search of Ridge α by mean CV RMSE; ``features`` go to ``cross_validate``."""
    folds = cross_validate(data, {f"ridge_alpha={a:g}": {"family": "ridge", "alpha": a} for a in alphas}, k, **features)
    return cv_summary(folds)


def forest_random_search(data: DataFrame, n_iter: int = 15, seed: int = 42, k: int = 5, **features) -> DataFrame:
    """L15 — seeded sample of ``n_iter`` of the 18 forest combinations, scored by CV RMSE;
    ``features`` go to ``cross_validate``."""
    combos = [(t, dpt, s) for t in FOREST_GRID["numTrees"] for dpt in FOREST_GRID["maxDepth"]
              for s in FOREST_GRID["min_samples_split"]]
    picked = random.Random(seed).sample(combos, min(n_iter, len(combos)))
    specs = {f"forest_trees={t}_depth={dpt}_split={s}":
             {"family": "forest", "numTrees": t, "maxDepth": dpt, "minInstancesPerNode": MIN_SPLIT_TO_MIN_INSTANCES[s]}
             for t, dpt, s in picked}
    return cv_summary(cross_validate(data, specs, k, **features))


def holdout_report(data: DataFrame, model: str, cv_rmse: float | None = None, numeric: Sequence[str] = NUMERIC_FEATURES,
                   categorical: Sequence[str] = CATEGORICAL_FEATURES, **hp) -> tuple[PipelineModel, DataFrame]:
    """L16–L18 — fit on the train split, metrics on the test split, and the generalisation check
    ``|RMSE_test − RMSE_cv| / RMSE_cv < 10 %``."""
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    m = fit_pipeline(train, model, numeric, categorical, **hp)
    met = regression_metrics(predict(m, test, numeric)).withColumn("model", F.lit(model))
    if cv_rmse is not None:
        gap = F.abs(F.col("rmse") - F.lit(cv_rmse)) / F.lit(cv_rmse)
        met = met.withColumn("cv_rmse", F.lit(cv_rmse)).withColumn("generalises", gap < 0.10)
    return m, met


def residuals(pred: DataFrame, key: str = "id", label: str = TARGET) -> DataFrame:
    """L19 — residual table ``(key, actual, predicted, residual)``."""
    return pred.select(key, F.col(label).alias("actual"), F.col("prediction").alias("predicted"),
                       (F.col(label) - F.col("prediction")).alias("residual"))


def residual_bins(res: DataFrame, by: str = "predicted", bins: int = 20) -> DataFrame:
    """L19 — mean residual per equal-width bin of ``by`` (prediction, or a key for order);
    the range is a scalar subquery, the last bin is closed."""
    x = F.col(by).cast("double")
    rng = res.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = rng.getField("lo"), rng.getField("hi")
    b = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * F.lit(bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    return (res.withColumn("bin", b.cast("bigint"))
               .groupBy("bin").agg(F.count("*").alias("n"), F.avg("residual").alias("mean_residual")))


def residual_histogram(res: DataFrame, bins: int = 30) -> DataFrame:
    """L19 — equal-width histogram of the residuals with their mean beside every bin."""
    from quarry.operators.distribution import histogram
    mean = res.agg(F.avg("residual")).scalar()
    return histogram(res, ["residual"], bins).drop("variable").withColumn("mean_residual", mean)


def _feature_names(model: PipelineModel, pred: DataFrame) -> list[str]:
    """Names from the assembled vector's ML attributes; scaled numeric slots get their input
    column names back (the scaler drops them)."""
    meta = pred.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    named = sorted((a["idx"], a["name"]) for group in meta.values() for a in group)
    numeric = [s for s in model.stages if isinstance(s, VectorAssembler) and s.getOutputCol() == "num__vec"]
    num_names = numeric[0].getInputCols() if numeric else []
    out = []
    for _, n in named:
        if n.startswith("num__scaled_") and n[len("num__scaled_"):].isdigit():
            i = int(n[len("num__scaled_"):])
            n = num_names[i] if i < len(num_names) else n
        out.append(n.replace("__ohe_", "="))
    return out


def coefficient_table(model: PipelineModel, pred: DataFrame, k: int = 15) -> DataFrame:
    """L20 — top ``k`` linear coefficients by |coef| with feature names and sign."""
    spark = pred.sparkSession
    names = _feature_names(model, pred)
    coefs = model.stages[-1].coefficients.toArray().tolist()
    rows = list(zip(names or [f"f{i}" for i in range(len(coefs))], coefs))
    df = spark.createDataFrame(rows, "feature string, coef double")
    return (df.withColumn("sign", F.when(F.col("coef") >= 0, "+").otherwise("-"))
              .orderBy(F.abs("coef").desc(), "feature").limit(k))


def importance_table(model: PipelineModel, pred: DataFrame, k: int = 15) -> DataFrame:
    """L21 — top ``k`` tree-ensemble feature importances."""
    spark = pred.sparkSession
    names = _feature_names(model, pred)
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(names or [f"f{i}" for i in range(len(imp))], imp)),
                               "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(k)


def save_model(model: PipelineModel, path: str, feature_names: Sequence[str] | None = None,
               spark: SparkSession | None = None) -> None:
    """S10 — persist the fitted pipeline, and the feature list as a one-column table."""
    model.write().overwrite().save(path)
    if feature_names is not None and spark is not None:
        spark.createDataFrame([(n,) for n in feature_names], "feature string") \
             .write.mode("overwrite").parquet(path.rstrip("/") + "_features")


def executive_summary(data: DataFrame, best: str, test_metrics: DataFrame) -> DataFrame:
    """L22 — one row: sizes (scalar subquery), best model and its test metrics."""
    sizes = data.agg(F.struct(F.count("*").alias("rows"),
                              F.count_if(F.col("split") == "train").alias("train_rows"),
                              F.count_if(F.col("split") == "test").alias("test_rows"))).scalar()
    extra = [c for c in ("cv_rmse", "generalises") if c in test_metrics.columns]
    return test_metrics.select(F.lit(best).alias("best_model"), "mae", "rmse", "r2", *extra,
                               sizes.getField("rows").alias("rows"),
                               sizes.getField("train_rows").alias("train_rows"),
                               sizes.getField("test_rows").alias("test_rows"))

