"""Catalogue entries: null injection and imputation (M-family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import knn as KN
from quarry.operators import missing as MS
from quarry.operators import profile as P
from quarry.plans.catalog import R, register
from quarry.sources import views as V

L, DOC = ("v_listings",), ("v_docs",)

INJECT_COLS = ["minimum_nights", "availability_365", "reviews_per_month"]
RATE = 0.05


def _h(var: str) -> str:
    return f"CAST(('0x' || substr(md5('42|{var}|' || CAST(id AS VARCHAR)), 1, 13)) AS BIGINT)"


_K = f"(SELECT CAST(floor(COUNT(*) * {RATE}) AS BIGINT) FROM v_listings)"
_INJ = ("inj AS (SELECT id, " + ", ".join(
    f"CASE WHEN row_number() OVER (ORDER BY {_h(c)}, id) <= {_K} THEN NULL ELSE {c} END AS {c}" for c in INJECT_COLS)
    + " FROM v_listings)")


@register("listings_injected_nulls",
          f"WITH {_INJ} " + " UNION ALL ".join(
              f"SELECT '{c}' AS variable, COUNT(*) AS nulls, SUM(id) AS id_sum FROM inj WHERE {c} IS NULL"
              for c in INJECT_COLS), L)
def q_listings_injected_nulls(spark, d):
    """M1 — which rows were nulled (count and id checksum per variable)."""
    inj = MS.inject_nulls(V.listings(spark, d).select("id", *INJECT_COLS), INJECT_COLS, "id", RATE)
    # one pass: per column, null count and id checksum, then stacked to rows
    row = inj.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in INJECT_COLS],
                  *[F.sum(F.when(F.col(c).isNull(), F.col("id"))).alias(f"s_{c}") for c in INJECT_COLS])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"n_{c}").alias("nulls"),
                                                  F.col(f"s_{c}").alias("id_sum")) for c in INJECT_COLS])))


@register("listings_null_rate_after_injection",
          f"WITH {_INJ} " + " UNION ALL ".join(
              f"SELECT '{c}' AS variable, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls, "
              + R(f"COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*)", "null_pct") + " FROM inj"
              for c in INJECT_COLS), L)
def q_listings_null_rate_after_injection(spark, d):
    """M8 — null rate per variable after injection."""
    inj = MS.inject_nulls(V.listings(spark, d).select("id", *INJECT_COLS), INJECT_COLS, "id", RATE)
    return P.null_profile(inj, INJECT_COLS, only_missing=False)


def _summary_sql(src: str, method: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{method}' AS method, '{c}' AS variable, {R(f'AVG({c})', 'mean')}, "
        f"{R(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 'median')}, {R(f'stddev_samp({c})', 'std')}, "
        f"COUNT(*) - COUNT({c}) AS nulls FROM {src}" for c in INJECT_COLS)


_FILL = {"mean": "AVG({c})", "median": "quantile_cont(CAST({c} AS DOUBLE), 0.5)"}
_IMPUTED = ", ".join(
    f"{m} AS (SELECT " + ", ".join(
        f"COALESCE(CAST({c} AS DOUBLE), CAST((SELECT {_FILL[m].format(c=c)} FROM inj) AS DOUBLE)) AS {c}"
        for c in INJECT_COLS) + " FROM inj)"
    for m in _FILL)


@register("listings_imputation_comparison",
          f"WITH {_INJ}, {_IMPUTED} " + " UNION ALL ".join(
              [_summary_sql("v_listings", "original"), _summary_sql("inj", "with_nulls"),
               _summary_sql("mean", "mean"), _summary_sql("median", "median")]), L)
def q_listings_imputation_comparison(spark, d):
    """M2/M3/M6/M7 — mean and median imputation of injected nulls, before/after statistics."""
    v = V.listings(spark, d).select("id", *INJECT_COLS)
    # the injected table has four consumers: inject_nulls writes it once, its cut-offs are constants
    inj = MS.inject_nulls(v, INJECT_COLS, "id", RATE)
    frames = [("original", v), ("with_nulls", inj), ("mean", MS.impute(inj, INJECT_COLS, "mean")),
              ("median", MS.impute(inj, INJECT_COLS, "median"))]
    return MS.compare_imputations(frames, INJECT_COLS).select("method", "variable", "mean", "median", "std", "nulls")


_MODE = ("(SELECT {c} FROM v_docs WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)")


@register("docs_mode_imputation",
          " UNION ALL ".join(
              f"SELECT '{c}' AS variable, CAST(COALESCE({c}, {_MODE.format(c=c)}) AS VARCHAR) AS value, COUNT(*) AS n "
              f"FROM v_docs GROUP BY value" for c in ["quality", "toxic", "lang"]), DOC)
def q_docs_mode_imputation(spark, d):
    """M4 — most-frequent imputation (ties → smallest value); value counts afterwards."""
    cols = ["quality", "toxic", "lang"]
    imp = MS.impute(V.docs(spark, d), cols, "mode")
    long = imp.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "variable", "value")
    return long.groupBy("variable", "value").agg(F.count("*").alias("n"))


_METHODS_SQL = ("(SELECT 'with_nulls' AS method, CAST(availability_365 AS DOUBLE) AS availability_365 FROM inj "
                "UNION ALL SELECT 'mean' AS method, availability_365 FROM mean "
                "UNION ALL SELECT 'median' AS method, availability_365 FROM median)")


def _d9_sql():
    from quarry.plans.entries_profile import _hist_sql
    return f"WITH {_INJ}, {_IMPUTED} " + _hist_sql(_METHODS_SQL, ["availability_365"], 20, by=["method"])


@register("listings_imputation_histograms", _d9_sql(), L)
def q_listings_imputation_histograms(spark, d):
    """D9 — overlaid histograms of one variable before / after each imputation method, on shared
    edges (U1 stacking of the labelled frames, then D1 by method)."""
    from quarry.operators.distribution import histogram
    from quarry.operators.relational import stack_labelled
    v = V.listings(spark, d).select("id", *INJECT_COLS)
    inj = MS.inject_nulls(v, INJECT_COLS, "id", RATE)
    frames = [("with_nulls", inj.select(F.col("availability_365").cast("double").alias("availability_365"))),
              ("mean", MS.impute(inj, INJECT_COLS, "mean").select("availability_365")),
              ("median", MS.impute(inj, INJECT_COLS, "median").select("availability_365"))]
    return histogram(stack_labelled(frames, "method"), ["availability_365"], 20, by=["method"])


def _knn_sql(k: int = 5) -> str:
    p = len(INJECT_COLS)
    both = {c: f"r.{c} IS NOT NULL AND d.{c} IS NOT NULL" for c in INJECT_COLS}
    squares = " + ".join(f"CASE WHEN {both[c]} THEN (CAST(r.{c} AS DOUBLE) - CAST(d.{c} AS DOUBLE)) * (CAST(r.{c} AS DOUBLE) - CAST(d.{c} AS DOUBLE)) ELSE 0 END" for c in INJECT_COLS)
    common = " + ".join(f"CASE WHEN {both[c]} THEN 1 ELSE 0 END" for c in INJECT_COLS)
    one = (f"SELECT id, '{{c}}' AS variable, AVG(value) AS value FROM (SELECT r.id, CAST(d.{{c}} AS DOUBLE) AS value, "
           f"row_number() OVER (PARTITION BY r.id ORDER BY ({squares}) * (CAST({p} AS DOUBLE) / ({common})), d.id) AS n "
           f"FROM inj r JOIN inj d ON r.{{c}} IS NULL AND d.{{c}} IS NOT NULL AND ({common}) > 0) WHERE n <= {k} GROUP BY id")
    fills = " UNION ALL ".join(one.format(c=c) for c in INJECT_COLS)
    holes = " UNION ALL ".join(f"SELECT id, '{c}' AS variable, (SELECT AVG({c}) FROM inj) AS mean FROM inj WHERE {c} IS NULL" for c in INJECT_COLS)
    return f"WITH {_INJ}, fills AS ({fills}), holes AS ({holes}) SELECT id, variable, {R('COALESCE(value, mean)', 'value')} FROM holes LEFT JOIN fills USING (id, variable)"


@register("listings_knn_imputation", _knn_sql(), L)
def q_listings_knn_imputation(spark, d):
    """M5 — every null of the injected listings with the mean of its five nearest rows."""
    inj = MS.inject_nulls(V.listings(spark, d).select("id", *INJECT_COLS), INJECT_COLS, "id", RATE)
    filled = KN.knn_impute(inj, INJECT_COLS, "id").select("id", *[F.col(c).alias(f"f_{c}") for c in INJECT_COLS])
    both = inj.join(filled, "id")
    return both.select("id", F.inline(F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("variable"), F.round(f"f_{c}", 6).alias("value"))) for c in INJECT_COLS]))))
