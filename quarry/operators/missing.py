"""Missing data (M-family): deterministic null injection, mean / median / mode imputation and the
before / after comparison.

Null injection nulls, for every variable independently, exactly ``floor(N · rate)`` rows: the
rows with the smallest ``(h, key)`` where ``h`` is a 52-bit hash of ``seed|variable|key``.  The
cut-off ``(h, key)`` per variable is found with two-level bucket counts — counts per high-bit
bucket (partially aggregated, at most 2^20 per variable), then an exact ordering of the one
bucket that holds the cut — so no row-level sort or shuffle of the table is needed, and the
table itself is filtered in place by a comparison against the per-variable cut-off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranks import quantiles
from quarry.session import materialize

_BUCKET_SHIFT = 32          # 52-bit hash → 2^20 buckets


def null_hash(variable: str, key: Column | str, seed: int = 42) -> Column:
    """52-bit integer from ``md5('seed|variable|key')`` (13 hex digits; exact in a double)."""
    key = F.col(key) if isinstance(key, str) else key
    s = F.concat_ws("|", F.lit(str(seed)), F.lit(variable), key.cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 13), 16, 10).cast("bigint")


def injection_cutoffs(df: DataFrame, cols: Sequence[str], key: str, rate: float, seed: int = 42,
                     hashes: dict[str, Column] | None = None) -> DataFrame:
    """``(variable, k, cut_h, cut_key)`` — the k-th smallest ``(h, key)`` per variable; ``hashes``
    are the columns that hold ``null_hash`` of each, if the table has them.

    Two scans of the key: counts per bucket, whose sum is also the number of rows, then the one
    bucket of each variable that holds the cut.  One row per variable passes through the driver.
    """
    hashes = hashes or {c: null_hash(c, key, seed) for c in cols}
    bucket = lambda c: F.shiftrightunsigned(hashes[c], _BUCKET_SHIFT)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), bucket(c).alias("b")) for c in cols])))
    w = Window.partitionBy("variable")
    upto = w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    counts = long.groupBy("variable", "b").agg(F.count("*").alias("cnt")).select(
        "variable", "b", (F.sum("cnt").over(upto) - F.col("cnt")).alias("before"), F.sum("cnt").over(upto).alias("upto"),
        F.floor(F.sum("cnt").over(w) * F.lit(float(rate))).cast("bigint").alias("k"))
    held = counts.where((F.col("before") <= F.col("k") - 1) & (F.col("k") - 1 < F.col("upto"))).collect()
    inside = [F.when(bucket(r["variable"]) == r["b"], F.struct(
        F.lit(r["variable"]).alias("variable"), F.lit(r["k"]).alias("k"), F.lit(r["before"]).alias("before"),
        hashes[r["variable"]].alias("h"), F.col(key).alias("_key"))) for r in held]
    key_type = df.schema[key].dataType.simpleString()
    if not inside:                                          # no rows, or a rate too small for one
        return df.sparkSession.createDataFrame([], f"variable string, k long, cut_h long, cut_key {key_type}")
    cand = df.select(F.inline(F.array_compact(F.array(*inside))))
    pos = F.row_number().over(Window.partitionBy("variable").orderBy("h", "_key"))
    return (cand.withColumn("_pos", pos + F.col("before")).where("_pos = k")
                .select("variable", "k", F.col("h").alias("cut_h"), F.col("_key").alias("cut_key")))


def inject_nulls(df: DataFrame, cols: Sequence[str], key: str, rate: float = 0.05, seed: int = 42) -> DataFrame:
    """M1 — null exactly ``floor(N · rate)`` values of each column (independently per column,
    deterministic in ``seed`` and ``key``); rows already null stay null.  The table is written once
    with its hashes, so that whatever ``df`` derives and the hashes are computed once: pass only
    the columns that are wanted.  The cut-offs, one row a column, are found when this is called."""
    hashes = {c: F.col(f"_hash_{i}") for i, c in enumerate(cols)}
    names = df.columns
    df = materialize(df.withColumns({f"_hash_{i}": null_hash(c, key, seed) for i, c in enumerate(cols)}))
    cuts = {r["variable"]: r for r in injection_cutoffs(df, cols, key, rate, seed, hashes).collect()}
    out = {}
    for c, cut in cuts.items():
        mine = F.struct(hashes[c].alias("h"), F.col(key).alias("key"))
        at = F.struct(F.lit(cut["cut_h"]).alias("h"), F.lit(cut["cut_key"]).cast(df.schema[key].dataType).alias("key"))
        out[c] = F.when(F.coalesce(mine <= at, F.lit(False)), F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c))
    return df.withColumns(out).select(*names)


def _modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-null value of every column; ties → smallest value.  One pass per data
    type: values are counted in a shuffle, then the best of each column is one aggregate."""
    found = {}
    for kind in {df.schema[c].dataType.simpleString() for c in cols}:
        own = [c for c in cols if df.schema[c].dataType.simpleString() == kind]
        counts = (df.select(*own).unpivot([], own, "variable", "value").where(F.col("value").isNotNull())
                    .groupBy("variable", "value").agg(F.count("*").alias("n")))
        top = counts.groupBy("variable").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("m"))
        found |= {r["variable"]: r["m"] for r in top.collect()}                  # one row a column
    return found


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "median") -> DataFrame:
    """M2/M3/M4 — fill nulls with the column's mean, exact median (both make the column DOUBLE)
    or most frequent value (type kept); non-null values are never changed, a column without
    values stays null.  The fills, one value a column, are found when this is called."""
    if strategy == "mean":
        fills = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    elif strategy == "median":
        fills = {r["variable"]: r["m"] for r in quantiles(df, cols, [0.5], names=["m"]).collect()}
    elif strategy in ("mode", "most_frequent"):
        fills = _modes(df, cols)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    kind = {c: "double" if strategy in ("mean", "median") else df.schema[c].dataType for c in cols}
    return df.withColumns({c: F.coalesce(F.col(c).cast(kind[c]), F.lit(fills.get(c)).cast(kind[c])) for c in cols})


def compare_imputations(frames: Sequence[tuple[str, DataFrame]], cols: Sequence[str]) -> DataFrame:
    """M7 — before / after table: one row per (method, variable) with mean, median, std, nulls
    (U1 row-stacking of the per-method summaries)."""
    from quarry.operators.profile import describe
    from quarry.operators.relational import stack_labelled
    # U1 first, then ONE grouped describe: a single value-count pass and rank pass for all methods
    stacked = stack_labelled([(name, f.select(*[F.col(c).cast("double").alias(c) for c in cols]))
                              for name, f in frames], "method")
    return describe(stacked, cols, by=["method"], kurtosis=False).select(
        "method", "variable", "mean", "median", "std", "nulls")
