"""Grouped rates and shares, KPI rows, value counts and column / null profiles (A-family).

Design rules: one scan per table (all columns folded into one ``agg`` or one ``unpivot`` pass,
never a job per column), map-side partial aggregation before every shuffle, denominators as
scalar subqueries (no cross join, no single-partition window over data-sized results).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.joins import null_safe_join
from quarry.functions.moments import kurt_sample, skew_sample
from quarry.functions.output import maybe_round
from quarry.session import materialize
from quarry.operators.ranks import cumulative_counts, quantiles_from_ranks, select_quantiles, value_count_table



def total_rows(df: DataFrame, name: str = "total_rows") -> DataFrame:
    """A1 — ``SELECT COUNT(*)``."""
    return df.agg(F.count("*").alias(name))


def share_by(df: DataFrame, keys: Sequence[str], count_name: str = "n", pct_name: str = "pct",
             digits: int | None = None) -> DataFrame:
    """A9 — rows and percentage of all rows per group (denominator: the sum over the groups)."""
    g = df.groupBy(*keys).agg(F.count("*").alias(count_name))
    total = g.select(F.sum(count_name)).scalar()
    return g.withColumn(pct_name, maybe_round(F.col(count_name) * F.lit(100.0) / total, digits))


def rate_by(df: DataFrame, keys: Sequence[str], target: str, total_name: str = "total",
            positives_name: str = "positives", rate_name: str = "rate_pct",
            digits: int | None = None) -> DataFrame:
    """A10 — ``SUM(b) * 100 / COUNT(*)`` per group for a 0/1 target."""
    return (df.groupBy(*keys)
              .agg(F.count("*").alias(total_name), F.sum(target).alias(positives_name))
              .withColumn(rate_name,
                          maybe_round(F.col(positives_name) * F.lit(100.0) / F.col(total_name), digits)))


def rate_by_each(df: DataFrame, variables: Sequence[str], target: str,
                 digits: int | None = None) -> DataFrame:
    """A11 — target rate for every value of every variable in ONE pass:
    ``(variable, value, total, positives, rate_pct)``."""
    long = (df.select(F.col(target).cast("double").alias("_t"),
                      *[F.col(v).cast("double").alias(v) for v in variables])
              .unpivot(["_t"], list(variables), "variable", "value"))
    return (long.groupBy("variable", "value")
                .agg(F.count("*").alias("total"), F.sum("_t").alias("positives"))
                .withColumn("rate_pct", maybe_round(F.col("positives") * F.lit(100.0) / F.col("total"),
                                                    digits)))


def predicate_shares(df: DataFrame, predicates: Mapping[str, Column], digits: int | None = None) -> DataFrame:
    """A12 — percentage of rows satisfying each named predicate (one row, one scan).
    A null predicate counts as false, as in a boolean mask."""
    return df.agg(*[maybe_round(F.avg(F.coalesce(p, F.lit(False)).cast("double")) * F.lit(100.0), digits)
                    .alias(name) for name, p in predicates.items()])


def transpose_row(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """A14 — turn a one-row summary into ``(metric, value)`` rows (values as double)."""
    cols = df.columns
    return (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
              .unpivot([], cols, metric, value))


def value_counts(df: DataFrame, col: str, normalize: bool = True, top: int | None = None,
                 by_value: bool = False, count_name: str = "n", share_name: str = "share") -> DataFrame:
    """A15 — counts (and shares of non-null rows) per value, largest count first with the value as
    tie-break (or in order of value); optionally the first ``top``.  Nulls are dropped like pandas
    ``value_counts``."""
    base = df.where(F.col(col).isNotNull())
    g = base.groupBy(col).agg(F.count("*").alias(count_name))
    if normalize:
        g = g.withColumn(share_name, F.col(count_name) / g.select(F.sum(count_name)).scalar().cast("double"))
    order = [F.col(col)] if by_value else [F.col(count_name).desc(), F.col(col)]
    g = g.orderBy(*order)
    return g.limit(top) if top is not None else g


def binary_frequency(df: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    """A16 — for every 0/1 column: total non-null, zeros, ones, % ones (one wide aggregate)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"t{i}"), F.count_if(x == 0).alias(f"z{i}"), F.count_if(x == 1).alias(f"o{i}")]
    rows = [F.struct(F.lit(c).alias("variable"), F.col(f"t{i}").alias("total"), F.col(f"z{i}").alias("n0"), F.col(f"o{i}").alias("n1"))
            for i, c in enumerate(cols)]
    long = df.agg(*aggs).select(F.inline(F.array(*rows))).where(F.col("total") > 0)
    return long.withColumn("pct1", maybe_round(F.col("n1") * F.lit(100.0) / F.col("total"), digits))


def group_stats(df: DataFrame, keys: Sequence[str], value: str, min_count: int | None = None,
                drop_null_keys: bool = False) -> DataFrame:
    """A17 — count, mean, exact median, sample std of ``value`` per group (nulls in ``value``
    skipped), from one value-count scan.  ``min_count`` keeps groups with at least that many
    rows (post-filter, A8)."""
    base = df.where(F.col(value).isNotNull())
    if drop_null_keys:
        base = base.dropna(subset=list(keys))
    vc = materialize(value_count_table(base, [value], keys))
    mom = moments_from_counts(vc, keys)
    med = quantiles_from_ranks(cumulative_counts(vc, keys), [0.5], by=keys, names=["median"])
    out = null_safe_join(mom, med.select(*keys, "median"), list(keys))
    if min_count is not None:
        out = out.where(F.col("count") >= min_count)
    return out.select(*keys, "count", "mean", "median", "std")


def top_groups(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], order_by: Sequence[Column],
               k: int) -> DataFrame:
    """A18 — named aggregates per group, top ``k`` by ``order_by`` then by the keys.
    Null keys are dropped (pandas ``groupby`` semantics)."""
    g = df.dropna(subset=list(keys)).groupBy(*keys).agg(*aggs)
    return g.orderBy(*order_by, *[F.col(c) for c in keys]).limit(k)


def per_key_count_distribution(df: DataFrame, key: str, count_name: str = "listings",
                               freq_name: str = "keys") -> DataFrame:
    """A19 — aggregate of an aggregate: rows per key, then how many keys have each count."""
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count_name))
    return per_key.groupBy(count_name).agg(F.count("*").alias(freq_name))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True,
                 digits: int | None = None) -> DataFrame:
    """A27 — ``(variable, nulls, null_pct)`` for every column, one scan, sorted by nulls."""
    cols = list(cols or df.columns)
    row = df.agg(F.count("*").alias("_n"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    long = row.unpivot(["_n"], cols, "variable", "nulls")
    out = long.select("variable", "nulls",
                      maybe_round(F.try_divide(F.col("nulls") * F.lit(100.0), F.col("_n")), digits)
                      .alias("null_pct"))
    out = out.where(F.col("nulls") > 0) if only_missing else out
    return out.orderBy(F.col("nulls").desc(), "variable")


def column_profile(df: DataFrame, key: str, cols: Sequence[str] | None = None,
                   digits: int | None = None, approx_distinct: bool = False) -> DataFrame:
    """A28 — per column: type, non-null, nulls, % null, distinct values, and a deterministic
    sample value (the value at the smallest key among non-null rows).  Counts and samples are one
    aggregate; distinct values are counted from one grouping of (column, 128-bit hash of the
    value), pre-aggregated per task, so long texts are not shuffled.  ``approx_distinct`` (A3
    opt-in for wide tables) uses HyperLogLog++ sketches in the first aggregate instead."""
    cols = [c for c in (cols or df.columns)]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(cols):
        cc = F.col(f"`{c}`")
        aggs += [F.count(cc).alias(f"nn{i}"),
                 F.min_by(cc.cast("string"), F.when(cc.isNotNull(), F.col(key))).alias(f"sv{i}")]
        if approx_distinct:
            aggs.append(F.approx_count_distinct(cc).alias(f"nd{i}"))
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("variable"), F.lit(types[c]).alias("dtype"), F.col(f"nn{i}").alias("non_null"),
                        *([F.col(f"nd{i}").alias("distinct")] if approx_distinct else []),
                        F.col(f"sv{i}").alias("sample_value")) for i, c in enumerate(cols)]
    long = row.select("_n", F.inline(F.array(*structs)))
    if not approx_distinct:
        hashed = [F.struct(F.lit(c).alias("variable"), F.xxhash64(F.col(f"`{c}`")).alias("h"),
                           F.xxhash64(F.col(f"`{c}`"), F.lit(1)).alias("g"), F.col(f"`{c}`").isNotNull().alias("there")) for c in cols]
        seen = df.select(F.inline(F.array(*hashed))).where("there").groupBy("variable", "h", "g").agg(F.lit(1).alias("one"))
        long = long.join(seen.groupBy("variable").agg(F.count("*").alias("distinct")), "variable", "left")
        long = long.withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    return long.select("variable", "dtype", "non_null", (F.col("_n") - F.col("non_null")).alias("nulls"),
                       maybe_round(F.try_divide((F.col("_n") - F.col("non_null")) * F.lit(100.0), F.col("_n")),
                                   digits).alias("null_pct"),
                       "distinct", "sample_value")


def moments_from_counts(vc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, variable, rows, count, mean, std, min, max, skew, kurtosis)`` from a value-count
    table (value NULL = the null rows).  Central moments are taken around the exact mean in a
    second pass over the counts (numerically stable), then corrected like pandas / DuckDB:
    std with n − 1, skew G1 (n ≥ 3), excess kurtosis G2 (n ≥ 4); NULL for a constant column."""
    part = [*by, "variable"]
    v, c = F.col("value"), F.col("cnt")
    first = vc.groupBy(*part).agg(
        F.sum(c).alias("rows"), F.sum(F.when(v.isNotNull(), c)).alias("count"),
        (F.sum(F.when(v.isNotNull(), c * v)) / F.sum(F.when(v.isNotNull(), c))).alias("mean"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    first = F.broadcast(first) if not by else first          # one row per variable without groups
    d = v - F.col("mean")
    second = (null_safe_join(vc.where(v.isNotNull()), first.select(*part, "mean"), part)
                .groupBy(*part).agg(F.sum(c * d * d).alias("m2"), F.sum(c * d * d * d).alias("m3"),
                                    F.sum(c * d * d * d * d).alias("m4")))
    j = null_safe_join(first, second, part, "left")
    n = F.col("count").cast("double")
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    g1 = F.try_divide(m3 / n, F.pow(m2 / n, 1.5))
    g2 = F.try_divide(m4 / n, F.pow(m2 / n, 2)) - 3
    return j.select(*part, "rows", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"), "mean",
                    F.when(n >= 2, F.sqrt(m2 / (n - 1))).alias("std"), "min", "max",
                    F.when((n >= 3) & (m2 > 0), g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
                    F.when((n >= 4) & (m2 > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"))


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), kurtosis: bool = True) -> DataFrame:
    """A25 — per variable (and group): n, nulls, null_pct, mean, std, min, q1, median, q3, max,
    skew (G1), kurtosis (G2).  Without groups: one wide aggregate and ``select_quantiles``.  By
    group: one scan builds the value-count table, from which moments and exact quantiles (W1)
    are derived — no per-group value list is materialised."""
    if not by:
        return _describe_columns(df, cols, kurtosis)
    vc = materialize(value_count_table(df, cols, by, keep_nulls=True))
    mom = moments_from_counts(vc, by)
    q = quantiles_from_ranks(cumulative_counts(vc.where(F.col("value").isNotNull()), by),
                             [0.25, 0.5, 0.75], by, ["q1", "median", "q3"])
    out = null_safe_join(mom, q.drop("n"), [*by, "variable"], "left")
    extra = ["kurtosis"] if kurtosis else []
    return out.select(*by, "variable", "count",
                      (F.col("rows") - F.col("count")).alias("nulls"),
                      ((F.col("rows") - F.col("count")) * F.lit(100.0) / F.col("rows")).alias("null_pct"),
                      "mean", "std", "min", "q1", "median", "q3", "max", "skew", *extra)


def _describe_columns(df: DataFrame, cols: Sequence[str], kurtosis: bool) -> DataFrame:
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "skew": skew_sample}
    if kurtosis:
        parts["kurtosis"] = kurt_sample
    moments = [F.struct(*[f(F.col(c).cast("double")).alias(name) for name, f in parts.items()]).alias(f"_m{i}") for i, c in enumerate(cols)]
    q, row = select_quantiles(df, cols, [0.25, 0.5, 0.75], ["q1", "median", "q3"], [F.count("*").alias("_n"), *moments])
    long = df.sparkSession.createDataFrame([(row["_n"], c, *row[f"_m{i}"]) for i, c in enumerate(cols)], "_n long, variable string, "
                                           + ", ".join(f"`{name}` {'long' if name == 'count' else 'double'}" for name in parts))
    out = long.join(F.broadcast(q.drop("n")), "variable", "left")                     # one row a column
    return out.select("variable", "count", (F.col("_n") - F.col("count")).alias("nulls"),
                      F.try_divide((F.col("_n") - F.col("count")) * F.lit(100.0), F.col("_n")).alias("null_pct"),
                      "mean", "std", "min", "q1", "median", "q3", "max", "skew", *(["kurtosis"] if kurtosis else []))


def pivot_mean(df: DataFrame, row_key: str, col_key: str, value: str, values: Sequence | None = None,
               scale: float = 100.0) -> DataFrame:
    """A29 — 2-D pivot of ``avg(value)·scale`` (display form); pass ``values`` to avoid the
    extra distinct pass that ``pivot`` otherwise runs."""
    return df.groupBy(row_key).pivot(col_key, list(values) if values is not None else None).agg(
        F.avg(value) * F.lit(scale))


def crosstab_long(df: DataFrame, a: str, b: str, count_name: str = "n") -> DataFrame:
    """A30 — contingency counts in long form; rows with a null on either side are dropped."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
              .groupBy(a, b).agg(F.count("*").alias(count_name)))


def top_categories(df: DataFrame, col: str, k: int) -> DataFrame:
    """Top-``k`` categories of ``col`` by count (value as tie-break) — a k-row table."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_c"))
              .orderBy(F.col("_c").desc(), F.col(col)).limit(k).select(col))


def crosstab_top(df: DataFrame, a: str, b: str, k: int = 6, count_name: str = "n") -> DataFrame:
    """A31 — contingency restricted to the top-``k`` categories of each side (k-row tables are
    broadcast: their size is bounded by ``k``)."""
    ka, kb = top_categories(df, a, k), top_categories(df, b, k)
    sub = df.join(F.broadcast(ka), a, "left_semi").join(F.broadcast(kb), b, "left_semi")
    return crosstab_long(sub, a, b, count_name)


def dtype_columns(df: DataFrame, kind: str = "numeric") -> list[str]:
    """P4 — column names by type class (``numeric`` or ``text``)."""
    if kind == "numeric":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if kind == "text":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    raise ValueError(kind)
