"""The aggregate behind each chart (D-family) and IQR outlier reports (O-family).

Edges and fences are per-variable (or per-group) statistics joined back to the rows; with no
group key the statistics table has one row per variable (a bound known at plan time) and is
broadcast, otherwise it is an ordinary shuffle join sized by the optimizer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.joins import null_safe_join
from quarry.session import materialize
from quarry.operators.ranks import cumulative_counts, quantiles, quantiles_from_ranks, to_long, value_count_table


def _stats_join(long: DataFrame, stats: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    return null_safe_join(long, stats, list(keys)) if by else long.join(F.broadcast(stats), list(keys), "inner")


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30, by: Sequence[str] = (),
              shared_edges: bool = True, density: bool = False) -> DataFrame:
    """D1/D2/D3 — equal-width histogram over [min, max] with ``bins`` bins, last bin closed.

    ``bin = least(floor((x − lo) / (hi − lo) · bins), bins − 1)``; a constant column puts every
    value in bin 0.  With ``by`` and ``shared_edges`` the edges come from all rows (one chart,
    overlaid classes); otherwise from each group.  ``density`` adds ``n / (N · width)``.
    Output: ``(by…, variable, bin, bin_lo, bin_hi, n[, density])`` — empty bins are omitted.
    """
    long = to_long(df, cols, by)
    edge_keys = ["variable"] if (shared_edges or not by) else [*by, "variable"]
    mm = long.groupBy(*edge_keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = _stats_join(long, mm, edge_keys, [] if edge_keys == ["variable"] else by)
    width = F.col("_hi") - F.col("_lo")
    raw = F.floor((F.col("value") - F.col("_lo")) / width * F.lit(bins))
    b = F.when(width > 0, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0)).cast("bigint")
    h = (j.withColumn("bin", b)
          .groupBy(*by, "variable", "bin", "_lo", "_hi").agg(F.count("*").alias("n")))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    out = h.select(*by, "variable", "bin",
                   (F.col("_lo") + F.col("bin") * step).alias("bin_lo"),
                   (F.col("_lo") + (F.col("bin") + 1) * step).alias("bin_hi"), "n")
    if density:
        tot = F.sum("n").over(Window.partitionBy(*by, "variable"))
        out = out.withColumn("density", F.try_divide(F.col("n"), tot * (F.col("bin_hi") - F.col("bin_lo"))))
    return out


def histogram_with_refs(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """D4 — histogram rows with the variable's mean and exact median alongside."""
    h = histogram(df, cols, bins)
    long = to_long(df, cols)
    mean = long.groupBy("variable").agg(F.avg("value").alias("mean"))
    med = quantiles(df, cols, [0.5], names=["median"]).select("variable", "median")
    refs = mean.join(med, "variable")
    return h.join(F.broadcast(refs), "variable", "left")


def box_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), whisker: float = 1.5,
              notch: bool = True) -> DataFrame:
    """D5/D6 — per variable (and group): n, q1, median, q3, iqr, fences, whiskers (most extreme
    data inside the fences), outlier count, and the notch interval median ± 1.57·IQR/√n.
    Without groups: ``select_quantiles`` and one wide aggregate against the fences.  By group: one
    scan, quartiles, whiskers and outlier counts all come from the value-count table."""
    probs, names = [0.25, 0.5, 0.75], ["q1", "median", "q3"]
    if by:
        vc = materialize(value_count_table(df, cols, by))
        q = _fences(quantiles_from_ranks(cumulative_counts(vc, by), probs, by, names), whisker)
        j = null_safe_join(vc, q.select(*by, "variable", "fence_lo", "fence_hi"), [*by, "variable"])
        v = F.col("value")
        inside = (v >= F.col("fence_lo")) & (v <= F.col("fence_hi"))
        w = j.groupBy(*by, "variable").agg(
            F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
            F.coalesce(F.sum(F.when(~inside, F.col("cnt"))), F.lit(0)).cast("bigint").alias("n_outliers"))
        out = null_safe_join(q, w, [*by, "variable"])
    else:
        q = _fences(_once(quantiles(df, cols, probs, names=names)), whisker)
        out = q.join(F.broadcast(_against_fences(df, cols, q)), "variable")         # one row a column
    cols_out = [*by, "variable", "n", "q1", "median", "q3", "iqr", "fence_lo", "fence_hi",
                "whisker_lo", "whisker_hi", "n_outliers"]
    if notch:
        half = F.lit(1.57) * F.col("iqr") / F.sqrt(F.col("n"))
        out = out.withColumn("notch_lo", F.col("median") - half).withColumn("notch_hi", F.col("median") + half)
        cols_out += ["notch_lo", "notch_hi"]
    return out.select(*cols_out)


def _once(q: DataFrame) -> DataFrame:
    """A table of one row a column as literal rows: computed once, however often it is used."""
    return q.sparkSession.createDataFrame(q.collect(), q.schema)


def _fences(q: DataFrame, whisker: float) -> DataFrame:
    return (q.withColumn("iqr", F.col("q3") - F.col("q1"))
             .withColumn("fence_lo", F.col("q1") - F.lit(whisker) * F.col("iqr"))
             .withColumn("fence_hi", F.col("q3") + F.lit(whisker) * F.col("iqr")))


def _against_fences(df: DataFrame, cols: Sequence[str], q: DataFrame) -> DataFrame:
    """``(variable, whisker_lo, whisker_hi, n_outliers, _rows)`` in one wide aggregate against the
    fences, of which the driver sees one row a column."""
    fences = {r["variable"]: r for r in q.select("variable", "fence_lo", "fence_hi").collect()}
    aggs, rows = [F.count("*").alias("_rows")], []
    for i, c in enumerate(cols):
        if c not in fences:                                  # all null
            continue
        x = F.col(c).cast("double")
        inside = (x >= F.lit(fences[c]["fence_lo"])) & (x <= F.lit(fences[c]["fence_hi"]))
        aggs += [F.min(F.when(inside, x)).alias(f"lo{i}"), F.max(F.when(inside, x)).alias(f"hi{i}"), F.count_if(~inside).alias(f"out{i}")]
        rows.append(F.struct(F.lit(c).alias("variable"), F.col(f"lo{i}").alias("whisker_lo"), F.col(f"hi{i}").alias("whisker_hi"),
                             F.col(f"out{i}").alias("n_outliers")))
    if not rows:
        return df.sparkSession.createDataFrame([], "_rows long, variable string, whisker_lo double, whisker_hi double, n_outliers long")
    return df.agg(*aggs).select("_rows", F.inline(F.array(*rows)))


def iqr_outliers(df: DataFrame, cols: Sequence[str], whisker: float = 1.5,
                 denominator: str = "non_null") -> DataFrame:
    """O1 — per variable: q1, q3, iqr, lower/upper fence, outlier count and % of rows: exact
    quartiles (``select_quantiles``), then one wide aggregate against the fences.
    ``denominator='non_null'`` divides by the non-null count (caller passed ``dropna()`` data);
    ``'rows'`` divides by all rows (caller passed the raw column)."""
    q = _fences(_once(quantiles(df, cols, [0.25, 0.75], names=["q1", "q3"])), whisker)
    out = (q.join(F.broadcast(_against_fences(df, cols, q)), "variable")            # one row a column
            .withColumnsRenamed({"fence_lo": "lower", "fence_hi": "upper"}))
    den = F.col("n") if denominator == "non_null" else F.col("_rows")
    return out.select("variable", "n", "q1", "q3", "iqr", "lower", "upper", "n_outliers",
                      (F.col("n_outliers") * F.lit(100.0) / den).alias("pct_outliers"))


def largest(df: DataFrame, col: str, n: int, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """O2 / K3 — ``nlargest``: top ``n`` by ``col`` (key breaks ties), nulls excluded."""
    sel = list(cols) if cols else df.columns
    return (df.where(F.col(col).isNotNull()).orderBy(F.col(col).desc(), F.col(key)).limit(n).select(*sel))


def null_patterns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D8 (re-aimed null map) — count of rows per null pattern: a string with one ``1``/``0``
    per column in the given order (``1`` = null)."""
    pat = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return df.groupBy(pat.alias("pattern")).agg(F.count("*").alias("n"))
