"""W1 — mid-ranks with ties, and exact order statistics (quantiles) built on them.

Everything here works on the *value-count table* ``(by…, variable, value, cnt)`` instead of on
rows: a value repeated a billion times is one row, so hot values cannot skew a task.  Cumulative
counts over the distinct values are computed without a single-partition window:

1. the value-count table is range-partitioned on (group, variable, value) by Spark's
   RangePartitioner (sampled bounds, binary search per row); each partition is a bucket;
2. per-bucket totals form a small table (groups × variables × buckets rows) whose running sum
   gives each bucket's offset;
3. a window partitioned by (group, variable, bucket) accumulates counts inside the bucket.

The sampled bounds only balance the buckets — results are exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quarry.functions.joins import null_safe_join
from quarry.session import materialize


def to_long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
            variable: str = "variable", value: str = "value", keep_nulls: bool = False) -> DataFrame:
    """Unpivot ``cols`` (cast to double) into ``(by…, variable, value)`` in one scan."""
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    long = wide.unpivot(list(by), list(cols), variable, value)
    return long if keep_nulls else long.where(F.col(value).isNotNull())


def value_counts_long(long: DataFrame, by: Sequence[str] = (), variable: str = "variable",
                      value: str = "value") -> DataFrame:
    """``(by…, variable, value, cnt)``; map-side partial aggregation absorbs hot values."""
    return long.groupBy(*by, variable, value).agg(F.count(F.lit(1)).alias("cnt"))


def value_count_table(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), keep_nulls: bool = False) -> DataFrame:
    """One scan: ``(by…, variable, value, cnt)`` for several columns (value NULL counts the nulls
    when ``keep_nulls``).  Every statistic of the describe / box / outlier family is derived
    from this table, so the input is read once."""
    return value_counts_long(to_long(df, cols, by, keep_nulls=keep_nulls), by)


def cumulative_counts(vc: DataFrame, by: Sequence[str] = (), variable: str = "variable",
                      value: str = "value", buckets: int | None = None) -> DataFrame:
    """Add ``cum_before`` (rows with a smaller value), ``n`` (rows in the partition) and
    ``rank`` (1-based mid-rank ``cum_before + (cnt + 1) / 2``) to a value-count table.

    ``buckets`` range partitions of (group, variable, value) — Spark's RangePartitioner: sampled
    bounds, binary search per row — become the buckets; without it their number is the session's
    shuffle partition setting, which adaptive execution lowers for small tables.  The bucketed
    table is written once (bounds are sampled, so every consumer must see the same assignment).
    """
    part = [*by, variable]
    order = [*(F.col(c) for c in part), F.col(value)]
    ranged = vc.repartitionByRange(buckets, *order) if buckets else vc.repartitionByRange(*order)
    vcb = materialize(ranged.withColumn("_b", F.spark_partition_id()))
    totals = vcb.groupBy(*part, "_b").agg(F.sum("cnt").alias("_bt"))
    wpart = Window.partitionBy(*part)
    offsets = totals.select(
        *part, "_b",
        (F.sum("_bt").over(wpart.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_bt")).alias("_off"),
        F.sum("_bt").over(wpart).alias("n"))
    # Bounded by groups × variables × buckets rows; with no group it is small and broadcast.
    offsets = F.broadcast(offsets) if not by else offsets
    inb = Window.partitionBy(*part, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (null_safe_join(vcb, offsets, [*part, "_b"])
               .withColumn("cum_before", F.col("_off") + F.sum("cnt").over(inb) - F.col("cnt"))
               .withColumn("rank", F.col("cum_before") + (F.col("cnt") + F.lit(1.0)) / F.lit(2.0))
               .drop("_off", "_b"))


def rank_table(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
               buckets: int | None = None) -> DataFrame:
    """Mid-rank of every distinct value of every column: ``(by…, variable, value, cnt,
    cum_before, n, rank)``.  Nulls are excluded (ranked data is the non-null data)."""
    long = to_long(df, cols, by)
    return cumulative_counts(value_counts_long(long, by), by, buckets=buckets)


def with_midrank(df: DataFrame, col: str, out: str = None, by: Sequence[str] = (),
                 buckets: int | None = None) -> DataFrame:
    """Attach the mid-rank of ``col`` to every row (equi-join on the value; AQE splits a
    partition that a hot value makes large).  Null values get a null rank."""
    out = out or f"{col}_rank"
    rt = rank_table(df, [col], by, buckets).select(*by, F.col("value").alias("_v"),
                                                    F.col("rank").alias(out))
    keyed = df.withColumn("_v", F.col(col).cast("double"))
    return null_safe_join(keyed.withColumn("_null", F.col("_v").isNull()), rt.withColumn("_null", F.lit(False)),
                          [*by, "_v", "_null"], "left").drop("_v", "_null")


def quantiles_from_ranks(rt: DataFrame, probs: Sequence[float], by: Sequence[str] = (),
                         names: Sequence[str] | None = None, variable: str = "variable") -> DataFrame:
    """Exact linear-interpolation quantiles (type 7: ``x[k] + f·(x[k+1] − x[k])`` with
    ``k + f = (n − 1)·q``) from a rank table.  Output: ``(by…, variable, n, q…)``.

    Each row of the rank table covers 0-based order positions ``[cum_before, cum_before+cnt)``;
    the positions we need are picked with conditional aggregates (partial aggregation, no sort).
    """
    names = list(names or [f"q{int(round(p * 1000)):03d}" for p in probs])
    aggs = [F.first("n").alias("n")]
    lo_hi = []
    for p, nm in zip(probs, names):
        pos = (F.col("n") - 1) * F.lit(float(p))
        k = F.floor(pos)
        covers = lambda idx: (F.col("cum_before") <= idx) & (idx < F.col("cum_before") + F.col("cnt"))
        aggs.append(F.max(F.when(covers(k), F.col("value"))).alias(f"_lo_{nm}"))
        aggs.append(F.max(F.when(covers(k + 1), F.col("value"))).alias(f"_hi_{nm}"))
        lo_hi.append((p, nm))
    g = rt.groupBy(*by, variable).agg(*aggs)
    cols = [*by, variable, "n"]
    for p, nm in lo_hi:
        pos = (F.col("n") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"_lo_{nm}"), F.coalesce(F.col(f"_hi_{nm}"), F.col(f"_lo_{nm}"))
        cols.append((lo + frac * (hi - lo)).alias(nm))
    return g.select(*cols)


#: Relative rank error of the sketch that brackets an order statistic, and the margins, as shares
#: of the rows, of which the narrowest that is safe for the number of rows is used.
SKETCH_ERROR = 1e-4
_MARGINS = (8 * SKETCH_ERROR, 0.01, 1.0)


def select_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str],
                     extra: Sequence[Column] = ()) -> tuple[DataFrame, Row]:
    """Exact type-7 quantiles of whole columns, ``(variable, n, q…)``, without shuffling the data;
    and the row of ``extra`` aggregates, taken in the same first scan.

    The first scan builds a bounded sketch of each column, which brackets every wanted position
    with a margin of several times the sketch's error.  Then the rows below each bracket are
    counted, and the values inside it, under 0.2 % of the rows in a large table (ties are one
    value); the wanted ones are picked from these.  A position outside its bracket would break the
    sketch's guarantee and raises an error.  The brackets, one row of numbers, pass through the
    driver, so the first scan runs when this is called.
    """
    x = {c: F.col(c).cast("double") for c in cols}
    points = [min(1.0, max(0.0, p + side * m)) for p in probs for m in _MARGINS for side in (-1, 1)]
    array = F.array(*map(F.lit, points))
    row = df.agg(*[F.struct(F.count(x[c]).alias("n"), F.percentile_approx(x[c], array, F.lit(int(1 / SKETCH_ERROR))).alias("q")).alias(f"_c{i}")
                   for i, c in enumerate(cols)], *extra).first()
    spots = []
    for i, c in enumerate(cols):
        n, q = row[f"_c{i}"]
        for j in range(len(probs)) if n else ():
            m = next(m for m, share in enumerate(_MARGINS) if share >= 4 * SKETCH_ERROR + 2 / n or share == 1.0)
            lo, hi = q[2 * (len(_MARGINS) * j + m)], q[2 * (len(_MARGINS) * j + m) + 1]
            spots.append((c, j, n, F.lit(lo), F.lit(hi)))
    if not spots:
        return df.sparkSession.createDataFrame([], "variable string, n long, " + ", ".join(f"`{nm}` double" for nm in names)), row
    below = df.agg(*[F.count_if(x[c] < lo).alias(f"b{k}") for k, (c, _, _, lo, _) in enumerate(spots)])
    below = below.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.lit(j).alias("j"), F.lit(n).alias("n"),
                                                     F.lit(float(probs[j])).alias("p"), F.col(f"b{k}").alias("below"))
                                            for k, (c, j, n, _, _) in enumerate(spots)])))
    inside = [F.when((x[c] >= lo) & (x[c] <= hi), F.struct(F.lit(c).alias("variable"), F.lit(j).alias("j"), x[c].alias("value")))
              for c, j, _, lo, hi in spots]
    counts = (df.select(F.inline(F.array_compact(F.array(*inside)))).groupBy("variable", "j", "value").agg(F.count("*").alias("cnt")))
    run = Window.partitionBy("variable", "j").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("cnt").over(run)).join(F.broadcast(below), ["variable", "j"])    # one row a column and prob
    pos = (F.col("n") - 1) * F.col("p")
    k = F.floor(pos)
    covers = lambda at: (F.col("below") + F.col("upto") - F.col("cnt") <= at) & (at < F.col("below") + F.col("upto"))
    g = ranked.groupBy("variable", "j", "n", "p").agg(F.max(F.when(covers(k), F.col("value"))).alias("at"),
                                                      F.max(F.when(covers(k + 1), F.col("value"))).alias("after"))
    missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    low = F.coalesce("at", missed)
    high = F.when(k + 1 >= F.col("n"), low).otherwise(F.coalesce("after", missed))
    g = g.withColumn("q", low + (pos - k) * (high - low))
    return g.groupBy("variable", "n").agg(*[F.max(F.when(F.col("j") == j, F.col("q"))).alias(nm) for j, nm in enumerate(names)]), row


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              names: Sequence[str] | None = None, buckets: int | None = None,
              approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Quantiles of several columns, long form ``(by…, variable, n, q…)``.

    Exact (linear interpolation) by default.  ``approx=True`` opts into ``percentile_approx``: one
    aggregation with a bounded sketch per group, relative rank error ``1/accuracy``; it returns
    an observed element, not an interpolated value."""
    if not approx and not by:
        return select_quantiles(df, cols, probs, list(names or [f"q{int(round(p * 1000)):03d}" for p in probs]))[0]
    if not approx:
        return quantiles_from_ranks(rank_table(df, cols, by, buckets), probs, by, names)
    names = list(names or [f"q{int(round(p * 1000)):03d}" for p in probs])
    long = to_long(df, cols, by)
    g = long.groupBy(*by, "variable").agg(F.count("*").alias("n"),
                                          F.percentile_approx("value", list(probs), accuracy).alias("_q"))
    return g.select(*by, "variable", "n", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])


def quantile_scalar(df: DataFrame, col: str, prob: float) -> Column:
    """A scalar-subquery column holding the exact ``prob`` quantile of ``col``."""
    q = quantiles(df, [col], [prob], names=["q"])
    return q.select("q").scalar()
