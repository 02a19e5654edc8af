"""Filters and parameterised slices (F-family).  Predicates stay declarative so Catalyst pushes
them into the parquet scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ranks import quantiles


def slice_frame(df: DataFrame, selections: Mapping[str, Sequence] | None = None,
                ranges: Mapping[str, tuple] | None = None,
                keep_null_ranges: Sequence[str] = ()) -> DataFrame:
    """F5/F6 — multi-select lists (an empty or missing list means *no filter*) and inclusive
    ranges folded into one ``where``.  Columns in ``keep_null_ranges`` keep rows whose value is
    NULL (``isna() | between``)."""
    cond: Column = F.lit(True)
    for c, values in (selections or {}).items():
        if values:
            cond = cond & F.col(c).isin(list(values))
    for c, (lo, hi) in (ranges or {}).items():
        r = F.col(c).between(lo, hi)
        if c in keep_null_ranges:
            r = F.col(c).isNull() | r
        cond = cond & r
    return df.where(cond)


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """F7 — drop rows with a null in any of ``subset``."""
    return df.dropna(subset=list(subset))


def cap_at_quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    """F8 — keep rows with ``col <= quantile(col, q)`` (exact, linear); nulls drop out of the
    comparison.  The cap is a scalar subquery, evaluated once."""
    cap = quantiles(df, [col], [q], names=["cap"]).select("cap").scalar()
    return df.where(F.col(col) <= cap)


def cap_at(df: DataFrame, col: str, limit: float) -> DataFrame:
    """F9 — keep rows with ``col <= limit``."""
    return df.where(F.col(col) <= limit)


def valid_target(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """F10 — rows with a positive, non-null target, plus a one-row report of how many were
    removed (``rows_before``, ``rows_kept``, ``rows_removed``) computed in one pass."""
    ok = F.col(col).isNotNull() & (F.col(col) > 0)
    report = df.agg(F.count("*").alias("rows_before"), F.count_if(ok).alias("rows_kept"))
    report = report.withColumn("rows_removed", F.col("rows_before") - F.col("rows_kept"))
    return df.where(ok), report


def domain_values(df: DataFrame, col: str) -> DataFrame:
    """F11 — sorted distinct non-null values (filter widget domain)."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def domain_range(df: DataFrame, col: str, q: float = 0.99) -> DataFrame:
    """F11 — min, max and the exact ``q`` quantile of a numeric column (one row)."""
    qq = quantiles(df, [col], [q], names=["p"]).select("p").scalar()
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max")).withColumn(f"p{int(q * 100)}", qq)
