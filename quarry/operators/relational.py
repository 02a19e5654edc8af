"""Joins, sorts and set operations (J-, K-, U-families)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.output import maybe_round


def attach_metadata_rates(facts: DataFrame, meta: DataFrame, kind: str | None = None,
                          exclude: Sequence[str] = (), candidates: Sequence[str] | None = None,
                          rate_name: str = "rate_pct", digits: int | None = None) -> DataFrame:
    """J1 — mean ×100 of each metadata variable over all facts, next to its metadata row.

    The literal form is ``meta JOIN facts ON 1=1`` plus a CASE that picks the fact column named in
    the metadata row (22 × N rows).  Here: one wide aggregate over the facts, its single row
    stacked to one per column (bounded by the schema, so broadcast), and an equi-join to the
    metadata of any size.
    """
    if candidates is None:
        candidates = [f.name for f in facts.schema.fields if isinstance(f.dataType, T.NumericType)]
    cols = [c for c in candidates if c not in set(exclude)]
    row = facts.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    rates = row.unpivot([], cols, "variable", "_avg").where(F.col("_avg").isNotNull())
    m = meta.where(~F.col("variable").isin(list(exclude)))
    if kind is not None:
        m = m.where(F.col("kind") == kind)
    return (m.join(F.broadcast(rates), "variable", "inner")
             .select("variable", *[c for c in m.columns if c != "variable"],
                     maybe_round(F.col("_avg") * F.lit(100.0), digits).alias(rate_name)))


def combine_by_key(left: DataFrame, right: DataFrame, key: str | Sequence[str] = "variable",
                   how: str = "inner") -> DataFrame:
    """J4 — key-aligned combine of per-variable result tables."""
    return left.join(right, key, how)


def top_k(df: DataFrame, order_by: Sequence[Column], k: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """K2/K3 — ``ORDER BY … LIMIT k`` with explicit tie-break columns (TakeOrderedAndProject)."""
    return df.orderBy(*order_by, *[F.col(c) for c in tie_break]).limit(k)


def top_k_abs(df: DataFrame, col: str, k: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """K4 — largest ``|col|`` first."""
    return top_k(df, [F.abs(F.col(col)).desc()], k, tie_break)


def arg_best(df: DataFrame, label: str, metric: str, lowest: bool = True) -> DataFrame:
    """K5 — the label with the lowest (or highest) metric: ``min_by`` / ``max_by``."""
    f = F.min_by if lowest else F.max_by
    agg = F.min if lowest else F.max
    return df.agg(f(label, metric).alias(label), agg(metric).alias(metric))


def stack_labelled(frames: Sequence[tuple[str, DataFrame]], label: str = "method") -> DataFrame:
    """U1 — row-stack result frames under a label column (``unionByName``)."""
    out = None
    for name, f in frames:
        f = f.withColumn(label, F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out
