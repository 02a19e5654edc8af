"""Cleaning and scalar helpers (P-family): currency text, dates, label maps, CASE buckets,
significance stars, column-set checks.  All are JVM-side Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def currency_to_double(c: Column | str) -> Column:
    """P6 — ``"$1,200.00"`` → 1200.0; empty or unparsable text → NULL (``try_cast``, ANSI-safe)."""
    stripped = F.regexp_replace(_c(c).cast("string"), r"[\$,\s]", "")
    return F.nullif(stripped, F.lit("")).try_cast("double")


def parse_timestamp(c: Column | str, fmt: str | None = None) -> Column:
    """P7 — text → timestamp, bad values → NULL."""
    return F.try_to_timestamp(_c(c), F.lit(fmt)) if fmt else F.try_to_timestamp(_c(c))


def nan_text_to_null(c: Column | str) -> Column:
    """P8 — a text date stored as the string ``'nan'`` becomes NULL."""
    return F.nullif(_c(c).cast("string"), F.lit("nan"))


def label_map(c: Column | str, mapping: Mapping) -> Column:
    """P9 — code → label via a literal map; unmapped codes → NULL."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.element_at(m, _c(c)) if mapping else F.lit(None)


def host_profile(c: Column | str) -> Column:
    """P10 — searched CASE bucketing of a host's listing count into four profiles."""
    c = _c(c)
    return (F.when(c == 1, F.lit("1. casual (1 listing)"))
             .when(c.between(2, 5), F.lit("2. semi-professional (2-5)"))
             .when(c.between(6, 10), F.lit("3. active (6-10)"))
             .otherwise(F.lit("4. professional (>10)")))


def significance_stars(p: Column | str, empty: str = "ns") -> Column:
    """P16 — ``***`` p<0.001, ``**`` p<0.01, ``*`` p<0.05, else ``empty``; NULL p → NULL."""
    p = _c(p)
    return (F.when(p.isNull(), F.lit(None).cast("string"))
             .when(p < 0.001, F.lit("***")).when(p < 0.01, F.lit("**"))
             .when(p < 0.05, F.lit("*")).otherwise(F.lit(empty)))


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P2 — drop listed columns; absent ones are ignored."""
    return df.drop(*cols)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P3 — fail before planning when required columns are missing (lists them all)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def exclude_roles(cols: Sequence[str], roles: Mapping[str, Sequence[str]],
                  drop: Sequence[str] = ("id", "empty", "date", "text")) -> list[str]:
    """P5 — remove columns whose role (id / empty / date / free text) is listed in ``drop``."""
    excluded = set(chain.from_iterable(roles.get(r, ()) for r in drop))
    return [c for c in cols if c not in excluded]


# Code → label dimensions of the survey (age 13 groups, education 6, income 8).
AGE_LABELS = {1: "18-24", 2: "25-29", 3: "30-34", 4: "35-39", 5: "40-44", 6: "45-49", 7: "50-54",
              8: "55-59", 9: "60-64", 10: "65-69", 11: "70-74", 12: "75-79", 13: "80+"}
EDUCATION_LABELS = {1: "Never attended", 2: "Elementary", 3: "Some high school", 4: "High school graduate",
                    5: "Some college", 6: "College graduate"}
INCOME_LABELS = {1: "<$10k", 2: "$10k-15k", 3: "$15k-20k", 4: "$20k-25k", 5: "$25k-35k",
                 6: "$35k-50k", 7: "$50k-75k", 8: ">=$75k"}
CLASS_LABELS = {0: "No diabetes", 1: "Prediabetes/Diabetes"}
SEX_LABELS = {0: "Female", 1: "Male"}
