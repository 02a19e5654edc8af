"""Query catalogue: every implemented operator as ``(spark, sf_dir) -> DataFrame`` plus, where the
operator is expressible in SQL, the equivalent DuckDB query over the same parquet tables.

Catalogue outputs are normalised by ``tidy``: integers as BIGINT, fractions as DOUBLE rounded to
6 decimals (the reference rounds to 2 for display; 2-decimal rounding ties are resolved
differently by the two engines, so the comparison keeps 6).  The oracle side applies the same
rounding with ``R(...)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.output import tidy
from quarry.sources import views as V

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a catalogue query; ``sql`` is wrapped with the CTEs of the views in ``uses``."""
    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate catalogue entry {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLE[name] = V.with_views(sql, *uses) if uses else sql
        return fn
    return deco


def R(expr: str, alias: str, digits: int = 6) -> str:
    """Oracle-side twin of ``tidy`` for a fractional column."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {alias}"


def I(expr: str, alias: str) -> str:
    """Oracle-side integer column."""
    return f"CAST({expr} AS BIGINT) AS {alias}"


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)


def _load_all() -> None:
    # Importing the entry modules registers their queries.
    from quarry.plans import entries_named  # noqa: F401
    from quarry.plans import entries_profile  # noqa: F401
    from quarry.plans import entries_stats  # noqa: F401
    from quarry.plans import entries_missing  # noqa: F401
    from quarry.plans import entries_model  # noqa: F401
    from quarry.plans import entries_sources  # noqa: F401
