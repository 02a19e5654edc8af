"""Bias-corrected sample moments (the pandas / DuckDB definitions) from Spark's population ones.

Spark's ``skewness`` is the population g1 and ``kurtosis`` the population excess g2.  The
sample versions are
    G1 = g1 · √(n(n−1)) / (n−2)                       (NULL for n < 3)
    G2 = (n−1) / ((n−2)(n−3)) · ((n+1)·g2 + 6)         (NULL for n < 4)
Both stay NULL for a constant column (Spark returns NULL for g1/g2 there).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew_sample(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_sample(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson r on pairwise-complete rows; NULL (not an error) when either side is constant."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    xm, ym = F.when(both, x), F.when(both, y)
    den = F.stddev_pop(xm) * F.stddev_pop(ym)
    return F.when(den > 0, F.try_divide(F.covar_pop(xm, ym), den))
