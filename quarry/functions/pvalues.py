"""X1 — survival functions of the χ², F and Student-t distributions as vectorised pandas UDFs.

They are applied to *result* rows (one per variable or pair), never to data rows.  On a log scale
whose origin is the mode, both the gamma and the beta integrand are ``exp(-E(d))`` with a convex
``E`` and ``E(0) = 0``:

    χ²   a = dof / 2, x = a·e^d          E(d) = a (e^d − 1 − d)
    F    a = d2 / 2, b = d1 / 2, f = e^d  E(d) = (a + b) log(1 + q (e^d − 1)) − b d,  q = b / (a + b)

so a tail is one double-exponential quadrature.  There is no iteration to cut short, and no
difference of large logarithms: the digits hold for samples of 1e15 rows and degrees of freedom
of 1e9.  Student's t is the F distribution of t² with one degree of freedom.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_T = np.arange(-4.5, 4.5, 1 / 64)
#: Nodes and weights of the exp-sinh rule on [0, ∞).
_NODE = np.exp(np.pi / 2 * np.sinh(_T))
_WEIGHT = np.pi / 2 * np.cosh(_T) * _NODE / 64


def _stirling_rest(a: float) -> float:
    """log Γ(a) − [(a − ½) log a − a + ½ log 2π]."""
    if a < 15:
        return math.lgamma(a) - ((a - 0.5) * math.log(a) - a + 0.5 * math.log(2 * math.pi))
    s = 1 / (a * a)
    return (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s / 1680))) / a


def _upper_tail(energy, slope, curvature: float, log_scale: float, start: float) -> float:
    """∫ exp(log_scale − E(d)) dd from ``start`` to ∞; below the mode, one minus the lower tail."""
    side = 1.0 if start >= 0 else -1.0
    step = 1 / (abs(slope(start)) + math.sqrt(curvature))
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        rise = energy(start + side * step * _NODE) - energy(start)
        part = float(np.sum(_WEIGHT * np.exp(-np.where(np.isnan(rise), np.inf, rise)))) * step
    tail = part * math.exp(max(log_scale - float(energy(start)), -745.0))
    return min(1.0, max(0.0, tail if side > 0 else 1.0 - tail))


def chi2_sf_scalar(x: float, dof: float) -> float:
    if x is None or dof is None or math.isnan(x) or math.isnan(dof) or dof <= 0:
        return float("nan")
    if x <= 0 or math.isinf(x):
        return 1.0 if x <= 0 else 0.0
    a = dof / 2.0
    t = (x / 2.0 - a) / a
    return _upper_tail(lambda d: a * (np.expm1(d) - d), lambda d: a * math.expm1(min(d, 700.0)), a,
                       0.5 * math.log(a / (2 * math.pi)) - _stirling_rest(a), math.log1p(t) if t > -1 else -700.0)


def f_sf_scalar(f: float, d1: float, d2: float) -> float:
    if f is None or math.isnan(f) or not d1 > 0 or not d2 > 0:
        return float("nan")
    if f <= 0 or math.isinf(f):
        return 1.0 if f <= 0 else 0.0
    return _f_tail(math.log(f), d1, d2)


def _f_tail(start: float, d1: float, d2: float) -> float:
    a, b = d2 / 2.0, d1 / 2.0
    n = a + b
    q = b / n

    def energy(d):
        d = np.asarray(d, dtype=float)
        far = np.where(d > 30, d + math.log(q) + np.log1p((1 - q) / q * np.exp(-np.maximum(d, 30.0))), 0.0)
        return n * np.where(d > 30, far, np.log1p(q * np.expm1(np.minimum(d, 30.0)))) - b * d

    def slope(d):
        e = math.exp(min(d, 700.0))
        return n * q * e / (1 + q * math.expm1(min(d, 700.0))) - b

    scale = 0.5 * (math.log(a) + math.log(b) - math.log(2 * math.pi * n))
    return _upper_tail(energy, slope, a * b / n, scale + _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b), start)


def t_two_sided_scalar(t: float, dof: float) -> float:
    if t is None or math.isnan(t) or not dof > 0:
        return float("nan")
    if t == 0 or math.isinf(t):
        return 1.0 if t == 0 else 0.0
    return _f_tail(2 * math.log(abs(t)), 1.0, dof)


def _apply(fn, *series: pd.Series) -> pd.Series:
    vals = [fn(*(float(v) for v in row)) if not any(pd.isna(v) for v in row) else np.nan for row in zip(*series)]
    out = pd.Series(vals, dtype="float64")
    return out.where(~out.isna(), None)


@F.pandas_udf(DoubleType())
def _chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _apply(chi2_sf_scalar, x, dof)


@F.pandas_udf(DoubleType())
def _f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _apply(f_sf_scalar, f, d1, d2)


@F.pandas_udf(DoubleType())
def _t_sf_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _apply(t_two_sided_scalar, t, dof)


def chi2_sf(x: Column, dof: Column) -> Column:
    """P(χ²_dof > x)."""
    return _chi2_sf_udf(x.cast("double"), dof.cast("double"))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """P(F_{d1,d2} > f)."""
    return _f_sf_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T_dof| > |t|)."""
    return _t_sf_udf(t.cast("double"), dof.cast("double"))
