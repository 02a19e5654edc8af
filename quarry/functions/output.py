"""Result normalisation shared by catalogue queries (stable types for comparison)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def tidy(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Integers → BIGINT, booleans → BIGINT 0/1, fractions → DOUBLE rounded to ``digits``.

    ``+ 0.0`` folds a negative zero into 0.0 so equal results compare equal.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (_INTEGRAL, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(t, _FRACTIONAL):
            c = c.cast("double")
            if digits is not None:
                c = F.round(c, digits)
            c = c + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def maybe_round(c, digits: int | None):
    """``round(c, digits)`` unless ``digits`` is None (full precision)."""
    return c if digits is None else F.round(c, digits)
