"""Deterministic sampling and splitting (R-family).

numpy / scikit-learn draws are not reproducible across engines or partitionings, so every draw
is a pure function of ``(seed, key)``: the first 8 hex digits of ``md5(seed|key)`` read as an
integer.  The same rule is bit-identical in Spark and in the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_draw(key: Column | str, seed: int = 42, salt: str | None = None) -> Column:
    """Integer in [0, 2^32): ``conv(substr(md5('seed|[salt|]key'), 1, 8), 16, 10)``."""
    key = F.col(key) if isinstance(key, str) else key
    parts = [F.lit(str(seed))] + ([F.lit(salt)] if salt is not None else []) + [key.cast("string")]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """R1 — exactly ``min(n, N)`` rows without replacement: those of the ``n`` smallest draws, in no
    order; of rows that share the last draw the smallest keys.

    The n-th draw is found by counts, first of draws by their upper 16 bits, then of the draws that
    agree in these; both scans read the key alone, run when this is called, and shuffle 65,536
    counts at most.  The rows are then filtered where they lie, whatever ``n`` is.  Only rows
    whose draw equals the last one are ordered: of distinct keys, one in 2^32."""
    if n <= 0:
        return df.limit(0)
    draw = hash_draw(key, seed)
    cut, before = 0, 0
    for shift, inside in ((16, F.lit(True)), (0, None)):
        inside = F.shiftright(draw, 16) == cut if inside is None else inside
        counts = df.where(inside).groupBy(F.shiftright(draw, shift).alias("b")).agg(F.count("*").alias("cnt"))
        upto = F.sum("cnt").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.select("b", (upto - F.col("cnt") + before).alias("before"), (upto + before).alias("upto")).where(F.col("upto") >= n)
        found = found.agg(F.min(F.struct("b", "before"))).first()[0]
        if found is None:
            return df                                       # fewer than n rows
        cut, before = found
    last = df.where(draw == cut).orderBy(F.col(key)).limit(n - before)
    return df.where(draw < cut).unionAll(last)


def train_test_split(df: DataFrame, key: str, train_pct: int = 70, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """R2 — hash-bucket split; stable under repartitioning (unlike ``randomSplit``)."""
    b = hash_draw(key, seed) % 100
    return df.where(b < train_pct), df.where(b >= train_pct)


def with_split(df: DataFrame, key: str, train_pct: int = 70, seed: int = 42, name: str = "split") -> DataFrame:
    """R2 as a column: ``'train'`` / ``'test'``."""
    return df.withColumn(name, F.when(hash_draw(key, seed) % 100 < train_pct, F.lit("train")).otherwise(F.lit("test")))


def with_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """R3 — fold id ``md5(seed|fold|key) % k`` (salted so folds are independent of the R2 split;
    usable as ``CrossValidator(foldCol=…)``)."""
    return df.withColumn(name, (hash_draw(key, seed, salt="fold") % k).cast("int"))
