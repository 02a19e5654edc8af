"""T12 — mutual information of a continuous variable and a class by nearest neighbours.

For a row with value x in a class of n_c rows, r is the distance to its k-th nearest other row of
the class and m the number of rows of any class nearer than r, itself included.  Then

    I = ψ(n) + mean(ψ(k) − ψ(n_c) − ψ(m)),  at least 0, in nats.

Work is done on value counts, so equal values are one row.  Two steps need an order, and neither
puts a whole class in one task:

* **k-th neighbour**: distinct values of a class are numbered (range partitions plus offsets), cut
  into blocks of fixed size, and each block also gets the k values on either side of it.
* **rows nearer than r**: the ends of every interval are sorted in between the values themselves,
  as rows that count nothing; the running count at both ends gives m.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranks import cumulative_counts, to_long, value_counts_long
from quarry.session import materialize

NEIGHBOURS = 3
#: Distinct values of one class in a block of the neighbour search.
BLOCK = 65536
#: Distances closer than this share of the magnitudes are rounding, hence equal.
ROUNDING = 2.0 ** -50


def digamma(m: Column) -> Column:
    """ψ of a positive integer: moved up by 8, then the asymptotic series (right to 1e-12)."""
    x = m.cast("double")
    y = x + 8
    s = 1 / (y * y)
    series = F.log(y) - 0.5 / y - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    for i in range(8):
        series = series - 1 / (x + i)
    return series


def kth_distances(counts: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """``(class, variable, value, c, n_class, k, r)`` from ``(class, variable, value, cnt)``: the
    distance r from a value to its k-th nearest other row of the class (all of them in a class of
    k rows or fewer; classes of one row have none and are left out)."""
    sizes = counts.groupBy("class", "variable").agg(F.sum("cnt").alias("n_class")).where("n_class > 1")
    placed = cumulative_counts(counts.withColumnRenamed("cnt", "c").withColumn("cnt", F.lit(1)), ["class"])
    i = F.col("cum_before")
    at = lambda shift: F.floor((i + shift) / F.lit(block))
    blocks = (placed.select("class", "variable", "value", "c", at(0).alias("_home"),
                            F.explode(F.array_distinct(F.array(at(-k), at(0), at(k)))).alias("_block")))
    w = Window.partitionBy("class", "variable", "_block").orderBy("value")
    near = [F.struct(F.lit(0.0).alias("d"), (F.col("c") - 1).alias("c"))]
    for j in range(1, k + 1):
        near += [F.struct((F.col("value") - F.lag("value", j).over(w)).alias("d"), F.lag("c", j).over(w).alias("c")),
                 F.struct((F.lead("value", j).over(w) - F.col("value")).alias("d"), F.lead("c", j).over(w).alias("c"))]
    found = (blocks.withColumn("_near", F.array(*near)).where(F.col("_block") == F.col("_home"))
             .join(sizes, ["class", "variable"])
             .withColumn("k", F.least(F.lit(k).cast("bigint"), F.col("n_class") - 1)))
    start = F.struct(F.lit(0).cast("bigint").alias("have"), F.lit(None).cast("double").alias("r"))

    def step(acc, x):
        have = acc["have"] + x["c"]
        return F.struct(have.alias("have"), F.coalesce(acc["r"], F.when(have >= F.col("k"), x["d"])).alias("r"))

    ordered = F.array_sort(F.filter("_near", lambda x: x["d"].isNotNull()))
    return found.select("class", "variable", "value", "c", "n_class", "k", F.aggregate(ordered, start, step)["r"].alias("r"))


def neighbour_information(df: DataFrame, cols: Sequence[str], target: str, k: int = NEIGHBOURS,
                          block: int = BLOCK) -> DataFrame:
    """T12 — ``(variable, n, mi)`` of each column with the classes of ``target`` (see the module).

    Rows whose value is null or not finite, or whose class is null, and classes of one row take no part;
    n counts the rest, and a column without any is left out.  No noise is added: equal values
    are neighbours at distance 0, and then m counts the rows of that very value.
    """
    long = to_long(df.withColumn("class", F.col(target).cast("string")), cols, ["class"])
    finite = long.where(F.col("class").isNotNull() & (F.abs("value") < float("inf")))
    counts = materialize(value_counts_long(finite, ["class"]))
    kth = materialize(kth_distances(counts, k, block))
    slack = F.lit(ROUNDING) * (F.abs("value") + F.col("r"))
    row = F.struct("class", "value", "c", "n_class", "k").alias("row")
    low, high = F.least(F.col("value"), F.col("value") - F.col("r") + slack), F.greatest(F.col("value"), F.col("value") + F.col("r") - slack)
    none = F.lit(0).cast("bigint")
    # at one value: lower ends come before the rows of that value, upper ends after them
    ends = kth.select("variable", F.explode(F.array(
        F.struct(F.struct(low.alias("x"), F.lit(0).alias("side")).alias("at"), none.alias("cnt"), row),
        F.struct(F.struct(high.alias("x"), F.lit(2).alias("side")).alias("at"), none.alias("cnt"), row))).alias("e")).select("variable", "e.*")
    values = (kth.groupBy("variable", "value").agg(F.sum("c").alias("cnt"))
              .select("variable", F.struct(F.col("value").alias("x"), F.lit(1).alias("side")).alias("at"), "cnt"))
    running = cumulative_counts(values.unionByName(ends, allowMissingColumns=True), value="at")
    signed = F.when(F.col("at.side") == 2, F.col("cum_before")).otherwise(-F.col("cum_before"))
    inside = (running.where(F.col("row").isNotNull()).groupBy("variable", "row").agg(F.sum(signed).alias("m"))
              .select("variable", "row.*", "m"))
    term = F.col("c") * (digamma(F.col("k")) - digamma(F.col("n_class")) - digamma(F.col("m")))
    total = inside.groupBy("variable").agg(F.sum("c").alias("n"), F.sum(term).alias("_t"))
    return total.select("variable", "n", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("_t") / F.col("n")).alias("mi"))
