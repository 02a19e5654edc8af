"""Scans, sinks and catalog helpers (S-family)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared schema of the listings table (id INTEGER PK … number_of_reviews_ltm INTEGER).
LISTINGS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("host_id", T.LongType()),
    T.StructField("host_name", T.StringType()),
    T.StructField("neighbourhood_group", T.StringType()),
    T.StructField("neighbourhood", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("room_type", T.StringType()),
    T.StructField("price", T.StringType()),          # may arrive as "$1,200.00": clean with P6
    T.StructField("minimum_nights", T.LongType()),
    T.StructField("number_of_reviews", T.LongType()),
    T.StructField("last_review", T.StringType()),    # parse with P7
    T.StructField("reviews_per_month", T.DoubleType()),
    T.StructField("calculated_host_listings_count", T.LongType()),
    T.StructField("availability_365", T.LongType()),
    T.StructField("number_of_reviews_ltm", T.LongType()),
    T.StructField("license", T.StringType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",",
             nan_value: str = "NaN") -> DataFrame:
    """S1 — CSV scan with a header.  An explicit schema avoids the inference pass (and keeps
    declared types); ``NaN`` text becomes NULL so NaN never enters as a value.  Fields that do not
    fit their type become NULL; ask for a ``_corrupt_record string`` column in the schema to see
    the rows they come from."""
    r = spark.read.option("header", True).option("sep", sep).option("nanValue", nan_value).option("mode", "PERMISSIVE")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    fixed = [F.nanvl(F.col(f.name), F.lit(None)).alias(f.name)
             if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields]
    return df.select(*fixed)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """S2 — ``SELECT * FROM t`` (column pruning still applies downstream)."""
    return spark.table(name)


def load_with_fallback(spark: SparkSession, table_name: str | None, paths: Sequence[str],
                       schema: T.StructType | str | None = None) -> DataFrame:
    """S3 — the stored table when it exists, else the first existing path, on any file system
    that Spark reaches: CSV if the file, or a file of the folder, is named so, else parquet."""
    if table_name and spark.catalog.tableExists(table_name):
        return spark.table(table_name)
    for p in paths:
        names = _names_at(spark, p)
        if names is not None:
            text = any(n.lower().endswith((".csv", ".csv.gz")) for n in names)
            return read_csv(spark, p, schema) if text else spark.read.parquet(p)
    raise FileNotFoundError(f"no table {table_name!r} and none of {list(paths)} exists")


def _names_at(spark: SparkSession, path: str) -> list[str] | None:
    """File names at a path, by the Hadoop file system that serves it; None if it does not exist."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else None


def replace_table(df: DataFrame, target: str, as_table: bool = False, partition_by: Sequence[str] = ()) -> None:
    """S4 — replace-write (overwrite) to a parquet path or a managed table."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    (w.saveAsTable(target) if as_table else w.parquet(target))


def create_table(spark: SparkSession, name: str, schema: T.StructType, location: str | None = None) -> None:
    """S5 — drop-if-exists, then create an empty table with the declared schema (kept, unlike a
    replace-load that re-derives types)."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path=location, source="parquet", schema=schema)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """S6 — a small literal dimension table (e.g. variable metadata)."""
    return spark.createDataFrame(list(rows), schema)


def list_columns(spark: SparkSession, table_name: str) -> DataFrame:
    """S7 — column list of a catalog table: ``(name, data_type, nullable)``."""
    cols = spark.catalog.listColumns(table_name)
    return spark.createDataFrame([(c.name, c.dataType, c.nullable) for c in cols],
                                 "name string, data_type string, nullable boolean")


def list_tables(spark: SparkSession) -> DataFrame:
    """S7 — table list of the current database."""
    return spark.createDataFrame([(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()],
                                 "name string, table_type string, is_temporary boolean")


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """S8 — first ``n`` rows by an explicit key (a DataFrame has no row order)."""
    return df.orderBy(F.col(key)).limit(n)


def tail(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """S8 — last ``n`` rows by an explicit key."""
    return df.orderBy(F.col(key).desc()).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """S9 — ``(rows, columns)`` after a load or write."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))
