"""Catalogue entries: sources and sinks (S-family) as round trips of given tables, column-set and
label helpers (P2–P5, P9), constant caps and domains (F9, F11), arg-best (K5), model sink (S10)."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import clean as C
from quarry.operators import filters as FL
from quarry.operators import profile as P
from quarry.operators import regression as RG
from quarry.operators import relational as RL
from quarry.plans import entries_model as EM
from quarry.plans.catalog import R, register
from quarry.session import scratch_path
from quarry.sources import io as IO
from quarry.sources import views as V
from quarry.sources.tables import table

S, L = ("v_survey",), ("v_listings",)


def _place(spark, label):
    """A new folder in the shared checkpoint folder, and a table name to match."""
    name = f"{label}_{uuid.uuid4().hex}"
    return scratch_path(spark, name), name


@register("source_csv_roundtrip", "SELECT o_orderpriority, COUNT(*) AS n, " + R("SUM(o_totalprice)", "total")
          + ", COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def q_source_csv_roundtrip(spark, d):
    """S1 — orders written as CSV, read back with a declared schema."""
    path, _ = _place(spark, "orders_csv")
    table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]).write.csv(path, header=True)
    back = IO.read_csv(spark, path, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string")
    return back.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"),
                                               F.count_distinct("o_custkey").alias("customers"))


@register("source_replace_roundtrip", "SELECT COUNT(*) AS rows, 2 AS columns FROM customer")
def q_source_replace_roundtrip(spark, d):
    """S4, S9 — a replace-write leaves only the last content; its shape after the load."""
    path, _ = _place(spark, "customer")
    c = table(spark, d, "customer")
    IO.replace_table(c.select("c_custkey"), path)
    IO.replace_table(c.select("c_custkey", "c_name"), path)
    return IO.shape(spark.read.parquet(path))


@register("source_declared_table", "SELECT l_returnflag, COUNT(*) AS n, " + R("SUM(l_quantity)", "quantity") + " FROM lineitem GROUP BY 1")
def q_source_declared_table(spark, d):
    """S2, S5 — a table created with a declared schema, filled, and read by name."""
    path, name = _place(spark, "lineitem")
    IO.create_table(spark, name, T.StructType([T.StructField("l_returnflag", T.StringType()), T.StructField("l_quantity", T.DoubleType())]), path)
    table(spark, d, "lineitem", ["l_returnflag", "l_quantity"]).select("l_returnflag", F.col("l_quantity").cast("double")).write.insertInto(name)
    spark.catalog.refreshTable(name)
    return IO.read_table(spark, name).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@register("source_fallback_chain", "SELECT 'file' AS source, COUNT(*) AS n FROM orders UNION ALL "
          "SELECT 'csv' AS source, COUNT(*) AS n FROM customer UNION ALL SELECT 'table' AS source, COUNT(*) AS n FROM lineitem")
def q_source_fallback_chain(spark, d):
    """S3 — the first existing path; a folder of CSV files; the stored table before any path."""
    path, _ = _place(spark, "customer_csv")
    table(spark, d, "customer", ["c_custkey", "c_name"]).write.csv(path, header=True)
    stored, name = _place(spark, "lineitem")
    IO.create_table(spark, name, T.StructType([T.StructField("l_orderkey", T.LongType())]), stored)
    table(spark, d, "lineitem", ["l_orderkey"]).select(F.col("l_orderkey").cast("long")).write.insertInto(name)
    spark.catalog.refreshTable(name)
    gone = path + "_gone"
    found = [("file", IO.load_with_fallback(spark, None, [gone, f"{d}/orders.parquet"])),
             ("csv", IO.load_with_fallback(spark, "no_such_table", [gone, path], "c_custkey long, c_name string")),
             ("table", IO.load_with_fallback(spark, name, [path]))]
    return RL.stack_labelled([(k, df.agg(F.count("*").alias("n"))) for k, df in found], "source")


@register("source_catalog_listing", "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
          "WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS data_type, 1 AS listed, (SELECT COUNT(*) FROM customer) AS rows "
          "FROM (DESCRIBE SELECT c_custkey, c_name, c_acctbal FROM customer)")
def q_source_catalog_listing(spark, d):
    """S7 — the columns of a stored and filled table, its rows, and that the table is listed once."""
    path, name = _place(spark, "customer")
    c = table(spark, d, "customer", ["c_custkey", "c_name", "c_acctbal"])
    IO.create_table(spark, name, c.schema, path)
    c.write.insertInto(name)
    spark.catalog.refreshTable(name)
    listed = IO.list_tables(spark).where(F.col("name") == name).agg(F.count("*").alias("listed"))
    columns = IO.list_columns(spark, name).select("name", "data_type")
    return columns.withColumns({"listed": listed.scalar(), "rows": IO.read_table(spark, name).agg(F.count("*").alias("rows")).scalar()})


@register("source_head_tail", "(SELECT 'head' AS part, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL "
          "(SELECT 'tail' AS part, o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def q_source_head_tail(spark, d):
    """S8 — first and last rows by key."""
    o = table(spark, d, "orders", ["o_orderkey"])
    return RL.stack_labelled([("head", IO.head(o, "o_orderkey")), ("tail", IO.tail(o, "o_orderkey"))], "part")


@register("source_model_roundtrip", EM._HOLD + f"SELECT COUNT(*) AS n, {R('SUM(p)', 'predicted', 1)}, {R('MAX(p)', 'highest', EM.DIGITS)} FROM p", L)
def q_source_model_roundtrip(spark, d):
    """S10 — a saved pipeline, read back, predicts as the closed form does."""
    data = EM._data(spark, d)
    path, _ = _place(spark, "model")
    RG.save_model(RG.fit_pipeline(data.where(F.col("split") == "train"), "linear", **EM.ONE), path, EM.ONE["numeric"], spark)
    features = [r[0] for r in spark.read.parquet(path + "_features").collect()]           # the model's own feature list
    pred = RG.predict(PipelineModel.load(path), data.where(F.col("split") == "test"), features)
    return pred.agg(F.count("*").alias("n"), F.round(F.sum("prediction"), 1).alias("predicted"),
                    F.round(F.max("prediction"), EM.DIGITS).alias("highest"))


def _labels_sql(col, labels):
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items()) + " END"


@register("survey_labelled_groups", f"SELECT {_labels_sql('age', C.AGE_LABELS)} AS age, {_labels_sql('sex', C.SEX_LABELS)} AS sex, "
          f"{_labels_sql('target', C.CLASS_LABELS)} AS class, COUNT(*) AS n FROM v_survey GROUP BY 1, 2, 3", S)
def q_survey_labelled_groups(spark, d):
    """P2, P3, P9 — codes as labels, with the columns that the report needs required first."""
    s = C.require_columns(C.drop_if_present(V.survey(spark, d), ["bmi", "no_such_column"]), ["age", "sex", "target"])
    return s.groupBy(C.label_map("age", C.AGE_LABELS).alias("age"), C.label_map("sex", C.SEX_LABELS).alias("sex"),
                     C.label_map("target", C.CLASS_LABELS).alias("class")).agg(F.count("*").alias("n"))


@register("listings_numeric_sums", "SELECT " + ", ".join(R(f"SUM({c})", c) for c in
          ["price", "minimum_nights", "number_of_reviews", "reviews_per_month", "calculated_host_listings_count",
           "availability_365", "number_of_reviews_ltm"]) + " FROM v_listings", L)
def q_listings_numeric_sums(spark, d):
    """P4, P5 — the numeric columns without ids and positions, summed."""
    v = V.listings(spark, d)
    cols = C.exclude_roles(P.dtype_columns(v, "numeric"), {"id": ["id", "host_id"], "position": ["latitude", "longitude"]}, ("id", "position"))
    return v.agg(*[F.sum(c).alias(c) for c in cols])


@register("listings_price_capped_constant", "SELECT COUNT(*) AS n, " + R("MAX(price)", "highest") + " FROM v_listings WHERE price <= 200000", L)
def q_listings_price_capped_constant(spark, d):
    """F9 — rows up to a constant."""
    return FL.cap_at(V.listings(spark, d), "price", 200000).agg(F.count("*").alias("n"), F.max("price").alias("highest"))


@register("listings_room_type_domain", "SELECT DISTINCT room_type FROM v_listings WHERE room_type IS NOT NULL", L)
def q_listings_room_type_domain(spark, d):
    """F11 — distinct values of a filter."""
    return FL.domain_values(V.listings(spark, d), "room_type")


@register("listings_cheapest_room_type", "SELECT room_type, " + R("m", "price_mean") + " FROM (SELECT room_type, AVG(price) AS m FROM v_listings "
          "WHERE price IS NOT NULL GROUP BY room_type) ORDER BY m LIMIT 1", L)
def q_listings_cheapest_room_type(spark, d):
    """K5 — the label with the lowest metric."""
    means = V.listings(spark, d).where("price is not null").groupBy("room_type").agg(F.avg("price").alias("price_mean"))
    return RL.arg_best(means, "room_type", "price_mean")
