"""Stand-in views that give the driver tables the shape of the two analysed datasets.

* ``listings``  — one row per order (regression table: price target, host, area, room type).
* ``survey``    — one row per line item (classification survey: binary target, 0/1 risk
  factors, ordinal and continuous measures).
* ``survey_meta`` — variable dictionary for ``survey`` (fixed list of the view's columns).
* ``docs``      — documents LEFT JOIN labels (natural missingness in quality / toxic).

Each view is defined twice with the same semantics: as a lazy Spark plan and as SQL text for
the independent DuckDB oracle (``*_SQL``).  All integer outputs are BIGINT on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table

# Fixed values of the stand-in definitions.
RECENT_SHIPDATE = "2000-11-04"      # "reviews in the last twelve months" cut-off
PRICE_NULL_EVERY = 8                # price is missing when id % 8 = 0


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation, LEFT JOIN per-order line-item aggregates, plus per-host counts.

    Join plan: line items are aggregated by order key first (partial + final aggregate, so the
    line-item scan is reduced before any shuffle), then joined to orders.  Customer and the
    per-host count both join on the customer key, so they share one partitioning.  ``nation``
    is a 25-row dimension; all joins are left to the optimizer's size-checked broadcast threshold
    and AQE.
    """
    o = table(spark, sf_dir, "orders",
              ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey"])
    n = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    li = (table(spark, sf_dir, "lineitem", ["l_orderkey", "l_shipdate", "l_quantity", "l_linenumber"])
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("_n_items"),
               F.max("l_shipdate").alias("_last_ship"),
               F.sum("l_quantity").alias("_qty"),
               F.max("l_linenumber").alias("_max_line"),
               F.count_if(F.col("l_shipdate") >= F.lit(RECENT_SHIPDATE).cast("timestamp_ntz"))
                .alias("_n_recent")))
    hosts = o.groupBy(F.col("o_custkey").alias("_hk")).agg(F.count(F.lit(1)).alias("_host_n"))

    j = (o.join(li, o.o_orderkey == li.l_orderkey, "left")
          .join(c, F.col("o_custkey") == c.c_custkey, "inner")
          .join(hosts, F.col("o_custkey") == hosts._hk, "left")     # always matches; left out where its count is not read
          .join(n, F.col("c_nationkey") == n.n_nationkey, "inner"))
    idc = F.col("o_orderkey")
    return j.select(
        idc.alias("id"),
        F.concat(F.lit("listing-"), idc.cast("string")).alias("name"),
        F.col("o_custkey").alias("host_id"),
        F.col("c_name").alias("host_name"),
        F.col("n_name").alias("neighbourhood"),
        (F.lit(19.0) + (idc % 1000) / F.lit(1000.0)).alias("latitude"),
        (F.lit(-99.5) + (idc % 997) / F.lit(997.0)).alias("longitude"),
        F.col("o_orderpriority").alias("room_type"),
        F.when(idc % PRICE_NULL_EVERY == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice")).alias("price"),
        F.coalesce(F.col("_max_line").cast("bigint"), F.lit(1).cast("bigint")).alias("minimum_nights"),
        F.coalesce(F.col("_n_items"), F.lit(0).cast("bigint")).alias("number_of_reviews"),
        F.col("_last_ship").alias("last_review"),
        (F.col("_qty") / F.lit(12.0)).alias("reviews_per_month"),
        F.col("_host_n").alias("calculated_host_listings_count"),
        F.least(F.lit(365), F.dayofyear("o_orderdate")).cast("bigint").alias("availability_365"),
        F.coalesce(F.col("_n_recent"), F.lit(0).cast("bigint")).alias("number_of_reviews_ltm"),
    )


LISTINGS_SQL = f"""
SELECT o.o_orderkey AS id,
       'listing-' || CAST(o.o_orderkey AS VARCHAR) AS name,
       o.o_custkey AS host_id,
       c.c_name AS host_name,
       n.n_name AS neighbourhood,
       19.0 + (o.o_orderkey % 1000) / 1000.0 AS latitude,
       -99.5 + (o.o_orderkey % 997) / 997.0 AS longitude,
       o.o_orderpriority AS room_type,
       CASE WHEN o.o_orderkey % {PRICE_NULL_EVERY} = 0 THEN NULL ELSE o.o_totalprice END AS price,
       CAST(COALESCE(li.max_line, 1) AS BIGINT) AS minimum_nights,
       CAST(COALESCE(li.n_items, 0) AS BIGINT) AS number_of_reviews,
       li.last_ship AS last_review,
       li.qty / 12.0 AS reviews_per_month,
       h.host_n AS calculated_host_listings_count,
       CAST(LEAST(365, dayofyear(o.o_orderdate)) AS BIGINT) AS availability_365,
       CAST(COALESCE(li.n_recent, 0) AS BIGINT) AS number_of_reviews_ltm
FROM orders o
LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n_items, MAX(l_shipdate) AS last_ship,
                  SUM(l_quantity) AS qty, MAX(l_linenumber) AS max_line,
                  COUNT(*) FILTER (WHERE l_shipdate >= TIMESTAMP '{RECENT_SHIPDATE}') AS n_recent
           FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN (SELECT o_custkey AS hk, COUNT(*) AS host_n FROM orders GROUP BY o_custkey) h ON h.hk = o.o_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
"""


# Binary survey factors: (name, Spark predicate on line-item columns, SQL predicate).
_SURVEY_BINARY = [
    ("high_bp", lambda: F.col("l_linestatus") == "O", "l_linestatus = 'O'"),
    ("high_chol", lambda: F.col("l_returnflag") == "R", "l_returnflag = 'R'"),
    ("chol_check", lambda: F.col("l_orderkey") % 10 != 0, "l_orderkey % 10 <> 0"),
    ("smoker", lambda: F.col("l_partkey") % 2 == 1, "l_partkey % 2 = 1"),
    ("stroke", lambda: F.col("l_partkey") % 7 == 0, "l_partkey % 7 = 0"),
    ("heart_disease", lambda: F.col("l_suppkey") % 11 == 0, "l_suppkey % 11 = 0"),
    ("phys_activity", lambda: F.col("l_suppkey") % 3 != 0, "l_suppkey % 3 <> 0"),
    ("fruits", lambda: F.col("l_partkey") % 3 == 0, "l_partkey % 3 = 0"),
    ("veggies", lambda: F.col("l_partkey") % 5 != 0, "l_partkey % 5 <> 0"),
    ("hvy_alcohol", lambda: F.col("l_suppkey") % 13 == 0, "l_suppkey % 13 = 0"),
    ("any_healthcare", lambda: F.col("l_orderkey") % 20 != 0, "l_orderkey % 20 <> 0"),
    ("no_doc_cost", lambda: F.col("l_orderkey") % 9 == 0, "l_orderkey % 9 = 0"),
    ("diff_walk", lambda: F.col("l_orderkey") % 5 == 0, "l_orderkey % 5 = 0"),
]

SURVEY_TARGET = "target"
SURVEY_NOMINAL = [name for name, _, _ in _SURVEY_BINARY] + ["sex"]
SURVEY_ORDINAL = ["gen_hlth", "age", "education", "income"]
SURVEY_DISCRETE = ["ment_hlth", "phys_hlth"]
SURVEY_CONTINUOUS = ["bmi"]
SURVEY_KEY = "rid"


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; ``rid`` is a unique string key (order|line|part|price-cents)."""
    li = table(spark, sf_dir, "lineitem",
               ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
    target = (F.col("l_quantity") + F.when(F.col("l_linestatus") == "O", 10).otherwise(0)
              + 2 * F.col("l_linenumber") > 55)
    cols = [
        F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"),
                    F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")).alias(SURVEY_KEY),
        target.cast("bigint").alias(SURVEY_TARGET),
    ]
    cols += [pred().cast("bigint").alias(name) for name, pred, _ in _SURVEY_BINARY]
    cols += [
        (F.col("l_orderkey") % 2).cast("bigint").alias("sex"),
        F.col("l_quantity").alias("bmi"),
        (F.col("l_partkey") % 31).cast("bigint").alias("ment_hlth"),
        (F.col("l_suppkey") % 31).cast("bigint").alias("phys_hlth"),
        (F.col("l_suppkey") % 5 + 1).cast("bigint").alias("gen_hlth"),
        F.col("l_linenumber").cast("bigint").alias("age"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("income"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("education"),
    ]
    return li.select(*cols)


SURVEY_SQL = (
    "SELECT CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' || "
    "CAST(l_partkey AS VARCHAR) || '|' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS rid, "
    "CAST(CASE WHEN l_quantity + CASE WHEN l_linestatus = 'O' THEN 10 ELSE 0 END + 2 * l_linenumber > 55 "
    "THEN 1 ELSE 0 END AS BIGINT) AS target, "
    + ", ".join(f"CAST(CASE WHEN {sql} THEN 1 ELSE 0 END AS BIGINT) AS {name}" for name, _, sql in _SURVEY_BINARY)
    + ", CAST(l_orderkey % 2 AS BIGINT) AS sex, l_quantity AS bmi, "
    "CAST(l_partkey % 31 AS BIGINT) AS ment_hlth, CAST(l_suppkey % 31 AS BIGINT) AS phys_hlth, "
    "CAST(l_suppkey % 5 + 1 AS BIGINT) AS gen_hlth, CAST(l_linenumber AS BIGINT) AS age, "
    "CAST(round(l_tax * 100) AS BIGINT) AS income, CAST(round(l_discount * 100) AS BIGINT) AS education "
    "FROM lineitem"
)

# Variable dictionary of the survey view (variable, description, kind).
SURVEY_META_ROWS = [
    ("target", "Diabetes / prediabetes indicator (class)", "nominal"),
    ("high_bp", "High blood pressure", "nominal"),
    ("high_chol", "High cholesterol", "nominal"),
    ("chol_check", "Cholesterol check in the last five years", "nominal"),
    ("bmi", "Body mass index", "continuous"),
    ("smoker", "Smoked at least 100 cigarettes", "nominal"),
    ("stroke", "Ever had a stroke", "nominal"),
    ("heart_disease", "Coronary heart disease or infarction", "nominal"),
    ("phys_activity", "Physical activity in the last 30 days", "nominal"),
    ("fruits", "Eats fruit daily", "nominal"),
    ("veggies", "Eats vegetables daily", "nominal"),
    ("hvy_alcohol", "Heavy alcohol consumption", "nominal"),
    ("any_healthcare", "Has any health coverage", "nominal"),
    ("no_doc_cost", "Could not see a doctor because of cost", "nominal"),
    ("gen_hlth", "General health 1-5", "ordinal"),
    ("ment_hlth", "Days of poor mental health", "discrete"),
    ("phys_hlth", "Days of poor physical health", "discrete"),
    ("diff_walk", "Difficulty walking", "nominal"),
    ("sex", "Sex", "nominal"),
    ("age", "Age group", "ordinal"),
    ("education", "Education level", "ordinal"),
    ("income", "Income level", "ordinal"),
]


def survey_meta(spark: SparkSession) -> DataFrame:
    """Literal dimension table (22 rows): variable, description, kind."""
    return spark.createDataFrame(SURVEY_META_ROWS, "variable string, description string, kind string")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SURVEY_META_SQL = ("SELECT * FROM (VALUES "
                   + ", ".join(f"({_sql_str(a)}, {_sql_str(b)}, {_sql_str(c)})" for a, b, c in SURVEY_META_ROWS)
                   + ") AS m(variable, description, kind)")


def docs(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """documents LEFT JOIN labels on doc_id; the text column only if asked for."""
    text = ["text"] if with_text else []
    d = table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars", *text])
    lab = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    return (d.join(lab, "doc_id", "left")
             .select("doc_id", "lang", "source", "n_chars", *text,
                     F.col("quality").cast("bigint").alias("quality"),
                     F.col("toxic").cast("bigint").alias("toxic")))


DOCS_SQL = ("SELECT d.doc_id, d.lang, d.source, d.n_chars, CAST(l.quality AS BIGINT) AS quality, "
            "CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")

DOCS_TEXT_SQL = DOCS_SQL.replace("d.n_chars,", "d.n_chars, d.text,")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream table (event_id, ts, user_id, event_type, value); ``props`` pruned."""
    return table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])


EVENTS_SQL = "SELECT event_id, ts, user_id, event_type, value FROM events"

VIEW_SQL = {
    "v_listings": LISTINGS_SQL,
    "v_survey": SURVEY_SQL,
    "v_survey_meta": SURVEY_META_SQL,
    "v_docs": DOCS_SQL,
    "v_docs_text": DOCS_TEXT_SQL,
    "v_events": EVENTS_SQL,
}


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs of the stand-in views it uses."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    head = sql.lstrip()
    if head[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{head[5:]}"
    return f"WITH {ctes}\n{sql}"
