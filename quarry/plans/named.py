"""The reference's named SQL reports (§2.16) as DataFrame plans over the stand-in views.

Each function takes the view DataFrame and ``digits`` (the reports round to 2 decimals for
display; ``None`` keeps full precision).  Top-k reports break ties on their keys so the
result is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.clean import host_profile
from quarry.functions.output import maybe_round
from quarry.operators import profile as P
from quarry.operators.relational import attach_metadata_rates



# ---------------------------------------------------------------- survey (classification) reports
def survey_total_rows(s: DataFrame) -> DataFrame:
    return P.total_rows(s, "total_rows")


def survey_class_share(s: DataFrame, digits: int | None = 2) -> DataFrame:
    return P.share_by(s.select(F.col("target").alias("class")), ["class"], "n", "pct", digits).orderBy("class")


def survey_means_by_class(s: DataFrame, cols=("bmi", "age", "gen_hlth", "ment_hlth", "phys_hlth", "income"),
                          digits: int | None = 2) -> DataFrame:
    return s.groupBy(F.col("target").alias("class")).agg(
        *[maybe_round(F.avg(c), digits).alias(f"avg_{c}") for c in cols]).orderBy("class")


def survey_rate_by(s: DataFrame, key: str, digits: int | None = 2) -> DataFrame:
    return P.rate_by(s, [key], "target", "total", "positives", "rate_pct", digits).orderBy(key)


def survey_high_risk_count(s: DataFrame, with_smoker: bool = False) -> DataFrame:
    cond = ((F.col("target") == 0) & (F.col("high_bp") == 1) & (F.col("high_chol") == 1)
            & (F.col("bmi") >= 30) & (F.col("phys_activity") == 0))
    if with_smoker:
        cond = cond & (F.col("smoker") == 1)
    return s.where(cond).agg(F.count("*").alias("high_risk"))


def survey_meta_single(s: DataFrame, meta: DataFrame, variable: str = "target",
                       digits: int | None = 4) -> DataFrame:
    """J2 — metadata of one variable next to the mean of that variable over all facts."""
    rate = s.agg(F.avg(F.col(variable).cast("double"))).scalar()     # scalar subquery, one scan
    return (meta.where(F.col("variable") == variable)
                .select("variable", "kind", maybe_round(rate, digits).alias("rate"))
                .orderBy("variable").limit(1))


# Variables that the prevalence report leaves out.
SURVEY_PREVALENCE_EXCLUDED = ["target", "sex", "chol_check", "fruits", "veggies", "hvy_alcohol",
                              "any_healthcare", "no_doc_cost"]


def survey_prevalence(s: DataFrame, meta: DataFrame, digits: int | None = 2) -> DataFrame:
    """J1 — prevalence % of each nominal risk factor next to its metadata, highest first."""
    rates = attach_metadata_rates(s, meta, kind="nominal", exclude=SURVEY_PREVALENCE_EXCLUDED,
                                  rate_name="prevalence_pct", digits=digits)
    return rates.orderBy(F.desc("prevalence_pct"), "variable")


def survey_bmi_by_sex_class(s: DataFrame, digits: int | None = 2) -> DataFrame:
    return s.groupBy(F.col("sex"), F.col("target").alias("class")).agg(
        F.count("*").alias("total"), maybe_round(F.avg("bmi"), digits).alias("bmi_avg"),
        maybe_round(F.min("bmi"), digits).alias("bmi_min"), maybe_round(F.max("bmi"), digits).alias("bmi_max")).orderBy("sex", "class")


# ---------------------------------------------------------------- listings (regression) reports
def listings_share_by_room_type(v: DataFrame, digits: int | None = 2) -> DataFrame:
    return P.share_by(v, ["room_type"], "total_listings", "pct", digits).orderBy(F.desc("total_listings"), "room_type")


def listings_price_by_room_type(v: DataFrame, digits: int | None = 2) -> DataFrame:
    return (v.where(F.col("price").isNotNull()).groupBy("room_type")
             .agg(F.count("price").alias("listings_with_price"),
                  maybe_round(F.avg("price"), digits).alias("price_avg"),
                  maybe_round(F.min("price"), digits).alias("price_min"),
                  maybe_round(F.max("price"), digits).alias("price_max"),
                  maybe_round(F.avg("minimum_nights"), digits).alias("min_nights_avg"))
             .orderBy(F.desc("price_avg"), "room_type"))


def listings_neighbourhood_activity(v: DataFrame, min_listings: int = 50, digits: int | None = 2) -> DataFrame:
    r1 = None if digits is None else 1
    g = (v.where(F.col("price").isNotNull()).groupBy("neighbourhood")
          .agg(F.count("*").alias("total_listings"),
               maybe_round(F.avg("price"), digits).alias("price_avg"),
               maybe_round(F.avg("availability_365"), r1).alias("availability_avg"),
               maybe_round(F.avg("number_of_reviews"), r1).alias("reviews_avg"),
               maybe_round(F.avg("reviews_per_month"), digits).alias("reviews_per_month_avg")))
    return g.where(F.col("total_listings") >= min_listings).orderBy(F.desc("price_avg"), "neighbourhood")   # HAVING on the alias


def listings_premium_available(v: DataFrame, min_price: float = 400000.0, min_availability: int = 300,
                               k: int = 20) -> DataFrame:
    return (v.where((F.col("price") > min_price) & (F.col("availability_365") > min_availability)
                    & F.col("price").isNotNull())
             .select("id", "name", "neighbourhood", "room_type", "price", "availability_365",
                     "number_of_reviews", F.col("calculated_host_listings_count").alias("host_listings"))
             .orderBy(F.col("price").desc(), F.col("id")).limit(k))


def listings_top_hosts(v: DataFrame, k: int = 15, digits: int | None = 2) -> DataFrame:
    r1 = None if digits is None else 1
    return (v.where(F.col("price").isNotNull()).groupBy("host_id", "host_name")
             .agg(F.count("*").alias("total_listings"),
                  maybe_round(F.avg("price"), digits).alias("price_avg"),
                  maybe_round(F.avg("availability_365"), r1).alias("availability_avg"),
                  maybe_round(F.avg("number_of_reviews"), r1).alias("reviews_avg"),
                  F.count_distinct("neighbourhood").alias("distinct_neighbourhoods"))
             .orderBy(F.col("total_listings").desc(), F.col("host_id"), F.col("host_name")).limit(k))


def listings_no_reviews(v: DataFrame, k: int = 15, digits: int | None = 2) -> DataFrame:
    r1 = None if digits is None else 1
    return (v.where((F.col("number_of_reviews") == 0) & F.col("last_review").isNull())
             .groupBy("neighbourhood", "room_type")
             .agg(F.count("*").alias("listings_without_reviews"),
                  maybe_round(F.avg("price"), digits).alias("price_avg"),
                  maybe_round(F.avg("availability_365"), r1).alias("availability_avg"))
             .orderBy(F.col("listings_without_reviews").desc(), "neighbourhood", "room_type").limit(k))


def listings_no_reviews_total(v: DataFrame) -> DataFrame:
    return v.where(F.col("number_of_reviews") == 0).agg(F.count("*").alias("total"))


def listings_global_summary(v: DataFrame, digits: int | None = 2) -> DataFrame:
    return v.agg(
        F.count("*").alias("total_listings"),
        F.count_distinct("host_id").alias("total_hosts"),
        F.count_distinct("neighbourhood").alias("total_neighbourhoods"),
        F.count("price").alias("listings_with_price"),
        maybe_round(F.avg("price"), digits).alias("price_avg"),
        maybe_round(F.avg("minimum_nights"), digits).alias("min_nights_avg"),
        maybe_round(F.avg("number_of_reviews"), digits).alias("reviews_avg"),
        maybe_round(F.avg("availability_365"), digits).alias("availability_avg"),
        maybe_round(F.avg("calculated_host_listings_count"), digits).alias("host_listings_avg"))


def listings_global_summary_long(v: DataFrame, digits: int | None = 2) -> DataFrame:
    """A13 + A14 — the global summary transposed to ``(metric, value)``."""
    return P.transpose_row(listings_global_summary(v, digits))


def listings_host_profile(v: DataFrame, digits: int | None = 2) -> DataFrame:
    r1 = None if digits is None else 1
    return (v.where(F.col("price").isNotNull())
             .withColumn("host_profile", host_profile(F.col("calculated_host_listings_count")))
             .groupBy("host_profile")
             .agg(F.count("*").alias("total_listings"), F.count_distinct("host_id").alias("total_hosts"),
                  maybe_round(F.avg("price"), digits).alias("price_avg"),
                  maybe_round(F.avg("availability_365"), r1).alias("availability_avg"),
                  maybe_round(F.avg("number_of_reviews"), r1).alias("reviews_avg"))
             .orderBy("host_profile"))
