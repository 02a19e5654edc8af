"""Catalogue entries: the reference's named SQL reports (§2.16) and the stand-in views."""

from __future__ import annotations

from quarry.plans import named as N
from quarry.plans.catalog import I, R, register
from quarry.sources import views as V

S, M, L = ("v_survey",), ("v_survey", "v_survey_meta"), ("v_listings",)


# ------------------------------------------------------------------------------------ survey
@register("survey_total_rows", "SELECT COUNT(*) AS total_rows FROM v_survey", S)
def q_survey_total_rows(spark, d):
    return N.survey_total_rows(V.survey(spark, d))


@register("survey_class_share",
          f"SELECT target AS class, COUNT(*) AS n, "
          f"{R('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM v_survey)', 'pct')} "
          f"FROM v_survey GROUP BY target", S)
def q_survey_class_share(spark, d):
    return N.survey_class_share(V.survey(spark, d), digits=None)


_MEANS6 = ("bmi", "age", "gen_hlth", "ment_hlth", "phys_hlth", "income")
_MEANS4 = ("bmi", "ment_hlth", "phys_hlth", "age")


@register("survey_means_by_class",
          "SELECT target AS class, " + ", ".join(R(f"AVG({c})", f"avg_{c}") for c in _MEANS6)
          + " FROM v_survey GROUP BY target", S)
def q_survey_means_by_class(spark, d):
    return N.survey_means_by_class(V.survey(spark, d), _MEANS6, digits=None)


@register("survey_means_by_class_short",
          "SELECT target AS class, " + ", ".join(R(f"AVG({c})", f"avg_{c}") for c in _MEANS4)
          + " FROM v_survey GROUP BY target", S)
def q_survey_means_by_class_short(spark, d):
    return N.survey_means_by_class(V.survey(spark, d), _MEANS4, digits=None)


def _rate_sql(key: str) -> str:
    return (f"SELECT {key}, COUNT(*) AS total, {I('SUM(target)', 'positives')}, "
            f"{R('SUM(target) * 100.0 / COUNT(*)', 'rate_pct')} FROM v_survey GROUP BY {key}")


@register("survey_rate_by_age", _rate_sql("age"), S)
def q_survey_rate_by_age(spark, d):
    return N.survey_rate_by(V.survey(spark, d), "age", digits=None)


@register("survey_rate_by_income", _rate_sql("income"), S)
def q_survey_rate_by_income(spark, d):
    return N.survey_rate_by(V.survey(spark, d), "income", digits=None)


@register("survey_rate_by_education_income",
          f"SELECT education, income, COUNT(*) AS total, {I('SUM(target)', 'positives')}, "
          f"{R('SUM(target) * 100.0 / COUNT(*)', 'rate_pct')} FROM v_survey GROUP BY education, income", S)
def q_survey_rate_by_education_income(spark, d):
    from quarry.operators.profile import rate_by
    return rate_by(V.survey(spark, d), ["education", "income"], "target")


_RISK5 = "target = 0 AND high_bp = 1 AND high_chol = 1 AND bmi >= 30 AND phys_activity = 0"


@register("survey_high_risk_count", f"SELECT COUNT(*) AS high_risk FROM v_survey WHERE {_RISK5}", S)
def q_survey_high_risk_count(spark, d):
    return N.survey_high_risk_count(V.survey(spark, d))


@register("survey_high_risk_smoker_count",
          f"SELECT COUNT(*) AS high_risk FROM v_survey WHERE {_RISK5} AND smoker = 1", S)
def q_survey_high_risk_smoker_count(spark, d):
    return N.survey_high_risk_count(V.survey(spark, d), with_smoker=True)


@register("survey_meta_single",
          f"SELECT m.variable, m.kind, {R('AVG(CAST(d.target AS DOUBLE))', 'rate')} "
          f"FROM v_survey_meta m JOIN v_survey d ON 1=1 WHERE m.variable = 'target' "
          f"GROUP BY m.variable, m.kind LIMIT 1", M)
def q_survey_meta_single(spark, d):
    return N.survey_meta_single(V.survey(spark, d), V.survey_meta(spark), digits=None)


_PREV_VARS = ["high_bp", "high_chol", "smoker", "stroke", "heart_disease", "phys_activity", "diff_walk"]
_EXCL = ", ".join(f"'{v}'" for v in N.SURVEY_PREVALENCE_EXCLUDED)


@register("survey_prevalence_by_factor",
          "SELECT m.variable, m.description, m.kind, "
          + R("AVG(CASE m.variable " + " ".join(f"WHEN '{v}' THEN d.{v}" for v in _PREV_VARS) + " END) * 100",
              "prevalence_pct")
          + " FROM v_survey_meta m JOIN v_survey d ON 1=1 WHERE m.kind = 'nominal' "
          f"AND m.variable NOT IN ({_EXCL}) GROUP BY m.variable, m.description, m.kind", M)
def q_survey_prevalence_by_factor(spark, d):
    return N.survey_prevalence(V.survey(spark, d), V.survey_meta(spark), digits=None)


@register("survey_bmi_by_sex_class",
          f"SELECT sex, target AS class, COUNT(*) AS total, {R('AVG(bmi)', 'bmi_avg')}, "
          f"{R('MIN(bmi)', 'bmi_min')}, {R('MAX(bmi)', 'bmi_max')} FROM v_survey GROUP BY sex, target", S)
def q_survey_bmi_by_sex_class(spark, d):
    return N.survey_bmi_by_sex_class(V.survey(spark, d), digits=None)


# ------------------------------------------------------------------------------------ listings
@register("listings_share_by_room_type",
          f"SELECT room_type, COUNT(*) AS total_listings, "
          f"{R('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM v_listings)', 'pct')} "
          f"FROM v_listings GROUP BY room_type", L)
def q_listings_share_by_room_type(spark, d):
    return N.listings_share_by_room_type(V.listings(spark, d), digits=None)


@register("listings_total_rows", "SELECT COUNT(*) AS total_rows FROM v_listings", L)
def q_listings_total_rows(spark, d):
    from quarry.operators.profile import total_rows
    return total_rows(V.listings(spark, d))


@register("listings_price_by_room_type",
          f"SELECT room_type, COUNT(price) AS listings_with_price, {R('AVG(price)', 'price_avg')}, "
          f"{R('MIN(price)', 'price_min')}, {R('MAX(price)', 'price_max')}, "
          f"{R('AVG(minimum_nights)', 'min_nights_avg')} FROM v_listings WHERE price IS NOT NULL "
          f"GROUP BY room_type", L)
def q_listings_price_by_room_type(spark, d):
    return N.listings_price_by_room_type(V.listings(spark, d), digits=None)


@register("listings_neighbourhood_activity",
          f"SELECT neighbourhood, COUNT(*) AS total_listings, {R('AVG(price)', 'price_avg')}, "
          f"{R('AVG(availability_365)', 'availability_avg')}, {R('AVG(number_of_reviews)', 'reviews_avg')}, "
          f"{R('AVG(reviews_per_month)', 'reviews_per_month_avg')} FROM v_listings WHERE price IS NOT NULL "
          f"GROUP BY neighbourhood HAVING COUNT(*) >= 50", L)
def q_listings_neighbourhood_activity(spark, d):
    return N.listings_neighbourhood_activity(V.listings(spark, d), 50, digits=None)


@register("listings_premium_available",
          f"SELECT id, name, neighbourhood, room_type, {R('price', 'price')}, availability_365, "
          f"number_of_reviews, calculated_host_listings_count AS host_listings FROM v_listings "
          f"WHERE price > 400000 AND availability_365 > 300 AND price IS NOT NULL "
          f"ORDER BY price DESC, id LIMIT 20", L)
def q_listings_premium_available(spark, d):
    return N.listings_premium_available(V.listings(spark, d))


@register("listings_top_hosts",
          f"SELECT host_id, host_name, COUNT(*) AS total_listings, {R('AVG(price)', 'price_avg')}, "
          f"{R('AVG(availability_365)', 'availability_avg')}, {R('AVG(number_of_reviews)', 'reviews_avg')}, "
          f"COUNT(DISTINCT neighbourhood) AS distinct_neighbourhoods FROM v_listings WHERE price IS NOT NULL "
          f"GROUP BY host_id, host_name ORDER BY total_listings DESC, host_id, host_name LIMIT 15", L)
def q_listings_top_hosts(spark, d):
    return N.listings_top_hosts(V.listings(spark, d), digits=None)


@register("listings_no_reviews_by_area_room",
          f"SELECT neighbourhood, room_type, COUNT(*) AS listings_without_reviews, "
          f"{R('AVG(price)', 'price_avg')}, {R('AVG(availability_365)', 'availability_avg')} "
          f"FROM v_listings WHERE number_of_reviews = 0 AND last_review IS NULL "
          f"GROUP BY neighbourhood, room_type "
          f"ORDER BY listings_without_reviews DESC, neighbourhood, room_type LIMIT 15", L)
def q_listings_no_reviews_by_area_room(spark, d):
    return N.listings_no_reviews(V.listings(spark, d), digits=None)


@register("listings_no_reviews_total",
          "SELECT COUNT(*) AS total FROM v_listings WHERE number_of_reviews = 0", L)
def q_listings_no_reviews_total(spark, d):
    return N.listings_no_reviews_total(V.listings(spark, d))


_SUMMARY = [("COUNT(*)", "total_listings", "i"), ("COUNT(DISTINCT host_id)", "total_hosts", "i"),
            ("COUNT(DISTINCT neighbourhood)", "total_neighbourhoods", "i"),
            ("COUNT(price)", "listings_with_price", "i"), ("AVG(price)", "price_avg", "d"),
            ("AVG(minimum_nights)", "min_nights_avg", "d"), ("AVG(number_of_reviews)", "reviews_avg", "d"),
            ("AVG(availability_365)", "availability_avg", "d"),
            ("AVG(calculated_host_listings_count)", "host_listings_avg", "d")]


@register("listings_global_summary",
          "SELECT " + ", ".join(I(e, a) if t == "i" else R(e, a) for e, a, t in _SUMMARY) + " FROM v_listings", L)
def q_listings_global_summary(spark, d):
    return N.listings_global_summary(V.listings(spark, d), digits=None)


@register("listings_global_summary_long",
          "SELECT metric, " + R("value", "value") + " FROM (SELECT "
          + ", ".join(f"CAST({e} AS DOUBLE) AS {a}" for e, a, _ in _SUMMARY)
          + " FROM v_listings) UNPIVOT (value FOR metric IN ("
          + ", ".join(a for _, a, _ in _SUMMARY) + "))", L)
def q_listings_global_summary_long(spark, d):
    return N.listings_global_summary_long(V.listings(spark, d), digits=None)


@register("listings_host_profile",
          "SELECT CASE WHEN calculated_host_listings_count = 1 THEN '1. casual (1 listing)' "
          "WHEN calculated_host_listings_count BETWEEN 2 AND 5 THEN '2. semi-professional (2-5)' "
          "WHEN calculated_host_listings_count BETWEEN 6 AND 10 THEN '3. active (6-10)' "
          "ELSE '4. professional (>10)' END AS host_profile, COUNT(*) AS total_listings, "
          f"COUNT(DISTINCT host_id) AS total_hosts, {R('AVG(price)', 'price_avg')}, "
          f"{R('AVG(availability_365)', 'availability_avg')}, {R('AVG(number_of_reviews)', 'reviews_avg')} "
          "FROM v_listings WHERE price IS NOT NULL GROUP BY host_profile", L)
def q_listings_host_profile(spark, d):
    return N.listings_host_profile(V.listings(spark, d), digits=None)


@register("listings_clean_roundtrip",
          "SELECT COUNT(p) AS n_price, " + R("AVG(p)", "price_avg") + ", COUNT(lr) AS n_last_review, "
          "COUNT(DISTINCT CAST(lr AS DATE)) AS distinct_review_days FROM (SELECT CASE WHEN id % 13 = 0 OR id % 17 = 0 "
          "THEN NULL ELSE price END AS p, last_review AS lr FROM v_listings)", L)
def q_listings_clean_roundtrip(spark, d):
    """P6/P7/P8 — prices rendered as currency text (with junk and empty strings mixed in) and
    review dates as text with ``'nan'`` for missing, then cleaned back: the cleaners must recover
    every value and turn the junk into NULL."""
    from pyspark.sql import functions as F
    from quarry.functions import clean as C
    v = V.listings(spark, d)
    dirty = v.select(
        F.when(F.col("id") % 13 == 0, F.lit("abc")).when(F.col("id") % 17 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("$"), F.format_number("price", 2))).alias("price_text"),
        F.coalesce(F.col("last_review").cast("string"), F.lit("nan")).alias("review_text"))
    clean = dirty.select(C.currency_to_double("price_text").alias("p"),
                         C.parse_timestamp(C.nan_text_to_null("review_text")).alias("lr"))
    return clean.agg(F.count("p").alias("n_price"), F.avg("p").alias("price_avg"),
                     F.count("lr").alias("n_last_review"),
                     F.count_distinct(F.to_date("lr")).alias("distinct_review_days"))
