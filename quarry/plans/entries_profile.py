"""Catalogue entries: profiles, distributions, outliers, filters, sampling (A11–A31, D*, O*, F*, R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import distribution as D
from quarry.operators import filters as FL
from quarry.operators import profile as P
from quarry.operators import sampling as SM
from quarry.plans.catalog import I, R, register
from quarry.sources import views as V

S, L, DOC, EV = ("v_survey",), ("v_listings",), ("v_docs",), ("v_events",)

LISTING_NUM = ["price", "minimum_nights", "number_of_reviews", "reviews_per_month",
               "calculated_host_listings_count", "availability_365", "number_of_reviews_ltm"]
SURVEY_NUM = ["bmi", "ment_hlth", "phys_hlth", "gen_hlth", "age", "education", "income"]


def unpivot_sql(view: str, cols, by=(), include_nulls: bool = False) -> str:
    """Long form ``(by…, variable, value DOUBLE)`` of ``cols`` — oracle twin of ``to_long``."""
    b = "".join(f"{c}, " for c in by)
    inner = f"SELECT {b}" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols) + f" FROM {view}"
    inc = "INCLUDE NULLS " if include_nulls else ""
    return f"(SELECT * FROM ({inner}) UNPIVOT {inc}(value FOR variable IN ({', '.join(cols)})))"


def quantile_sql(probs_names) -> str:
    return ", ".join(R(f"quantile_cont(value, {p})", n) for p, n in probs_names)


# ------------------------------------------------------------------------ grouped rates / KPIs
@register("survey_rate_by_each_binary",
          "SELECT variable, " + R("value", "value") + ", COUNT(*) AS total, "
          + R("SUM(t)", "positives") + ", " + R("SUM(t) * 100.0 / COUNT(*)", "rate_pct")
          + " FROM (SELECT * FROM (SELECT CAST(target AS DOUBLE) AS t, "
          + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in V.SURVEY_NOMINAL)
          + " FROM v_survey) UNPIVOT (value FOR variable IN (" + ", ".join(V.SURVEY_NOMINAL) + ")))"
          " GROUP BY variable, value", S)
def q_survey_rate_by_each_binary(spark, d):
    return P.rate_by_each(V.survey(spark, d), V.SURVEY_NOMINAL, "target")


_KPI_SQL = {"high_bp_pct": "high_bp = 1", "high_chol_pct": "high_chol = 1", "obese_pct": "bmi >= 30",
            "inactive_pct": "phys_activity = 0",
            "composite_risk_pct": "high_bp = 1 AND high_chol = 1 AND bmi >= 30",
            "target_pct": "target = 1"}


@register("survey_risk_kpis",
          "SELECT " + ", ".join(R(f"AVG(CASE WHEN {p} THEN 1.0 ELSE 0.0 END) * 100", n) for n, p in _KPI_SQL.items())
          + " FROM v_survey", S)
def q_survey_risk_kpis(spark, d):
    c = F.col
    preds = {"high_bp_pct": c("high_bp") == 1, "high_chol_pct": c("high_chol") == 1, "obese_pct": c("bmi") >= 30,
             "inactive_pct": c("phys_activity") == 0,
             "composite_risk_pct": (c("high_bp") == 1) & (c("high_chol") == 1) & (c("bmi") >= 30),
             "target_pct": c("target") == 1}
    return P.predicate_shares(V.survey(spark, d), preds)


@register("survey_binary_frequency",
          "SELECT variable, COUNT(*) AS total, COUNT(*) FILTER (WHERE value = 0) AS n0, "
          "COUNT(*) FILTER (WHERE value = 1) AS n1, "
          + R("COUNT(*) FILTER (WHERE value = 1) * 100.0 / COUNT(*)", "pct1")
          + " FROM " + unpivot_sql("v_survey", ["target"] + V.SURVEY_NOMINAL) + " GROUP BY variable", S)
def q_survey_binary_frequency(spark, d):
    return P.binary_frequency(V.survey(spark, d), ["target"] + V.SURVEY_NOMINAL)


@register("survey_pivot_income_education",
          "SELECT income, " + ", ".join(R(f"AVG(CASE WHEN education = {e} THEN target END) * 100", f'"{e}"')
                                         for e in range(11)) + " FROM v_survey GROUP BY income", S)
def q_survey_pivot_income_education(spark, d):
    return P.pivot_mean(V.survey(spark, d), "income", "education", "target", values=list(range(11)))


# ------------------------------------------------------------------------ group stats / top-k
@register("listings_price_stats_by_neighbourhood",
          f"SELECT neighbourhood, COUNT(*) AS count, {R('AVG(price)', 'mean')}, "
          f"{R('quantile_cont(price, 0.5)', 'median')}, {R('stddev_samp(price)', 'std')} "
          f"FROM v_listings WHERE price IS NOT NULL GROUP BY neighbourhood HAVING COUNT(*) >= 30", L)
def q_listings_price_stats_by_neighbourhood(spark, d):
    return P.group_stats(V.listings(spark, d), ["neighbourhood"], "price", min_count=30)


@register("listings_price_stats_by_room_type",
          f"SELECT room_type, COUNT(*) AS count, {R('AVG(price)', 'mean')}, "
          f"{R('quantile_cont(price, 0.5)', 'median')}, {R('stddev_samp(price)', 'std')} "
          f"FROM v_listings WHERE price IS NOT NULL GROUP BY room_type", L)
def q_listings_price_stats_by_room_type(spark, d):
    return P.group_stats(V.listings(spark, d), ["room_type"], "price")


@register("listings_top_hosts_named",
          f"SELECT host_id, host_name, COUNT(id) AS listings, {R('AVG(price)', 'price_mean')}, "
          f"{I('SUM(number_of_reviews)', 'reviews_total')} FROM v_listings "
          f"WHERE host_id IS NOT NULL AND host_name IS NOT NULL GROUP BY host_id, host_name "
          f"ORDER BY listings DESC, host_id, host_name LIMIT 10", L)
def q_listings_top_hosts_named(spark, d):
    return P.top_groups(V.listings(spark, d), ["host_id", "host_name"],
                        [F.count("id").alias("listings"), F.avg("price").alias("price_mean"),
                         F.sum("number_of_reviews").alias("reviews_total")],
                        [F.col("listings").desc()], 10)


@register("listings_per_host_distribution",
          "SELECT listings, COUNT(*) AS keys FROM (SELECT host_id, COUNT(*) AS listings FROM v_listings "
          "WHERE host_id IS NOT NULL GROUP BY host_id) GROUP BY listings", L)
def q_listings_per_host_distribution(spark, d):
    return P.per_key_count_distribution(V.listings(spark, d), "host_id")


@register("listings_room_type_counts",
          "SELECT room_type, COUNT(*) AS n, " + R("COUNT(*) / (SELECT COUNT(room_type) FROM v_listings)", "share")
          + " FROM v_listings WHERE room_type IS NOT NULL GROUP BY room_type", L)
def q_listings_room_type_counts(spark, d):
    return P.value_counts(V.listings(spark, d), "room_type")


@register("listings_neighbourhood_top10",
          "SELECT neighbourhood, COUNT(*) AS n, "
          + R("COUNT(*) / (SELECT COUNT(neighbourhood) FROM v_listings)", "share")
          + " FROM v_listings WHERE neighbourhood IS NOT NULL GROUP BY neighbourhood "
          "ORDER BY n DESC, neighbourhood LIMIT 10", L)
def q_listings_neighbourhood_top10(spark, d):
    return P.value_counts(V.listings(spark, d), "neighbourhood", top=10)


@register("listings_crosstab_room_neighbourhood",
          "SELECT room_type, neighbourhood, COUNT(*) AS n FROM v_listings "
          "WHERE room_type IS NOT NULL AND neighbourhood IS NOT NULL GROUP BY room_type, neighbourhood", L)
def q_listings_crosstab_room_neighbourhood(spark, d):
    return P.crosstab_long(V.listings(spark, d), "room_type", "neighbourhood")


_TOP6 = ("(SELECT {c} FROM v_listings WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 6)")


@register("listings_crosstab_top6",
          "SELECT neighbourhood, room_type, COUNT(*) AS n FROM v_listings "
          f"WHERE neighbourhood IN {_TOP6.format(c='neighbourhood')} AND room_type IN {_TOP6.format(c='room_type')} "
          "GROUP BY neighbourhood, room_type", L)
def q_listings_crosstab_top6(spark, d):
    return P.crosstab_top(V.listings(spark, d), "neighbourhood", "room_type", 6)


# ------------------------------------------------------------------------ describe / nulls
def _describe_sql(view, cols, by=(), kurt=True):
    b = "".join(f"{c}, " for c in by)
    k = (", " + R("kurtosis(value)", "kurtosis")) if kurt else ""
    return (f"SELECT {b}variable, COUNT(value) AS count, COUNT(*) - COUNT(value) AS nulls, "
            + R("(COUNT(*) - COUNT(value)) * 100.0 / COUNT(*)", "null_pct") + ", "
            + R("AVG(value)", "mean") + ", " + R("stddev_samp(value)", "std") + ", "
            + R("MIN(value)", "min") + ", " + quantile_sql([(0.25, "q1"), (0.5, "median"), (0.75, "q3")]) + ", "
            + R("MAX(value)", "max") + ", " + R("skewness(value)", "skew") + k
            + f" FROM {unpivot_sql(view, cols, by, include_nulls=True)} GROUP BY {b}variable")


@register("listings_describe", _describe_sql("v_listings", LISTING_NUM), L)
def q_listings_describe(spark, d):
    return P.describe(V.listings(spark, d), LISTING_NUM)


@register("survey_describe", _describe_sql("v_survey", SURVEY_NUM, kurt=False), S)
def q_survey_describe(spark, d):
    return P.describe(V.survey(spark, d), SURVEY_NUM, kurtosis=False)


@register("events_describe_by_type", _describe_sql("v_events", ["value"], by=["event_type"]), EV)
def q_events_describe_by_type(spark, d):
    return P.describe(V.events(spark, d), ["value"], by=["event_type"])


@register("listings_target_profile", _describe_sql("v_listings", ["price"]), L)
def q_listings_target_profile(spark, d):
    """A26 — the one-variable describe of the target."""
    return P.describe(V.listings(spark, d), ["price"])


def _null_sql(view, cols, only_missing=True):
    parts = [f"SELECT '{c}' AS variable, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls, "
             + R(f"COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*)", "null_pct") + f" FROM {view}"
             for c in cols]
    sql = " UNION ALL ".join(parts)
    return f"SELECT * FROM ({sql}) WHERE nulls > 0" if only_missing else sql


_DOC_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
_LISTING_COLS = ["id", "name", "host_id", "host_name", "neighbourhood", "latitude", "longitude", "room_type",
                 "price", "minimum_nights", "number_of_reviews", "last_review", "reviews_per_month",
                 "calculated_host_listings_count", "availability_365", "number_of_reviews_ltm"]


@register("docs_null_profile", _null_sql("v_docs_text", [*_DOC_COLS, "text"]), ("v_docs_text",))
def q_docs_null_profile(spark, d):
    return P.null_profile(V.docs(spark, d, with_text=True))


@register("listings_null_profile", _null_sql("v_listings", _LISTING_COLS), L)
def q_listings_null_profile(spark, d):
    return P.null_profile(V.listings(spark, d))


_DOC_TYPES = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint", "text": "string",
              "quality": "bigint", "toxic": "bigint"}


@register("docs_column_profile",
          " UNION ALL ".join(
              f"SELECT '{c}' AS variable, '{t}' AS dtype, COUNT({c}) AS non_null, COUNT(*) - COUNT({c}) AS nulls, "
              + R(f"(COUNT(*) - COUNT({c})) * 100.0 / COUNT(*)", "null_pct")
              + f", COUNT(DISTINCT {c}) AS distinct, arg_min(CAST({c} AS VARCHAR), doc_id) "
              f"FILTER (WHERE {c} IS NOT NULL) AS sample_value FROM v_docs_text" for c, t in _DOC_TYPES.items()), ("v_docs_text",))
def q_docs_column_profile(spark, d):
    return P.column_profile(V.docs(spark, d, with_text=True), "doc_id", list(_DOC_TYPES))


@register("docs_null_patterns",
          "SELECT (CASE WHEN lang IS NULL THEN '1' ELSE '0' END) || (CASE WHEN n_chars IS NULL THEN '1' ELSE '0' END)"
          " || (CASE WHEN quality IS NULL THEN '1' ELSE '0' END) || (CASE WHEN toxic IS NULL THEN '1' ELSE '0' END)"
          " AS pattern, COUNT(*) AS n FROM v_docs GROUP BY pattern", DOC)
def q_docs_null_patterns(spark, d):
    return D.null_patterns(V.docs(spark, d), ["lang", "n_chars", "quality", "toxic"])


# ------------------------------------------------------------------------ histograms / box / outliers
def _hist_sql(view, cols, bins, by=(), density=False):
    b = "".join(f"h.{c}, " for c in by)
    bb = "".join(f"l.{c}, " for c in by)
    dens = (", " + R(f"n / (SUM(n) OVER (PARTITION BY {b}variable) * (bin_hi - bin_lo))", "density")) if density else ""
    return (f"SELECT *{dens} FROM (SELECT {b}h.variable, h.bin, " + R(f"lo + bin * (hi - lo) / {bins}", "bin_lo") + ", "
            + R(f"lo + (bin + 1) * (hi - lo) / {bins}", "bin_hi") + ", COUNT(*) AS n FROM ("
            f"SELECT {bb}l.variable, m.lo, m.hi, CAST(CASE WHEN m.hi - m.lo > 0 THEN "
            f"least(floor((l.value - m.lo) / (m.hi - m.lo) * {bins}), {bins - 1}) ELSE 0 END AS BIGINT) AS bin "
            f"FROM {unpivot_sql(view, cols, by)} l JOIN (SELECT variable, MIN(value) AS lo, MAX(value) AS hi "
            f"FROM {unpivot_sql(view, cols)} GROUP BY variable) m ON l.variable = m.variable) h "
            f"GROUP BY {b}h.variable, h.bin, h.lo, h.hi)")


@register("listings_histogram", _hist_sql("v_listings", ["price", "availability_365", "reviews_per_month"], 50), L)
def q_listings_histogram(spark, d):
    return D.histogram(V.listings(spark, d), ["price", "availability_365", "reviews_per_month"], 50)


@register("survey_histogram_bmi_by_class", _hist_sql("v_survey", ["bmi"], 30, by=["target"]), S)
def q_survey_histogram_bmi_by_class(spark, d):
    return D.histogram(V.survey(spark, d), ["bmi"], 30, by=["target"])


@register("events_value_density", _hist_sql("v_events", ["value"], 40, density=True), EV)
def q_events_value_density(spark, d):
    return D.histogram(V.events(spark, d), ["value"], 40, density=True)


def _box_sql(view, cols, by=()):
    b = "".join(f"{c}, " for c in by)
    on = " AND ".join([f"l.{c} = q.{c}" for c in by] + ["l.variable = q.variable"])
    qb = "".join(f"q.{c}, " for c in by)
    return (f"WITH q AS (SELECT {b}variable, COUNT(*) AS n, quantile_cont(value, 0.25) AS q1, "
            f"quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 "
            f"FROM {unpivot_sql(view, cols, by)} GROUP BY {b}variable), "
            f"f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS fence_lo, q3 + 1.5 * (q3 - q1) AS fence_hi FROM q) "
            f"SELECT {qb}q.variable, q.n, {R('q.q1', 'q1')}, {R('q.median', 'median')}, {R('q.q3', 'q3')}, "
            f"{R('q.iqr', 'iqr')}, {R('q.fence_lo', 'fence_lo')}, {R('q.fence_hi', 'fence_hi')}, "
            f"{R('MIN(CASE WHEN l.value BETWEEN q.fence_lo AND q.fence_hi THEN l.value END)', 'whisker_lo')}, "
            f"{R('MAX(CASE WHEN l.value BETWEEN q.fence_lo AND q.fence_hi THEN l.value END)', 'whisker_hi')}, "
            f"COUNT(*) FILTER (WHERE l.value < q.fence_lo OR l.value > q.fence_hi) AS n_outliers, "
            f"{R('q.median - 1.57 * q.iqr / sqrt(q.n)', 'notch_lo')}, {R('q.median + 1.57 * q.iqr / sqrt(q.n)', 'notch_hi')} "
            f"FROM {unpivot_sql(view, cols, by)} l JOIN f q ON {on} "
            f"GROUP BY {qb}q.variable, q.n, q.q1, q.median, q.q3, q.iqr, q.fence_lo, q.fence_hi")


@register("listings_box_stats", _box_sql("v_listings", ["price", "availability_365", "minimum_nights"]), L)
def q_listings_box_stats(spark, d):
    return D.box_stats(V.listings(spark, d), ["price", "availability_365", "minimum_nights"])


@register("survey_box_bmi_by_class", _box_sql("v_survey", ["bmi", "ment_hlth"], by=["target"]), S)
def q_survey_box_bmi_by_class(spark, d):
    return D.box_stats(V.survey(spark, d), ["bmi", "ment_hlth"], by=["target"])


def _outlier_sql(view, cols, denominator="non_null"):
    den = "q.n" if denominator == "non_null" else "COUNT(*)"
    return (f"WITH q AS (SELECT variable, COUNT(*) AS n, quantile_cont(value, 0.25) AS q1, "
            f"quantile_cont(value, 0.75) AS q3 FROM {unpivot_sql(view, cols)} GROUP BY variable) "
            f"SELECT q.variable, q.n, {R('q.q1', 'q1')}, {R('q.q3', 'q3')}, {R('q.q3 - q.q1', 'iqr')}, "
            f"{R('q.q1 - 1.5 * (q.q3 - q.q1)', 'lower')}, {R('q.q3 + 1.5 * (q.q3 - q.q1)', 'upper')}, "
            f"COUNT(*) FILTER (WHERE l.value < q.q1 - 1.5 * (q.q3 - q.q1) OR l.value > q.q3 + 1.5 * (q.q3 - q.q1)) AS n_outliers, "
            + R(f"COUNT(*) FILTER (WHERE l.value < q.q1 - 1.5 * (q.q3 - q.q1) OR l.value > q.q3 + 1.5 * (q.q3 - q.q1)) * 100.0 / {den}",
                "pct_outliers")
            + f" FROM {unpivot_sql(view, cols, include_nulls=True)} l JOIN q ON l.variable = q.variable "
            f"GROUP BY q.variable, q.n, q.q1, q.q3")


@register("listings_outliers", _outlier_sql("v_listings", LISTING_NUM), L)
def q_listings_outliers(spark, d):
    return D.iqr_outliers(V.listings(spark, d), LISTING_NUM)


@register("events_outliers_all_rows", _outlier_sql("v_events", ["value"], "rows"), EV)
def q_events_outliers_all_rows(spark, d):
    return D.iqr_outliers(V.events(spark, d), ["value"], denominator="rows")


@register("listings_most_expensive",
          f"SELECT id, name, neighbourhood, {R('price', 'price')} FROM v_listings WHERE price IS NOT NULL "
          "ORDER BY price DESC, id LIMIT 10", L)
def q_listings_most_expensive(spark, d):
    return D.largest(V.listings(spark, d), "price", 10, "id", ["id", "name", "neighbourhood", "price"])


# ------------------------------------------------------------------------ filters / slices / sampling
@register("listings_slice",
          f"SELECT id, room_type, neighbourhood, {R('price', 'price')}, availability_365 FROM v_listings "
          "WHERE room_type IN ('1-URGENT', '2-HIGH') AND availability_365 BETWEEN 30 AND 200 "
          "AND (price IS NULL OR price BETWEEN 1000 AND 150000)", L)
def q_listings_slice(spark, d):
    df = FL.slice_frame(V.listings(spark, d),
                        {"room_type": ["1-URGENT", "2-HIGH"], "neighbourhood": []},
                        {"availability_365": (30, 200), "price": (1000, 150000)}, keep_null_ranges=["price"])
    return df.select("id", "room_type", "neighbourhood", "price", "availability_365")


@register("listings_price_capped_p99",
          f"SELECT COUNT(*) AS n, {R('AVG(price)', 'price_avg')}, {R('MAX(price)', 'price_max')} FROM v_listings "
          "WHERE price <= (SELECT quantile_cont(price, 0.99) FROM v_listings)", L)
def q_listings_price_capped_p99(spark, d):
    return FL.cap_at_quantile(V.listings(spark, d), "price", 0.99).agg(
        F.count("*").alias("n"), F.avg("price").alias("price_avg"), F.max("price").alias("price_max"))


@register("listings_price_domain",
          f"SELECT {R('MIN(price)', 'min')}, {R('MAX(price)', 'max')}, {R('quantile_cont(price, 0.99)', 'p99')} "
          "FROM v_listings", L)
def q_listings_price_domain(spark, d):
    return FL.domain_range(V.listings(spark, d), "price", 0.99)


@register("listings_valid_target_report",
          "SELECT COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE price IS NOT NULL AND price > 0) AS rows_kept, "
          "COUNT(*) - COUNT(*) FILTER (WHERE price IS NOT NULL AND price > 0) AS rows_removed FROM v_listings", L)
def q_listings_valid_target_report(spark, d):
    return FL.valid_target(V.listings(spark, d), "price")[1]


_DRAW = "CAST(('0x' || substr(md5('42|' || CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT)"


@register("listings_sample_500",
          f"SELECT id, {R('latitude', 'latitude')}, {R('longitude', 'longitude')}, {R('price', 'price')} "
          f"FROM v_listings WHERE price IS NOT NULL AND price <= (SELECT quantile_cont(price, 0.97) FROM v_listings) "
          f"ORDER BY {_DRAW.format(k='id')}, id LIMIT 500", L)
def q_listings_sample_500(spark, d):
    """D7 — scatter point set: cap at p97, non-null, seeded exact-size sample of 500."""
    v = FL.cap_at_quantile(V.listings(spark, d), "price", 0.97)
    return SM.sample_exact(v, 500, "id").select("id", "latitude", "longitude", "price")


@register("listings_split_sizes",
          f"SELECT CASE WHEN {_DRAW.format(k='id')} % 100 < 70 THEN 'train' ELSE 'test' END AS split, "
          "COUNT(*) AS n, SUM(id) AS id_sum FROM v_listings GROUP BY split", L)
def q_listings_split_sizes(spark, d):
    return (SM.with_split(V.listings(spark, d), "id").groupBy("split")
              .agg(F.count("*").alias("n"), F.sum("id").alias("id_sum")))


_FOLD = "CAST(('0x' || substr(md5('42|fold|' || CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) % 5"


@register("listings_fold_sizes",
          f"SELECT CAST({_FOLD.format(k='id')} AS BIGINT) AS fold, COUNT(*) AS n, SUM(id) AS id_sum "
          "FROM v_listings GROUP BY fold", L)
def q_listings_fold_sizes(spark, d):
    return (SM.with_folds(V.listings(spark, d), "id").groupBy("fold")
              .agg(F.count("*").alias("n"), F.sum("id").alias("id_sum")))


@register("listings_histogram_refs",
          "SELECT h.*, " + R("r.mean", "mean") + ", " + R("r.median", "median") + " FROM ("
          + _hist_sql("v_listings", ["price", "availability_365"], 30) + ") h JOIN (SELECT variable, AVG(value) AS mean, "
          "quantile_cont(value, 0.5) AS median FROM " + unpivot_sql("v_listings", ["price", "availability_365"])
          + " GROUP BY variable) r ON h.variable = r.variable", L)
def q_listings_histogram_refs(spark, d):
    """D4 — histogram rows with the variable's mean and median reference lines."""
    return D.histogram_with_refs(V.listings(spark, d), ["price", "availability_365"], 30)
