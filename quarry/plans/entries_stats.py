"""Catalogue entries: correlation, χ², Kruskal–Wallis, ANOVA, mutual information (T-family).

Statistics are oracle-checked.  DuckDB has no χ², F or t distribution; the oracle of a p-value (X1)
is the ratio of two midpoint sums over its density, in coordinates where the density is smooth.
"""

from __future__ import annotations

from itertools import combinations

from quarry.operators import association as A
from quarry.operators.information import neighbour_information
from quarry.plans.catalog import R, register
from quarry.plans.entries_profile import unpivot_sql
from quarry.session import cut_lineage
from quarry.sources import views as V

S, L = ("v_survey",), ("v_listings",)

CORR_LISTINGS = ["price", "minimum_nights", "number_of_reviews", "reviews_per_month", "availability_365",
                 "number_of_reviews_ltm"]
CORR_SURVEY = ["target", "bmi", "age", "gen_hlth", "ment_hlth", "income", "high_bp"]


_STEPS = 20000


def f_p_sql(f: str, d1: str, d2: str) -> str:
    """P(F > f): with F = d2 / d1 · tan² θ the density is sin^(d1-1) θ · cos^(d2-1) θ on (0, π/2)."""
    top = f"least(pi() / 2, (sqrt({d1}) + 14) / sqrt({d2}))"

    def area(low):
        x = f"({low} + (i + 0.5) * ({top} - {low}) / {_STEPS})"
        return (f"(SELECT sum(exp(({d1} - 1) * ln(sin({x})) + ({d2} - 1) * ln(cos({x})))) * ({top} - {low}) / {_STEPS} "
                f"FROM range({_STEPS}) AS t(i))")
    return f"CASE WHEN atan(sqrt({f} * {d1} / {d2})) >= {top} THEN 0.0 ELSE {area(f'atan(sqrt({f} * {d1} / {d2}))')} / {area('0.0')} END"


def chi2_p_sql(x: str, dof: str) -> str:
    """P(χ² > x): with χ² = w² the density is w^(dof-1) · exp(-w² / 2)."""
    def area(low, high):
        w = f"({low} + (i + 0.5) * ({high} - {low}) / {_STEPS})"
        return (f"(SELECT sum(exp(({dof} - 1) * ln({w}) - {w} * {w} / 2)) * ({high} - {low}) / {_STEPS} "
                f"FROM range({_STEPS}) AS t(i))")
    return f"{area(f'sqrt({x})', f'(sqrt({x}) + 14)')} / {area('0.0', f'(sqrt({dof}) + 14)')}"


def stars_sql(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' WHEN {p} IS NOT NULL THEN 'ns' END"


def _pearson_sql(view, cols):
    parts = []
    for a, b in combinations(cols, 2):
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        xm, ym = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
        den = f"(stddev_pop({xm}) * stddev_pop({ym}))"
        parts.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, "
                     + R(f"CASE WHEN {den} > 0 THEN covar_pop({xm}, {ym}) / {den} END", "r")
                     + f", COUNT(*) FILTER (WHERE {both}) AS n FROM {view}")
    return " UNION ALL ".join(parts)


def _spearman_sql(view, pairs):
    parts = []
    for a, b in pairs:
        parts.append(
            f"SELECT '{a}' AS var_x, '{b}' AS var_y, "
            + R("CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0 THEN corr(rx, ry) END", "rho")
            + ", COUNT(*) AS n FROM (SELECT rank() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, "
            f"rank() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM "
            f"(SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {view} "
            f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL))")
    return " UNION ALL ".join(parts)


@register("listings_pearson_matrix", _pearson_sql("v_listings", CORR_LISTINGS), L)
def q_listings_pearson_matrix(spark, d):
    return A.pearson_matrix(V.listings(spark, d), CORR_LISTINGS)


@register("survey_pearson_matrix", _pearson_sql("v_survey", CORR_SURVEY), S)
def q_survey_pearson_matrix(spark, d):
    return A.pearson_matrix(V.survey(spark, d), CORR_SURVEY)


@register("listings_spearman_matrix", _spearman_sql("v_listings", list(combinations(CORR_LISTINGS, 2))), L)
def q_listings_spearman_matrix(spark, d):
    return A.spearman_matrix(cut_lineage(V.listings(spark, d).select(*CORR_LISTINGS)), CORR_LISTINGS)


@register("survey_spearman_matrix", _spearman_sql("v_survey", list(combinations(CORR_SURVEY, 2))), S)
def q_survey_spearman_matrix(spark, d):
    return A.spearman_matrix(V.survey(spark, d), CORR_SURVEY)


@register("listings_price_correlations_top5",
          "SELECT CASE WHEN var_x = 'price' THEN var_y ELSE var_x END AS variable, r, n FROM ("
          + _pearson_sql("v_listings", CORR_LISTINGS) + ") WHERE var_x = 'price' OR var_y = 'price' "
          "ORDER BY abs(r) DESC NULLS LAST, variable LIMIT 5", L)
def q_listings_price_correlations_top5(spark, d):
    m = A.pearson_matrix(V.listings(spark, d), CORR_LISTINGS)
    return A.with_target(m, "price", "r", k=5)


def _price_tests_sql():
    """Both coefficients with price over pairwise complete rows, t = r sqrt(n-2) / sqrt(1-r²), two-sided p."""
    pairs = [(c, "price") for c in CORR_LISTINGS[1:]]
    cols = {"pearson": _pearson_sql("v_listings", [*CORR_LISTINGS[1:], "price"]).replace("6) + 0.0 AS r", "17) AS r"),
            "spearman": _spearman_sql("v_listings", pairs).replace("6) + 0.0 AS rho", "17) AS rho")}
    p = {k: f_p_sql(f"({r} * {r} * (n - 2) / (1 - {r} * {r}))", "1.0", "(n - 2.0)") for k, r in (("pearson", "r"), ("spearman", "rho"))}
    return (f"WITH a AS ({cols['pearson']}), b AS ({cols['spearman']}), "
            "j AS (SELECT a.var_x AS variable, a.n, a.r, b.rho FROM a JOIN b ON a.var_x = b.var_x AND a.var_y = b.var_y WHERE a.n >= 10), "
            f"p AS (SELECT *, {p['pearson']} AS pp, {p['spearman']} AS sp FROM j) "
            f"SELECT variable, {R('r', 'pearson_r')}, n, {R('rho', 'spearman_rho')}, {R('pp', 'pearson_p')}, {R('sp', 'spearman_p')}, "
            f"{stars_sql('pp')} AS pearson_sig, {stars_sql('sp')} AS spearman_sig FROM p")


@register("listings_price_correlation_tests", _price_tests_sql(), L)
def q_listings_price_correlation_tests(spark, d):
    """T4–T6, P16, X1 — Pearson and Spearman with p-values and stars."""
    return A.correlation_tests(cut_lineage(V.listings(spark, d).select(*CORR_LISTINGS)), "price", CORR_LISTINGS[1:])


def _chi_sql(view, cols, target, with_p=False):
    p = ", " + R(f"CASE WHEN dof > 0 THEN {chi2_p_sql('x2', 'dof')} END", "p_value") if with_p else ""
    return (
        f"WITH o AS (SELECT variable, value, class, COUNT(*) AS o FROM (SELECT * FROM (SELECT CAST({target} AS DOUBLE) AS class, "
        + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
        + f" FROM {view}) UNPIVOT (value FOR variable IN ({', '.join(cols)}))) WHERE class IS NOT NULL "
        "GROUP BY variable, value, class), "
        "r AS (SELECT variable, value, SUM(o) AS r FROM o GROUP BY variable, value), "
        "c AS (SELECT variable, class, SUM(o) AS c FROM o GROUP BY variable, class), "
        "d AS (SELECT variable, SUM(o) AS n, COUNT(DISTINCT value) AS n_rows, COUNT(DISTINCT class) AS n_cols "
        "FROM o GROUP BY variable), "
        "g AS (SELECT r.variable, CAST(COALESCE(o.o, 0) AS DOUBLE) AS ob, r.r * c.c / d.n AS e, d.n, d.n_rows, d.n_cols "
        "FROM r JOIN c ON r.variable = c.variable JOIN d ON d.variable = r.variable "
        "LEFT JOIN o ON o.variable = r.variable AND o.value = r.value AND o.class = c.class), "
        "s AS (SELECT variable, n, n_rows, n_cols, (n_rows - 1) * (n_cols - 1) AS dof, "
        "CASE WHEN (n_rows - 1) * (n_cols - 1) = 1 THEN SUM(power(abs(ob - e) - least(0.5, abs(ob - e)), 2) / e) "
        "ELSE SUM(power(ob - e, 2) / e) END AS x2 FROM g GROUP BY variable, n, n_rows, n_cols) "
        "SELECT variable, n, n_rows, n_cols, CAST(dof AS BIGINT) AS dof, "
        + R("CASE WHEN dof > 0 THEN x2 END", "chi2") + ", "
        + R("CASE WHEN least(n_rows, n_cols) > 1 AND dof > 0 THEN sqrt(x2 / (n * (least(n_rows, n_cols) - 1))) END",
            "cramers_v") + p + " FROM s")


@register("survey_chi_square", _chi_sql("v_survey", V.SURVEY_NOMINAL + ["age"], "target"), S)
def q_survey_chi_square(spark, d):
    return A.chi_square(V.survey(spark, d), V.SURVEY_NOMINAL + ["age"], "target", with_p=False)


@register("survey_chi_square_tests", _chi_sql("v_survey", V.SURVEY_NOMINAL, "target", with_p=True), S)
def q_survey_chi_square_tests(spark, d):
    """T7/T8, X1 — with p-values."""
    return A.chi_square(V.survey(spark, d), V.SURVEY_NOMINAL, "target")


_TOP6 = "(SELECT {c} FROM v_listings WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 6)"


@register("listings_chi_square_top6",
          "WITH sub AS (SELECT CAST(neighbourhood AS VARCHAR) AS a, CAST(room_type AS VARCHAR) AS b FROM v_listings "
          f"WHERE neighbourhood IN {_TOP6.format(c='neighbourhood')} AND room_type IN {_TOP6.format(c='room_type')}), "
          "o AS (SELECT a, b, COUNT(*) AS o FROM sub GROUP BY a, b), "
          "r AS (SELECT a, SUM(o) AS r FROM o GROUP BY a), c AS (SELECT b, SUM(o) AS c FROM o GROUP BY b), "
          "d AS (SELECT SUM(o) AS n, COUNT(DISTINCT a) AS n_rows, COUNT(DISTINCT b) AS n_cols FROM o), "
          "g AS (SELECT CAST(COALESCE(o.o, 0) AS DOUBLE) AS ob, r.r * c.c / d.n AS e FROM r CROSS JOIN c CROSS JOIN d "
          "LEFT JOIN o ON o.a = r.a AND o.b = c.b) "
          "SELECT 'room_type' AS versus, 'neighbourhood' AS variable, n, n_rows, n_cols, "
          "CAST((n_rows - 1) * (n_cols - 1) AS BIGINT) AS dof, "
          + R("CASE WHEN (n_rows - 1) * (n_cols - 1) > 0 AND n >= 20 THEN (SELECT SUM(power(ob - e, 2) / e) FROM g) END", "chi2")
          + ", " + R("CASE WHEN (n_rows - 1) * (n_cols - 1) > 0 AND n >= 20 THEN sqrt((SELECT SUM(power(ob - e, 2) / e) FROM g) "
                     "/ (n * (least(n_rows, n_cols) - 1))) END", "cramers_v") + " FROM d", L)
def q_listings_chi_square_top6(spark, d):
    return A.chi_square_pair(V.listings(spark, d), "neighbourhood", "room_type", 6, 20, with_p=False)


def _kruskal_sql(view, cols, group):
    return (
        f"WITH l AS (SELECT g, variable, value FROM {unpivot_sql(view, cols, by=[f'{group} AS g'])} WHERE g IS NOT NULL), "
        "rk AS (SELECT variable, g, rank() OVER (PARTITION BY variable ORDER BY value) "
        "+ (COUNT(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS r FROM l), "
        "t AS (SELECT variable, SUM(c * c * c - c) AS tt FROM (SELECT variable, value, CAST(COUNT(*) AS DOUBLE) AS c "
        "FROM l GROUP BY variable, value) GROUP BY variable), "
        "s AS (SELECT variable, g, SUM(r) AS rs, COUNT(*) AS ng FROM rk GROUP BY variable, g), "
        "a AS (SELECT variable, SUM(rs * rs / ng) AS ss, COUNT(*) AS k, CAST(SUM(ng) AS DOUBLE) AS n FROM s GROUP BY variable) "
        "SELECT a.variable, k, CAST(n AS BIGINT) AS n, "
        + R("CASE WHEN k >= 2 THEN (12.0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - tt / (n * n * n - n)) END", "h")
        + ", k - 1 AS dof FROM a JOIN t ON a.variable = t.variable")


@register("survey_kruskal_by_class", _kruskal_sql("v_survey", ["bmi", "ment_hlth", "age", "income"], "target"), S)
def q_survey_kruskal_by_class(spark, d):
    return A.kruskal_wallis(V.survey(spark, d), ["bmi", "ment_hlth", "age", "income"], "target", with_p=False)


@register("listings_kruskal_by_room_type", _kruskal_sql("v_listings", ["price", "availability_365"], "room_type"), L)
def q_listings_kruskal_by_room_type(spark, d):
    return A.kruskal_wallis(V.listings(spark, d), ["price", "availability_365"], "room_type", with_p=False)


def _anova_sql(view, cols, group, min_group):
    return (
        f"WITH l AS (SELECT g, variable, value FROM {unpivot_sql(view, cols, by=[f'{group} AS g'])} WHERE g IS NOT NULL), "
        "gs AS (SELECT variable, g, COUNT(*) AS ng, AVG(value) AS mg, var_samp(value) AS vg FROM l GROUP BY variable, g "
        f"HAVING COUNT(*) >= {min_group}), "
        "tot AS (SELECT variable, SUM(ng) AS n, COUNT(*) AS k, SUM(ng * mg) / SUM(ng) AS grand FROM gs GROUP BY variable), "
        "s AS (SELECT gs.variable, tot.n, tot.k, SUM(ng * power(mg - grand, 2)) AS ssb, "
        "SUM(COALESCE((ng - 1) * vg, 0.0)) AS ssw FROM gs JOIN tot ON gs.variable = tot.variable "
        "GROUP BY gs.variable, tot.n, tot.k) "
        "SELECT variable, k, CAST(n AS BIGINT) AS n, "
        + R("CASE WHEN k >= 2 AND n - k > 0 AND ssw > 0 THEN (ssb / (k - 1)) / (ssw / (n - k)) END", "f")
        + ", k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within FROM s")


@register("listings_anova_by_room_type", _anova_sql("v_listings", ["price", "availability_365", "number_of_reviews"],
                                                    "room_type", 5), L)
def q_listings_anova_by_room_type(spark, d):
    return A.anova_oneway(V.listings(spark, d), ["price", "availability_365", "number_of_reviews"], "room_type",
                          min_group=5, with_p=False)


@register("survey_anova_by_age", _anova_sql("v_survey", ["bmi", "ment_hlth"], "age", 5), S)
def q_survey_anova_by_age(spark, d):
    return A.anova_oneway(V.survey(spark, d), ["bmi", "ment_hlth"], "age", min_group=5, with_p=False)


def _unrounded(sql: str) -> str:
    return sql.replace("6) + 0.0", "17)")


@register("listings_group_tests",
          f"WITH kw AS ({_unrounded(_kruskal_sql('v_listings', ['price'], 'room_type'))}), "
          f"an AS ({_unrounded(_anova_sql('v_listings', ['price'], 'room_type', 5))}) "
          f"SELECT kw.variable, kw.k, kw.n, {R('h', 'h')}, kw.dof, {R(chi2_p_sql('h', 'dof'), 'kruskal_p')}, {R('f', 'f')}, "
          + R(f_p_sql("f", "CAST(df_between AS DOUBLE)", "CAST(df_within AS DOUBLE)"), "p_value")
          + " FROM kw JOIN an ON kw.variable = an.variable", L)
def q_listings_group_tests(spark, d):
    """T10/T11, X1 — Kruskal–Wallis and ANOVA of price by room type, with p-values."""
    v = V.listings(spark, d)
    kw = A.kruskal_wallis(v, ["price"], "room_type")
    an = A.anova_oneway(v, ["price"], "room_type", min_group=5)
    return kw.withColumnRenamed("p_value", "kruskal_p").join(an.select("variable", "f", "p_value"), "variable")


@register("survey_group_means_by_class",
          f"SELECT variable, CAST(target AS DOUBLE) AS target, COUNT(*) AS n, {R('AVG(value)', 'mean')} FROM "
          f"{unpivot_sql('v_survey', ['bmi', 'ment_hlth', 'age'], by=['target'])} WHERE target IS NOT NULL "
          "GROUP BY variable, target", S)
def q_survey_group_means_by_class(spark, d):
    s = V.survey(spark, d)
    return A.group_means(s.withColumn("target", s["target"].cast("double")), ["bmi", "ment_hlth", "age"], "target")


_MI_NOMINAL = V.SURVEY_NOMINAL + ["age", "income", "education"]


def _mi_sql():
    cols = _MI_NOMINAL + ["bmi"]
    edges = ("(SELECT quantile_cont(CAST(bmi AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e "
             "FROM v_survey WHERE bmi IS NOT NULL)")
    return (
        "WITH l AS (SELECT class, variable, value FROM (SELECT * FROM (SELECT CAST(target AS DOUBLE) AS class, "
        + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
        + f" FROM v_survey) UNPIVOT (value FOR variable IN ({', '.join(cols)}))) WHERE class IS NOT NULL), "
        f"b AS (SELECT class, variable, CASE WHEN variable = 'bmi' THEN CAST(len(list_filter({edges}, "
        "lambda e: value > e)) AS DOUBLE) ELSE value END AS value FROM l), "
        "o AS (SELECT variable, value, class, COUNT(*) AS o FROM b GROUP BY variable, value, class), "
        "r AS (SELECT variable, value, SUM(o) AS r FROM o GROUP BY variable, value), "
        "c AS (SELECT variable, class, SUM(o) AS c FROM o GROUP BY variable, class), "
        "n AS (SELECT variable, SUM(o) AS n FROM o GROUP BY variable) "
        "SELECT o.variable, n.n, " + R("SUM(o.o / n.n * ln(o.o * n.n / (r.r * c.c)))", "mi")
        + " FROM o JOIN r ON o.variable = r.variable AND o.value = r.value "
        "JOIN c ON o.variable = c.variable AND o.class = c.class JOIN n ON o.variable = n.variable "
        "GROUP BY o.variable, n.n")


@register("survey_mutual_information", _mi_sql(), S)
def q_survey_mutual_information(spark, d):
    return A.mutual_information(V.survey(spark, d), _MI_NOMINAL + ["bmi"], "target", continuous=["bmi"], bins=10)


def _digamma_sql(m: str) -> str:
    """ψ of a positive integer as the SQL of its series, moved up by 10."""
    y = f"({m} + 10.0)"
    return (f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) "
            f"+ 1 / (240 * pow({y}, 8)) - list_sum([1.0::DOUBLE / ({m} + i) FOR i IN range(10)]))")


def _neighbour_sql(view, cols, target, k=3):
    """Neighbours from lags and leads of each class's values, rows inside by as-of joins."""
    sides = " UNION ALL ".join(
        f"SELECT class, variable, value, {f}(value, {j}) OVER w AS y, {f}(cnt, {j}) OVER w AS yc FROM v "
        "WINDOW w AS (PARTITION BY class, variable ORDER BY value)" for f in ("lag", "lead") for j in range(1, k + 1))
    return (
        f"WITH v AS (SELECT class, variable, value, COUNT(*) AS cnt FROM (SELECT * FROM (SELECT CAST({target} AS VARCHAR) AS class, "
        + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
        + f" FROM {view}) UNPIVOT (value FOR variable IN ({', '.join(cols)}))) WHERE class IS NOT NULL GROUP BY ALL), "
        "s AS (SELECT class, variable, SUM(cnt) AS nc FROM v GROUP BY ALL HAVING SUM(cnt) > 1), "
        f"o AS ({sides} UNION ALL SELECT class, variable, value, value, cnt - 1 FROM v), "
        "a AS (SELECT class, variable, value, abs(y - value) AS d, SUM(yc) OVER (PARTITION BY class, variable, value ORDER BY abs(y - value)) AS have "
        "FROM o WHERE y IS NOT NULL), "
        f"r AS (SELECT a.class, a.variable, a.value, nc, least({k}, nc - 1) AS k, MIN(d) AS r FROM a JOIN s ON a.class = s.class AND a.variable = s.variable "
        f"WHERE have >= least({k}, nc - 1) GROUP BY ALL), "
        "b AS (SELECT r.*, v.cnt, least(r.value, r.value - r + e) AS lo, greatest(r.value, r.value + r - e) AS hi FROM "
        "(SELECT *, pow(2.0, -50) * (abs(value) + r) AS e FROM r) r JOIN v ON r.class = v.class AND r.variable = v.variable AND r.value = v.value), "
        "u AS (SELECT variable, value, SUM(SUM(cnt)) OVER (PARTITION BY variable ORDER BY value) AS upto FROM b GROUP BY variable, value), "
        "m AS (SELECT b.variable, b.cnt, b.k, b.nc, h.upto - coalesce(l.upto, 0) AS m FROM b ASOF JOIN u h ON b.variable = h.variable AND b.hi >= h.value "
        "ASOF LEFT JOIN u l ON b.variable = l.variable AND b.lo > l.value), "
        f"t AS (SELECT variable, CAST(SUM(cnt) AS BIGINT) AS n, SUM(cnt * ({_digamma_sql('k')} - {_digamma_sql('nc')} - {_digamma_sql('m')})) AS t "
        "FROM m GROUP BY variable) "
        f"SELECT variable, n, {R('greatest(0.0, ' + _digamma_sql('n') + ' + t / n)', 'mi')} FROM t")


_NEAR_LISTINGS = ["price", "number_of_reviews", "reviews_per_month", "availability_365"]
_NEAR_SURVEY = V.SURVEY_NOMINAL + ["bmi", "ment_hlth", "phys_hlth", "gen_hlth", "age", "income", "education"]


@register("listings_neighbour_information", _neighbour_sql("v_listings", _NEAR_LISTINGS, "room_type"), L)
def q_listings_neighbour_information(spark, d):
    """T12 — neighbour estimate of the information of continuous columns about the room type."""
    return neighbour_information(V.listings(spark, d), _NEAR_LISTINGS, "room_type")


@register("survey_neighbour_information", _neighbour_sql("v_survey", _NEAR_SURVEY, "target"), S)
def q_survey_neighbour_information(spark, d):
    """T12 — the same of every survey variable about the class; all their values are ties."""
    return neighbour_information(V.survey(spark, d), _NEAR_SURVEY, "target")
