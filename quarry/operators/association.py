"""Association and hypothesis tests (T-family).

All statistics are computed from grouped counts or grouped moments — the data are scanned once
per test family and reduced by partial aggregation before any shuffle; only result rows
(one per variable or pair) reach the p-value UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.clean import significance_stars
from quarry.functions.moments import safe_corr
from quarry.functions.pvalues import chi2_sf, f_sf, t_two_sided
from quarry.operators.ranks import cumulative_counts, quantiles, to_long
from quarry.session import materialize


# ------------------------------------------------------------------------------- correlation
def pearson_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """T1 — pairwise-complete Pearson r for every pair (x < y in list order), one ``agg``:
    ``(var_x, var_y, r, n)``.  Constant columns give NULL, not an error."""
    pairs = list(combinations(cols, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs += [safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}"),
                 F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}")]
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col(f"r{i}").alias("r"),
                        F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*structs)))


#: Most distinct values of a column whose ranks are broadcast to the rows.
BROADCAST_RANKS = 100_000


def spearman_matrix(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """T2 — Spearman ρ = Pearson r of mid-ranks taken on each pair's complete rows:
    ``(var_x, var_y, rho, n)``.

    A column's rank in a pair depends on the other column only by its nulls, so values are counted
    once by the nulls that the row has, and ranked once per column and set of rows.  Ranks of
    columns with few values are broadcast to the rows, and no row is sent by such a value; a column
    of many values costs one join.  Then one aggregate correlates all pairs.  ``df`` is scanned
    three times, twice when this is called: the caller writes it first where that is dear."""
    pairs = list(pairs or combinations(cols, 2))
    used = list(dict.fromkeys(c for p in pairs for c in p))
    x = {c: F.col(c).cast("double") for c in used}
    nulls = df.agg(*[F.count_if(x[c].isNull()).alias(f"c{i}") for i, c in enumerate(used)]).first()
    partial = [c for c, n in zip(used, nulls) if n]
    # the rows of a pair, seen from one column: all it has, or those that a column with nulls has too
    among = {c: sorted({o if o in partial else "" for p in pairs for o, own in (p, p[::-1]) if own == c}) for c in used}
    has = {o: 1 << i for i, o in enumerate(partial)}
    mask = sum((F.when(x[o].isNotNull(), bit).otherwise(0) for o, bit in has.items()), F.lit(0).cast("long"))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("column"), x[c].alias("value"), mask.alias("mask")) for i, c in enumerate(used)]))).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value", "mask").agg(F.count("*").alias("cnt"))
    sets = F.inline(F.array_compact(F.array(*[
        F.when((F.col("column") == i) & (F.col("mask").bitwiseAND(has.get(o, 0)) == has.get(o, 0)),
               F.struct(F.lit(f"{i}_{k}").alias("variable"), F.col("value"), F.col("cnt")))
        for i, c in enumerate(used) for k, o in enumerate(among[c])])))
    ranks = materialize(cumulative_counts(counts.select(sets).groupBy("variable", "value").agg(F.sum("cnt").alias("cnt"))))
    distinct = {r["variable"]: r["n"] for r in ranks.groupBy("variable").agg(F.count("*").alias("n")).collect()}     # a row a column and set
    small = materialize(ranks.where(F.col("variable").isin([v for v, n in distinct.items() if n <= BROADCAST_RANKS])))
    rows = df.select(*[x[c].alias(f"v{i}") for i, c in enumerate(used)])
    for i, c in enumerate(used):
        names = [f"{i}_{k}" for k in range(len(among[c]))]
        few = max(distinct.get(name, 0) for name in names) <= BROADCAST_RANKS
        own = ((small if few else ranks).where(F.col("variable").isin(names)).groupBy(F.col("value").alias(f"v{i}"))
               .agg(*[F.max(F.when(F.col("variable") == name, F.col("rank"))).alias(f"r{name}") for name in names]))
        rows = rows.join(F.broadcast(own) if few else own, f"v{i}", "left" if c in partial else "inner").drop(f"v{i}")
    at = {(c, o): F.col(f"r{i}_{k}") for i, c in enumerate(used) for k, o in enumerate(among[c])}
    both = [(at[a, b if b in partial else ""], at[b, a if a in partial else ""]) for a, b in pairs]
    there = [p[0].isNotNull() & p[1].isNotNull() for p in both]
    row = rows.agg(*[F.count_if(ok).alias(f"n{k}") for k, ok in enumerate(there)],
                   *[safe_corr(F.when(ok, a), F.when(ok, b)).alias(f"p{k}") for k, ((a, b), ok) in enumerate(zip(both, there))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col(f"p{k}").alias("rho"),
                                                  F.col(f"n{k}").alias("n")) for k, (a, b) in enumerate(pairs)]))).where("n > 0")


def with_target(matrix: DataFrame, target: str, stat: str, k: int | None = None, by_abs: bool = True) -> DataFrame:
    """T3 — correlations of every variable with ``target`` (self excluded), sorted by |r|
    (or r), optionally the top ``k``: ``(variable, stat, n)``."""
    a = matrix.where(F.col("var_x") == target).select(F.col("var_y").alias("variable"), stat, "n")
    b = matrix.where(F.col("var_y") == target).select(F.col("var_x").alias("variable"), stat, "n")
    out = a.unionByName(b)
    order = [F.abs(F.col(stat)).desc_nulls_last() if by_abs else F.col(stat).desc_nulls_last(), F.col("variable")]
    out = out.orderBy(*order)
    return out.limit(k) if k else out


def correlation_tests(df: DataFrame, target: str, cols: Sequence[str], min_n: int = 10) -> DataFrame:
    """T4/T5/T6 — Pearson and Spearman of each column with ``target``, side by side, with
    two-sided t-test p-values (n − 2 degrees of freedom) and significance stars; pairs with
    fewer than ``min_n`` complete rows are skipped."""
    pairs = [(c, target) for c in cols if c != target]
    pear = pearson_matrix(df.select(*{c for p in pairs for c in p}), [c for c, _ in pairs] + [target]) \
        .where(F.col("var_y") == target)
    spear = spearman_matrix(df, [], pairs)
    j = pear.select(F.col("var_x").alias("variable"), F.col("r").alias("pearson_r"), F.col("n")) \
        .join(spear.select(F.col("var_x").alias("variable"), F.col("rho").alias("spearman_rho")), "variable")
    j = j.where(F.col("n") >= min_n)
    dof = F.col("n") - 2

    def t_of(r):
        return r * F.sqrt(dof / F.greatest(F.lit(1e-300), 1 - r * r))
    return (j.withColumn("pearson_p", t_two_sided(t_of(F.col("pearson_r")), dof))
             .withColumn("spearman_p", t_two_sided(t_of(F.col("spearman_rho")), dof))
             .withColumn("pearson_sig", significance_stars("pearson_p"))
             .withColumn("spearman_sig", significance_stars("spearman_p")))


# ------------------------------------------------------------------------------- chi-square
def contingency_counts(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """``(variable, value, class, o)`` — observed cells, rows with a null on either side dropped.
    Values and classes are compared as text, so nominal columns work and large integers stay apart."""
    wide = df.select(F.col(target).cast("string").alias("class"), *[F.col(c).cast("string").alias(c) for c in cols])
    long = wide.unpivot(["class"], list(cols), "variable", "value")
    return (long.where(F.col("class").isNotNull() & F.col("value").isNotNull())
                .groupBy("variable", "value", "class").agg(F.count("*").alias("o")))


def independence_test(o: DataFrame, yates: bool = True, min_n: int | None = None, with_p: bool = True) -> DataFrame:
    """χ² of independence from a table of cells ``(variable, value, class, o)``:
    ``(variable, n, n_rows, n_cols, dof, chi2, cramers_v[, p_value])``.

    χ² = Σ (O − E)² / E over observed cells, plus E of the empty ones: per row of the table,
    r · (n − the class totals it has) / n.  Products are taken in double precision, so counts of
    any size neither overflow nor cancel.  With ``yates`` and dof = 1 (2×2), each |O − E| is
    reduced by min(0.5, |O − E|) over all four cells.  Cramér's V uses that χ²; NULL when a side
    has one category (dof = 0) or fewer than ``min_n`` rows remain.
    """
    r = o.groupBy("variable", "value").agg(F.sum("o").alias("r"))
    c = o.groupBy("variable", "class").agg(F.sum("o").alias("c"))
    dims = (o.groupBy("variable").agg(F.sum("o").alias("n"), F.count_distinct("value").alias("n_rows"),
                                      F.count_distinct("class").alias("n_cols")))
    n, e = F.col("n").cast("double"), F.col("r").cast("double") * F.col("c") / F.col("n")
    cells = o.join(r, ["variable", "value"]).join(c, ["variable", "class"]).join(dims, "variable").withColumn("e", e)
    rows = cells.groupBy("variable", "value", "r", "n").agg(F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e")).alias("seen"),
                                                            F.sum("c").alias("has"))
    plain = rows.groupBy("variable").agg(F.sum(F.col("seen") + F.col("r") * ((F.col("n") - F.col("has")) / n)).alias("chi2_plain"))
    out = dims.join(plain, "variable")
    chi2 = F.col("chi2_plain")
    if yates:
        # 2×2 variables only: the full grid is four cells per variable.
        two = dims.where((F.col("n_rows") == 2) & (F.col("n_cols") == 2)).select("variable", "n")
        grid = (r.join(two, "variable").join(c, "variable").join(o, ["variable", "value", "class"], "left")
                 .withColumn("e", e).withColumn("ad", F.abs(F.coalesce(F.col("o"), F.lit(0)) - F.col("e"))))
        yt = grid.groupBy("variable").agg(
            F.sum(F.pow(F.col("ad") - F.least(F.lit(0.5), F.col("ad")), 2) / F.col("e")).alias("chi2_yates"))
        out = out.join(yt, "variable", "left")
        chi2 = F.coalesce("chi2_yates", "chi2_plain")
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    valid = dof > 0
    if min_n is not None:
        valid = valid & (F.col("n") >= min_n)
    out = out.select("variable", "n", "n_rows", "n_cols", dof.alias("dof"), F.when(valid, chi2).alias("chi2"))
    k = F.least(F.col("n_rows"), F.col("n_cols")) - 1
    out = out.withColumn("cramers_v", F.when(k > 0, F.sqrt(F.col("chi2") / (n * k))))
    return out.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof"))) if with_p else out


def chi_square(df: DataFrame, cols: Sequence[str], target: str, yates: bool = True,
               min_n: int | None = None, with_p: bool = True) -> DataFrame:
    """T7/T8 — χ² test of independence of each column against ``target`` (``independence_test``)."""
    o = materialize(contingency_counts(df, cols, target))   # cells feed marginals, E and the grid
    return independence_test(o, yates, min_n, with_p)


def chi_square_pair(df: DataFrame, a: str, b: str, k: int = 6, min_n: int = 20, with_p: bool = True) -> DataFrame:
    """T9 — R×C χ² (no continuity correction) on the top-``k`` categories of ``a`` and ``b``;
    NULL when fewer than ``min_n`` rows remain."""
    from quarry.operators.profile import top_categories
    sub = (df.join(F.broadcast(top_categories(df, a, k)), a, "left_semi")
             .join(F.broadcast(top_categories(df, b, k)), b, "left_semi"))
    o = materialize(contingency_counts(sub, [a], b))         # at most k × k cells
    return independence_test(o, False, min_n, with_p).select(F.lit(b).alias("versus"), "*")


# ------------------------------------------------------------------------------- group tests
def kruskal_wallis(df: DataFrame, cols: Sequence[str], group: str, with_p: bool = True) -> DataFrame:
    """T10 — tie-corrected Kruskal–Wallis H of each column across the groups of ``group``:
    ``(variable, k, n, h, dof[, p_value])``; rows with a null value or group are dropped; NULL H
    with fewer than two groups.  Ranks: W1 over all groups; per-group sums of the deviations from
    the mean rank, which do not cancel for any number of rows, come from the (group, value) count
    table, never from rows."""
    base = df.withColumn("_g", F.col(group))
    long = to_long(base, cols, by=["_g"]).where(F.col("_g").isNotNull())
    gv = materialize(long.groupBy("variable", "_g", "value").agg(F.count("*").alias("cnt")))
    vc = gv.groupBy("variable", "value").agg(F.sum("cnt").alias("cnt"))
    rt = cumulative_counts(vc)                       # (variable, value, cnt, cum_before, n, rank)
    ties = rt.groupBy("variable").agg(F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("_t"),
                                      F.first("n").alias("n"))
    rs = (gv.join(rt.select("variable", "value", "rank", "n"), ["variable", "value"])
            .groupBy("variable", "_g").agg(F.sum(F.col("cnt") * (F.col("rank") - (F.col("n") + 1) / F.lit(2.0))).alias("_d"),
                                           F.sum("cnt").alias("_ng")))
    agg = rs.groupBy("variable").agg(F.sum(F.col("_d") * (F.col("_d") / F.col("_ng"))).alias("_s"),
                                     F.count("*").alias("k"))
    j = agg.join(ties, "variable")
    n = F.col("n").cast("double")
    h0 = F.lit(12.0) / (n * (n + 1)) * F.col("_s")
    corr = 1 - F.col("_t") / (n * n * n - n)
    out = j.select("variable", "k", "n",
                   F.when((F.col("k") >= 2) & (corr > 0), h0 / corr).alias("h"), (F.col("k") - 1).alias("dof"))
    return out.withColumn("p_value", chi2_sf(F.col("h"), F.col("dof"))) if with_p else out


def anova_oneway(df: DataFrame, cols: Sequence[str], group: str, min_group: int = 1,
                 with_p: bool = True) -> DataFrame:
    """T11 — one-way ANOVA F of each column across groups with at least ``min_group``
    non-null values: ``(variable, k, n, f, df_between, df_within[, p_value])``."""
    long = to_long(df.withColumn("_g", F.col(group)), cols, by=["_g"]).where(F.col("_g").isNotNull())
    g = (long.groupBy("variable", "_g").agg(F.count("*").alias("ng"), F.avg("value").alias("mg"),
                                            F.var_samp("value").alias("vg"))
             .where(F.col("ng") >= min_group))
    g = materialize(g)                                   # k rows per variable, used twice
    tot = g.groupBy("variable").agg(F.sum("ng").alias("n"), F.count("*").alias("k"),
                                    (F.sum(F.col("ng") * F.col("mg")) / F.sum("ng")).alias("grand"))
    j = g.join(tot, "variable")
    s = j.groupBy("variable", "n", "k").agg(
        F.sum(F.col("ng") * F.pow(F.col("mg") - F.col("grand"), 2)).alias("ssb"),
        F.sum(F.coalesce((F.col("ng") - 1) * F.col("vg"), F.lit(0.0))).alias("ssw"))
    dfb, dfw = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.when((F.col("k") >= 2) & (dfw > 0) & (F.col("ssw") > 0), (F.col("ssb") / dfb) / (F.col("ssw") / dfw))
    out = s.select("variable", "k", "n", f.alias("f"), dfb.alias("df_between"), dfw.alias("df_within"))
    return out.withColumn("p_value", f_sf(F.col("f"), F.col("df_between"), F.col("df_within"))) if with_p else out


def group_means(df: DataFrame, cols: Sequence[str], group: str) -> DataFrame:
    """T13 — mean of each column per group beside the tests: ``(variable, group, n, mean)``."""
    long = to_long(df.withColumn("_g", F.col(group)), cols, by=["_g"]).where(F.col("_g").isNotNull())
    return long.groupBy("variable", F.col("_g").alias(group)).agg(F.count("*").alias("n"),
                                                                   F.avg("value").alias("mean"))


# ------------------------------------------------------------------------------- mutual information
def quantile_binned(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Replace the listed columns by their exact-quantile bin 0..bins−1 (a value equal to an edge
    falls in the lower bin).  All edges are one scalar subquery; a row's bin is a sum of comparisons."""
    probs = [i / bins for i in range(1, bins)]
    names = [f"e{i}" for i in range(1, bins)]
    q = quantiles(df, cols, probs, names=names)
    edges = q.agg(F.map_from_entries(F.collect_list(F.struct("variable", F.struct(*names))))).scalar()
    for c in cols:
        own, x = F.element_at(edges, F.lit(c)), F.col(c).cast("double")
        above = [(x > own.getField(e)).cast("int") for e in names]
        df = df.withColumn(c, sum(above[1:], above[0]))
    return df


def mutual_information(df: DataFrame, cols: Sequence[str], target: str, continuous: Sequence[str] = (),
                       bins: int = 10) -> DataFrame:
    """T12 (re-aimed) — plug-in mutual information in nats of each column with ``target`` from
    grouped counts: Σ p(x,y)·ln(p(x,y) / (p(x)·p(y))); ``continuous`` columns are first cut
    into ``bins`` exact-quantile bins.  Output ``(variable, n, mi)``."""
    if continuous:
        df = quantile_binned(df, list(continuous), bins)
    o = materialize(contingency_counts(df, cols, target))
    return information(o)


def information(o: DataFrame) -> DataFrame:
    """Plug-in mutual information ``(variable, n, mi)`` from cells ``(variable, value, class, o)``:
    Σ o/n · (ln(o / r) + ln(n / c)), without products of counts."""
    r = o.groupBy("variable", "value").agg(F.sum("o").alias("r"))
    c = o.groupBy("variable", "class").agg(F.sum("o").alias("c"))
    n = o.groupBy("variable").agg(F.sum("o").alias("n"))
    j = o.join(r, ["variable", "value"]).join(c, ["variable", "class"]).join(n, "variable")
    term = F.col("o") / F.col("n") * (F.log(F.col("o") / F.col("r")) + F.log(F.col("n") / F.col("c")))
    return j.groupBy("variable", "n").agg(F.sum(term).alias("mi"))
