"""Operator 6: drop lines that are boilerplate of their own site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

#: From the line ratios of sf0.1 and check_s: the lowest of 0.1, 0.02, 0.01, 0.005 at which no
#: document loses all its lines (at 0.005 copied documents on check_s do).
RATIO = 0.01
#: Pages that a boilerplate line is on at least.  Where the ratio asks for fewer, the host is small
#: and chance weighs more: there this number grows with the factor that is missing, to this power.
MIN_PAGES = 5
SMALL_POWER = 0.25

_NO_HOST = "\x00"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a trimmed line: groups by it stand for groups by the line."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(line, F.lit(1)).alias("g"))


def site_lines(docs: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_q_host, _q_bad): for each host the keys of its boilerplate lines.

    A host has at most (mean distinct lines per page) / ratio such lines, so each list is short
    however many pages the host has.
    """
    host_key = F.coalesce(F.col(host).cast("string"), F.lit(_NO_HOST)).alias("_q_host")
    pages = docs.groupBy(host_key).agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _key))
    seen = (docs.select(host_key, F.explode(keys).alias("k")).groupBy("_q_host", "k.h", "k.g")
            .agg(F.count("*").alias("with_line")).where(F.col("with_line") >= min_pages))
    share = F.lit(float(ratio)) * F.col("pages")
    wanted = F.round(F.lit(float(min_pages)) * F.pow(F.greatest(F.lit(1.0), F.lit(float(min_pages)) / share), F.lit(SMALL_POWER)))
    bad = seen.join(pages, "_q_host").where((F.col("with_line") > share) & (F.col("with_line") >= wanted))
    return bad.groupBy("_q_host").agg(F.collect_list(F.struct("h", "g")).alias("_q_bad"))


def drop_site_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                    min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines cut out of ``text``, plus n_lines and n_dropped.

    A line (trimmed; blank ones never count) is boilerplate of a host when more than ``ratio`` of
    the host's rows, and at least ``min_pages`` of them, contain it.  On a host so small that the ratio
    asks for less than ``min_pages``, that number grows with the fourth root of what is missing: by
    default 5 from 500 pages on, 7 of 100, 9 of 50.  Every occurrence goes.  Line
    counts are pre-aggregated per task before the shuffle, so a hot host or line costs one row per
    task.  The list per host is a staged table: Spark broadcasts it if its files are small and
    shuffles otherwise, splitting a hot host.

    Null text: stays null, with 0 lines, and counts as a page.  Empty text: one blank line.  Null
    host: one host of its own.  Repeated rows: each is a page.  An empty table gives an empty one.
    Other columns pass through; the names n_lines and n_dropped and those starting with ``_q_``
    are reserved, a column of such a name in ``docs`` is replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "_q_host", "_q_bad")
    bad = stage(site_lines(docs, host, text, ratio, min_pages), "site-lines")
    keyed = docs.withColumn("_q_host", F.coalesce(F.col(host).cast("string"), F.lit(_NO_HOST)))
    kept = F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_q_bad"), _key(x)))
    cut = (keyed.join(bad, "_q_host", "left")
           .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text))))
           .withColumn("_q_kept", F.when(F.col("_q_bad").isNotNull(), kept))
           .withColumn("n_dropped", F.when(F.col("_q_kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("_q_kept")))
           .withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("_q_kept", "\n")).otherwise(F.col(text))))
    return cut.select(*docs.columns, "n_lines", "n_dropped")


ORACLE = f"""
WITH l AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT source, count(*) AS pages FROM l GROUP BY source),
d AS (SELECT DISTINCT r, source, trim(x) AS x FROM (SELECT r, source, unnest(ls) AS x FROM l) WHERE trim(x) <> ''),
bad AS (SELECT source, list(x) AS bx FROM (
    SELECT d.source, x FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
    GROUP BY d.source, x, pages HAVING count(*) > CAST({RATIO} AS DOUBLE) * pages
      AND count(*) >= round({MIN_PAGES} * pow(greatest(1, {MIN_PAGES} / (CAST({RATIO} AS DOUBLE) * pages)), {SMALL_POWER}))) GROUP BY source),
k AS (SELECT l.*, CASE WHEN bx IS NULL THEN ls ELSE list_filter(ls, lambda x: trim(x) = '' OR NOT list_contains(bx, trim(x))) END AS kept
      FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS INTEGER) AS n_dropped
FROM k
"""
