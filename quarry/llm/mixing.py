"""Operator 10: rake token weights to source, language and topic marginals, then draw documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

#: Production parameters: a dimension's target shares are its token totals to this power.
ALPHAS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
KEEP = 0.5
ROUNDS = 8
FILL_ROUNDS = 8
SEED = 17

_NONE = "(none)"


def word_count(text: str) -> Column:
    """Words between spaces, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t\\n\\r]+")), F.lit(0))


def text_topic(text: str, words: Column) -> Column:
    """A stand-in topic by form: the tables carry none."""
    return (F.when(F.col(text).contains(" | "), "table").when(F.col(text).contains("!!"), "slogan")
            .when(words < 150, "note").when(words < 600, "article").otherwise("book"))


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id alone: the same under any partitioning and retry."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (dimensions, t tokens) with weights w whose marginals meet the targets.

    Each round scales w so that one dimension after the other has its target total.  A target is
    either a power (share proportional to tokens to that power) or a dict of shares, where a value
    that is not listed gets none.  Marginal sums are pre-aggregated; each is a small table.
    """
    spark = cells.sparkSession
    goals = {}
    for dim, goal in targets.items():
        if isinstance(goal, dict):
            goals[dim] = spark.createDataFrame([(str(k), float(v)) for k, v in goal.items()], f"`{dim}` string, g double")
        else:
            goals[dim] = stage(cells.groupBy(dim).agg(F.pow(F.sum("t"), F.lit(float(goal))).alias("g")), "mix-goal")
        total = goals[dim].agg(F.sum("g")).first()[0] or 1.0
        goals[dim] = goals[dim].withColumn("g", F.col("g") / F.lit(total))
    w = cells.withColumn("w", F.col("t"))
    for _ in range(rounds):
        for dim in targets:
            has = w.groupBy(dim).agg(F.sum("w").alias("has")).join(goals[dim], dim, "left")
            factor = has.select(dim, F.coalesce(F.try_divide("g", "has"), F.lit(0.0)).alias("f"))
            w = w.join(factor, dim).withColumn("w", F.col("w") * F.col("f")).drop("f")
        w = stage(w, "mix-cells")
    return w


def mix_to_targets(docs: DataFrame, targets: dict[str, float | dict[str, float]] | None = None, id_col: str = "doc_id",
                   tokens: str = "tokens", keep: float = KEEP, rounds: int = ROUNDS, fill_rounds: int = FILL_ROUNDS,
                   seed: int = SEED) -> DataFrame:
    """A sample of ``docs`` whose tokens meet the target shares in every dimension, plus ``p``.

    Tokens are summed per cell of the dimensions, the cell weights are raked, and a document is
    drawn with p = min(1, scale * weight / tokens of its cell).  The scale is chosen so that
    ``keep`` of all tokens are expected; cells too small for their weight are taken whole and the
    others make up for it (``fill_rounds`` steps).  Only sums reach the driver.

    Null dimension values are a value of their own.  Null or zero tokens weigh nothing: such rows
    get the p of their cell, or 0 in a cell without tokens.  Rows of one id are drawn together.
    An empty table gives an empty one.  Other columns pass through; ``p`` and names starting with
    ``_q_`` are reserved, a column of such a name is replaced.
    """
    targets = targets or ALPHAS
    docs = docs.drop("p")
    dims = {d: f"_q_{i}" for i, d in enumerate(targets)}
    keyed = docs.withColumns({k: F.coalesce(F.col(d).cast("string"), F.lit(_NONE)) for d, k in dims.items()})
    cells = stage(keyed.groupBy(*dims.values()).agg(F.coalesce(F.sum(F.col(tokens).cast("double")), F.lit(0.0)).alias("t"))
                  .where("t > 0"), "mix-cells")
    total = cells.agg(F.sum("t")).first()[0] or 0.0
    w = rake(cells, {k: targets[d] for d, k in dims.items()}, rounds)
    r = F.col("w") / F.col("t")
    scale, budget = total * keep, total * keep
    for _ in range(fill_rounds):
        whole = F.lit(scale) * r >= 1
        took, rest = w.agg(F.coalesce(F.sum(F.when(whole, F.col("t"))), F.lit(0.0)),
                           F.coalesce(F.sum(F.when(~whole, F.col("w"))), F.lit(0.0))).first()
        if rest <= 0 or (budget - took) / rest <= scale:
            break
        scale = (budget - took) / rest
    chance = stage(w.select(*dims.values(), F.least(F.lit(1.0), F.lit(scale) * r).alias("p")), "mix-p")
    drawn = keyed.join(chance, list(dims.values()), "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return drawn.where(draw(id_col, seed) < F.col("p")).select(*docs.columns, "p")


def with_tokens_and_topic(documents: DataFrame) -> DataFrame:
    """``documents`` with their word count and stand-in topic; columns ``tokens`` and ``topic`` are replaced."""
    counted = documents.withColumn("tokens", word_count("text").cast("long"))
    return counted.withColumn("topic", text_topic("text", F.col("tokens")))


def _oracle() -> str:
    """The same steps as DuckDB SQL, one CTE per scaling."""
    dims = list(ALPHAS)
    parts = [r"""d AS (SELECT *, CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'slogan'
      WHEN tokens < 150 THEN 'note' WHEN tokens < 600 THEN 'article' ELSE 'book' END AS topic
      FROM (SELECT doc_id, text, source, lang, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) AS BIGINT) AS tokens FROM documents))""",
             "c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS t, sum(tokens)::DOUBLE AS w FROM d GROUP BY ALL HAVING sum(tokens) > 0)"]
    for x in dims:
        parts.append(f"g_{x} AS (SELECT {x}, g / sum(g) OVER () AS g FROM (SELECT {x}, pow(sum(t), {ALPHAS[x]}) AS g FROM c0 GROUP BY {x}))")
    n = 0
    for _ in range(ROUNDS):
        for x in dims:
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, t, w * g.g / sum(w) OVER (PARTITION BY c.{x}) AS w "
                         f"FROM c{n} c JOIN g_{x} g ON c.{x} IS NOT DISTINCT FROM g.{x})")
            n += 1
    parts.append(f"s0 AS (SELECT sum(t) * {KEEP} AS b, sum(t) * {KEEP} AS s FROM c0)")
    for i in range(FILL_ROUNDS):
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT b, greatest(s, coalesce((b - took) / nullif(rest, 0), s)) AS s FROM (SELECT b, s, "
                     f"(SELECT coalesce(sum(t), 0) FROM c{n} WHERE s * (w / t) >= 1) AS took, "
                     f"(SELECT coalesce(sum(w), 0) FROM c{n} WHERE NOT s * (w / t) >= 1) AS rest FROM s{i}))")
    parts.append(f"p AS (SELECT source, lang, topic, least(1.0, s * (w / t)) AS p FROM c{n}, s{FILL_ROUNDS})")
    return ("WITH " + ",\n".join(parts) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(p.p, 6) + 0.0 AS p
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic
WHERE ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p.p""")


ORACLE = _oracle()
