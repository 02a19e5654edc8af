"""Operator 9: find benchmark passages in training documents with spaced seeds.

Only DataFrame functions: every step is a scan, a join or a higher-order array function.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import spare, stage

#: Seeds: a 0 is a place whose token is ignored.  Whichever two of 13 tokens differ, one of the
#: first list fits between them; whichever two of ten, one of the second.
MASKS = ("11010111", "111001011")
SHORT_MASKS = ("110111", "1101011", "1100111")
WINDOW = 13
SHARE = 0.8
#: Seed tables up to this many rows (about 40 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def tokens(text: str) -> Column:
    """Lower-cased runs of letters and digits; empty for null text."""
    words = F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+")
    return F.coalesce(F.filter(words, lambda x: x != ""), F.array().cast("array<string>"))


def covers(masks: tuple[str, ...], size: int, miss: int) -> bool:
    """Whether some mask fits in ``size`` places wherever ``miss`` of them differ."""
    read = [{o + i for i, bit in enumerate(m) if bit == "1"} for m in masks for o in range(size - len(m) + 1)]
    return all(any(r.isdisjoint(c) for r in read) for c in combinations(range(size), miss))


def masks_for(size: int, miss: int, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """Masks that find every window of ``size`` tokens of which ``miss`` differ: the first given
    list that covers all cases, else every way to leave out ``miss`` places, else (for too many
    of those) the run that must stay whole between the differing tokens."""
    ways = comb(size, miss)
    for some in (masks, SHORT_MASKS) if ways <= 10_000 else ():
        if covers(some, size, miss):
            return tuple(some)
    if ways <= 9:
        return tuple(sorted({"".join("0" if i in c else "1" for i in range(size)).strip("0") for c in combinations(range(size), miss)}))
    return ("1" * max(1, ceil((size - miss) / (miss + 1))),)


def _seeds(df: DataFrame, id_col: str, toks: str, masks: tuple[str, ...], where=None) -> DataFrame:
    """(id, pos, h): the hash of every mask at every position, or null where ``where(k, pos)`` is
    false.  Nothing is inferred from an outer explode that would hash the texts once more."""
    hashed = df.select(id_col, F.transform(toks, lambda x: F.xxhash64(x)).alias("th"))

    def at(start):
        h = [F.xxhash64(F.lit(k), *(F.get("th", start + o) for o, bit in enumerate(m) if bit == "1")) for k, m in enumerate(masks)]
        return F.array(*(F.when(where(k, start), x) if where else x for k, x in enumerate(h)))

    starts = F.when(F.size("th") > 0, F.sequence(F.lit(0), F.size("th") - 1))
    return (hashed.select(id_col, F.posexplode_outer(F.transform(starts, at)).alias("pos", "s"))
            .select(id_col, "pos", F.explode("s").alias("h")).where(F.col("h").isNotNull()))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                      item_col: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS,
                      window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """One row per document and benchmark item with a shared passage.

    Columns: id, item, n_match (most equal tokens in one window), n_window, item_tokens.

    Seeds are taken at every position of items and documents, by masks that leave no case out: for
    each size of window that the items have, some mask fits between the tokens that may differ,
    wherever they are.  A seed hit fixes how item and document line up.  The alignment counts if
    some window of ``window`` tokens (the whole item if it is shorter) has equal tokens in
    ``share`` of its places or more, so substituted words do not hide a passage.

    Only hits are shuffled, once per document, item and alignment; a passage in a third of all
    documents costs a row for each.  Nothing pairs documents with each other.

    Null or empty texts match nothing.  Short items count by the same share: one of under five
    tokens stands in a document as it is, and one of a single word in every document with it.
    Repeated rows give one result row, null ids one under null; of several texts of one item the row is
    that of the best share, then of the most equal tokens, then of the longest text.  Empty tables give an empty
    result.  Other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item"), tokens(item_text).alias("itok")).distinct()
    items = stage(items.where(F.size("itok") > 0), "decontam-items")
    size = F.least(F.lit(window), F.size("itok"))
    sizes: dict[str, list[int]] = {}                                    # of windows, by the masks that they need
    for (n,) in items.select(size).distinct().collect():                # at most ``window`` rows
        for mask in masks_for(n, n - ceil(float(share) * n), masks):
            sizes.setdefault(mask, []).append(n)
    used = tuple(sorted(sizes)) or masks

    def needed(k, start):
        return F.least(F.lit(window), F.size("th")).isin(sizes.get(used[k], [])) & (start + len(used[k]) <= F.size("th"))

    want = stage(_seeds(items, "item", "itok", used, needed).select("item", F.col("pos").alias("ipos"), "h").distinct(), "decontam-seeds")
    if want.count() <= BROADCAST_ROWS:
        want = F.broadcast(want)
    doc_tokens = docs.select(F.col(id_col).alias("doc"), tokens(text).alias("tok"))
    hits = stage(_seeds(doc_tokens, "doc", "tok", used).join(want, "h")
                 .select("doc", "item", (F.col("pos") - F.col("ipos")).alias("shift")).distinct(), "decontam-hits")
    found = hits.select(F.col("doc").alias("hit")).distinct()
    near = doc_tokens.join(found, F.col("doc").eqNullSafe(F.col("hit")), "left_semi")
    lined = (hits.select(F.col("doc").alias("hit"), F.col("item").alias("hit_item"), "shift")
             .join(items, F.col("hit_item").eqNullSafe(F.col("item")))
             .join(near, F.col("doc").eqNullSafe(F.col("hit"))))
    same = F.transform("itok", lambda x, p: F.coalesce(F.get("tok", F.col("shift") + p) == x, F.lit(False)))
    windows = (lined.select("hit", "hit_item", F.size("itok").alias("item_tokens"), size.alias("n_window"), same.alias("same"),
                            F.explode(F.sequence(F.lit(1), F.size("itok") - size + 1)).alias("start"))
               .select("hit", "hit_item", "item_tokens", "n_window",
                       F.size(F.filter(F.slice("same", F.col("start"), F.col("n_window")), lambda x: x)).alias("n_match")))
    return (windows.groupBy(F.col("hit").alias(id_col), F.col("hit_item").alias(item_col))
            .agg(F.max(F.struct((F.col("n_match") / F.col("n_window")).alias("share"), "n_match", "n_window", "item_tokens")).alias("best"))
            .select(id_col, item_col, "best.n_match", "best.n_window", "best.item_tokens")
            .where(F.col("n_match") >= F.ceil(F.lit(float(share)) * F.col("n_window"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that share a passage with an item; same columns.

    Rows with a null id go if any of them does.  Other columns may have any name.
    """
    bad = spare(docs, "_q_bad")
    gone = find_contaminated(docs, benchmark, id_col, **options).select(F.col(id_col).alias(bad)).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(bad)), "left_anti")
