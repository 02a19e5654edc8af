"""Operator 11: spelling variants of words, found by asymmetric q-chunks.

Of a pair of words that one edit separates, the shorter one (of equal length: the smaller one)
shows two disjoint chunks, its halves; the other shows all its positional grams of the lengths
that such halves have.  One edit leaves a half intact: the first at the start of the other
word, or the second shifted by the difference of the lengths (none or one).  An equi-join on chunk, place and
length finds these; whatever meets there is verified by edit distance inside the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

#: Fixed by the contract of the query: runs of letters, and the noise that a 97th of them gets.
RUN = "[A-Za-zÀ-ÿ]{%d,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOISE, MIN_LENGTH, MIN_COUNT = 97, 5, 3
#: A form occurs at least so many times as often as the words it stands for.
RATIO = 2


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", noise: int = NOISE,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the runs of letters of all whole texts, A-Z lower-cased, by number of occurrences.

    If ``noise`` divides the crc32 of ``<id>:<run>``, the run loses the code point at crc32 modulo
    its length.  Only words of ``min_length`` code points and ``min_count`` occurrences count.  Null
    and empty texts have no words; a row without an id loses nothing; rows that repeat an id count
    like any other.  Shorter runs cannot give a word and are not read; partial counts go into the shuffle.
    """
    runs = F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN % min_length), F.lit(0)))
    found = docs.select(F.col(id_col).cast("string").alias("_id"), runs.alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run"))
    return (found.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _cut(word: Column, start: Column, size: Column) -> Column:
    return F.substring(word, start + 1, size)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of words that differ by exactly one code point inserted, deleted or
    replaced, once, with the counts of both.

    words: (word, n), each word once; null and empty words are near nothing.  The chunk side has
    four rows a word, the other as many as it has grams.  An insertion between the halves leaves both
    intact; such a pair counts by its first half alone, so no pair comes twice.
    """
    w, size = F.col("word"), F.length("word")
    half = F.floor(size / 2).cast("int")
    whole = words.where(size > 0).select(w, "n", size.alias("size"), half.alias("half"))
    grown = F.explode(F.array(F.lit(0), F.lit(1)))
    chunk = whole.withColumn("grown", grown).select(
        F.col("word").alias("a"), F.col("n").alias("na"), "half", (F.col("size") + F.col("grown")).alias("size"),
        F.inline(F.array(F.struct(_cut(w, F.lit(0), F.col("half")).alias("gram"), F.lit(0).alias("at")),
                         F.struct(_cut(w, F.col("half"), F.col("size") - F.col("half")).alias("gram"), (F.col("half") + F.col("grown")).alias("at")))))
    second = F.col("at") > 0
    other = whole.withColumn("q", F.explode(F.array_distinct(F.array(
        F.col("half"), F.col("size") - F.col("half"), F.floor((F.col("size") - 1) / 2).cast("int"), F.col("size") - 1 - F.floor((F.col("size") - 1) / 2).cast("int")))))
    other = other.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("q"))))
    grams = other.select(F.col("word").alias("b"), F.col("n").alias("nb"), "size", "at", _cut(F.col("word"), F.col("at"), F.col("q")).alias("gram"))
    verified = ((F.length("a") < F.col("size")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    once = ~second | (F.substring("a", F.lit(1), F.col("half")) != F.substring("b", F.lit(1), F.col("half")))
    return chunk.join(grams, ["gram", "size", "at"]).where(verified & once).select("a", "na", "b", "nb")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last word that the forms lead to.

    Each round lets every word point where its target points.  A form occurs at least twice as often
    as its word, so paths have at most the logarithm of the largest count of steps, and the rounds
    the logarithm of that.
    """
    at = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        moved = stage(at.join(ahead, F.col("root") == F.col("_w"), "left")
                      .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variant_groups(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    words: (word, n).  A word's form is its near word of largest n (of these the smallest in
    code-point order) if that n is at least ``ratio`` (over 1) times the word's own, else null;
    root is where the forms lead.  n_near counts near words.  Rows repeating a word are
    summed, null words left out; an empty table gives an empty one; other columns are not read.
    """
    if not ratio > 1:
        raise ValueError("ratio must be over 1, or forms could lead in circles")
    words = stage(words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spelling-words")
    pairs = near_pairs(words).select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))).alias("p")).select("p.*")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("x"), F.col("near"))).alias("best"))
    held = F.when(-F.col("best.x") >= ratio * F.col("n"), F.col("best"))
    named = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), held["near"].alias("form"), (-held["x"]).alias("form_n")), "spelling-near")
    roots = _roots(named.where("form is not null"))
    return (named.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
