"""Operator 5: language of a document as a mixture, by expectation-maximisation over words."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, text_batches

BUCKETS = 1 << 16
#: About so many training documents of each language.
TRAIN_DOCS = 3000
STEPS = 12
UNKNOWN = "und"
#: No word may count against a language by more than this (in nats): misspellings and names.
FLOOR = 12.0

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether a code point is a letter; made once in each worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTER


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter's trigram, index of each word's first letter, text of each word).

    A word is a run of letters, lower-cased; a trigram is a letter with its neighbours in the word.
    """
    joined = "\n".join((t or "").lower() for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len((t or "").lower()) + 1 for t in texts])
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    padded = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    at = np.flatnonzero(letter)
    mixed = (padded[at] * np.uint64(0x9E3779B97F4A7C15) ^ padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
             ^ padded[at + 2] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    buckets = (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % BUCKETS
    first = np.flatnonzero(padded[at] == 0)
    return buckets, first, np.searchsorted(ends, at[first], side="right")


def _counts(batches):
    """Per task: (lang, bucket, n) of the trigrams of its training documents."""
    total: dict[str, np.ndarray] = {}
    for part, texts in text_batches(batches, ["text"], 1 << 20):
        langs = part.column("lang").to_pylist()
        for lang in set(langs):
            own = [t for t, x in zip(texts, langs) if x == lang]
            total[lang] = total.get(lang, 0) + np.bincount(trigrams(own)[0], minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())],
                                         names=["lang", "bucket", "n"])


def train(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", per_lang: int = TRAIN_DOCS,
          seed: int = 5) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability by bucket and language) from about ``per_lang`` documents of
    each language, chosen by a hash of the id.  Only the bounded table reaches the driver."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(lang).count().collect()
    if not sizes:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], per_lang / r[1])])
    u = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(u < share[F.col(lang)]).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = (chosen.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
            .toArrow().to_pydict())
    langs = sorted({str(r[0]) for r in sizes})
    table = np.zeros((BUCKETS, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    np.add.at(table, (np.array(rows["bucket"], int), np.array([place[x] for x in rows["lang"]], int)), np.array(rows["n"], float))
    smooth = table + 0.1
    return langs, np.log(smooth / smooth.sum(0))


def mixture(texts: list[str | None], logp: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions by text and language, number of words of each text).

    EM over words: a word belongs to one language, whose trigrams give its likelihood.  Then for
    each number k of languages the best k are fitted alone, and the k with the highest likelihood
    less k/2 * log(words) is kept (the Bayesian criterion); languages outside it get 0.
    """
    n_docs, n_langs = len(texts), logp.shape[1]
    buckets, first, doc = trigrams(texts)
    words = np.bincount(doc, minlength=n_docs)
    if not len(first) or not n_langs:
        return np.zeros((n_docs, n_langs)), words
    score = np.add.reduceat(logp[buckets], first, axis=0)
    like = np.exp(np.maximum(score - score.max(1, keepdims=True), -FLOOR))
    has = np.flatnonzero(words)
    edge = np.concatenate([[0], np.cumsum(words[has])[:-1]])
    row = np.repeat(np.arange(len(has)), words[has])
    n = words[has][:, None]

    def fit(share, rounds):
        for _ in range(rounds):
            part = share[row] * like
            part /= part.sum(1, keepdims=True)
            share = np.add.reduceat(part, edge, axis=0) / n
        return share

    full = fit(np.full((len(has), n_langs), 1 / n_langs), steps)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best, best_value = full, np.full(len(has), -np.inf)
    for k in range(1, n_langs + 1):
        share = np.where(rank < k, np.maximum(full, 1e-9), 0)
        share = fit(share / share.sum(1, keepdims=True), 3 if k > 1 else 0)
        value = np.add.reduceat(np.log((share[row] * like).sum(1)), edge) - k / 2 * np.log(n[:, 0] + 1)
        better = value > best_value + 1e-9
        best, best_value = np.where(better[:, None], share, best), np.where(better, value, best_value)
    out = np.zeros((n_docs, n_langs))
    out[has] = best
    return out, words


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text: str = "text",
             steps: int = STEPS) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (its share of the words), shares (map of
    every language in the chosen set).

    A map over rows.  Null text or text without a letter, or a model without languages: ``und``,
    score 0 and no shares.  Ties go to the first language in alphabetical order.  Whole texts are
    read; a piece of about a million characters, or one longer text, is held at a time.  Repeated
    rows and null ids are kept as they are; columns but the id and the text are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model[0], model[1].astype(np.float32)))     # languages x buckets
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        langs, logp = shared.value
        for part, texts in text_batches(batches, ["text"], 1 << 20):
            share, words = mixture(texts, logp, steps)
            top = share.argmax(1) if langs else np.zeros(len(texts), int)
            found = (words > 0) & bool(langs)
            names = [langs[i] if ok else UNKNOWN for i, ok in zip(top, found)]
            score = np.where(found, share[np.arange(len(texts)), top] if langs else 0.0, 0.0)
            maps = [[(langs[j], float(s[j])) for j in np.flatnonzero(s)] for s in share]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0), pa.float64()),
                                              pa.array(maps, pa.map_(pa.string(), pa.float64()))], names=["id", "lang_pred", "score", "shares"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {id_type}, lang_pred string, score double, shares map<string,double>")
    return out.withColumnRenamed("id", id_col)


def query(documents: DataFrame) -> DataFrame:
    """Learn outside fold 0 of five, predict every document."""
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = train(documents.where(~held))
    found = identify(documents, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "shares")
