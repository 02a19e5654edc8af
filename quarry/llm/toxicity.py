"""Operator 2: toxicity by a classifier that is regularised with counterfactual sentences.

A logistic model over the words and word beginnings of a text.  Labelled sentences that name a group are
written again with the other groups' names, and those that name none with each name of a set
put into the same place; a change of score between the versions is penalised, so naming one group
rather than another weighs nothing by itself.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, labelled_sample, text_batches

#: About so many labelled documents are learned from, with at most so many features.
TRAIN_ROWS = 20_000
FEATURES = 4000
MIN_DOCS = 3
MIN_Z = 4.0
PENALTY = 1.0
RIDGE = 1e-5
THRESHOLD = 0.3

#: Terms that swap with one another, for English, German, French and Spanish (fixed values); the first of a set is the neutral one.
IDENTITY_TERMS = (
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "women", "men",
     "gays", "lesbians", "blacks", "whites", "asians", "latinos", "arabs"),
    ("person", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "woman", "man"),
    ("human", "jewish", "islamic", "black", "white", "asian", "latino", "arab", "african", "european", "gay", "lesbian",
     "transgender", "disabled", "female", "male"),
    ("leute", "muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "einwanderer", "flüchtlinge", "frauen", "männer",
     "schwule", "lesben", "schwarze", "weiße", "asiaten", "araber"),
    ("gens", "musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "immigrés", "réfugiés", "femmes", "hommes",
     "gays", "lesbiennes", "noirs", "blancs", "asiatiques", "arabes"),
    ("gente", "musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "inmigrantes", "refugiados", "mujeres", "hombres",
     "gais", "lesbianas", "negros", "blancos", "asiáticos", "árabes"),
)

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features(words: set[str]) -> set[str]:
    """Words, and their first four and five letters, so that unseen forms of a known word count."""
    out = {"w:" + w for w in words}
    out.update("p:" + w[:4] for w in words if len(w) > 4)
    out.update("p:" + w[:5] for w in words if len(w) > 5)
    return out


def text_features(text: str | None) -> set[str]:
    return features(set(_WORD.findall((text or "").lower())))


def swapped(text: str | None, groups=IDENTITY_TERMS) -> list[tuple[set[str], set[str]]]:
    """(features of a sentence, features with one identity term swapped), one pair for each other
    term of its set, for every sentence that holds one."""
    low = (text or "").lower()
    sets = [(set(g), g) for g in groups]
    pairs: list[tuple[set[str], set[str]]] = []
    if not any(t in low for g in groups for t in g):
        return []
    for sentence in _SENTENCE.split(low):
        words = set(_WORD.findall(sentence))
        for members, terms in sets:
            for old in sorted(words & members):
                pairs += [(features(words), features(words - {old} | {new})) for new in terms if new not in words]
    return pairs


def mentions(text: str | None, groups=IDENTITY_TERMS) -> list[tuple[set[str], tuple[str, ...]]]:
    """Labelled sentences made to name groups: each sentence that names none gets one set of terms,
    chosen by a checksum of its words; every term of it takes the same place.  Per sentence its words and the
    set, the neutral term first."""
    every = {t for g in groups for t in g}
    out = []
    for sentence in _SENTENCE.split((text or "").lower()):
        words = set(_WORD.findall(sentence))
        if words and groups and not words & every:
            terms = groups[zlib.crc32(" ".join(sorted(words)).encode("utf-8", "surrogatepass")) % len(groups)]
            out.append((words, terms))
    return out


def changes(text: str | None, groups=IDENTITY_TERMS) -> set[tuple[frozenset[str], frozenset[str]]]:
    """What the versions of a text's sentences differ in: (features lost, features won), of swapped
    terms and of terms put in.  The score change of a pair depends on nothing else."""
    found = {(frozenset(a - b), frozenset(b - a)) for a, b in swapped(text, groups)}
    for words, terms in mentions(text, groups):
        every = _set_features(terms)
        near = any(len(w) > 4 and "p:" + w[:4] in every for w in words)       # else no term shares a feature with the sentence
        found |= _term_changes(terms, frozenset(features(words) & every) if near else frozenset())
    return found


@lru_cache(maxsize=1 << 12)
def _term_features(term: str) -> frozenset[str]:
    return frozenset(features({term}))


@lru_cache(maxsize=1 << 12)
def _set_features(terms: tuple[str, ...]) -> frozenset[str]:
    return frozenset().union(*map(_term_features, terms))


@lru_cache(maxsize=1 << 12)
def _term_changes(terms: tuple[str, ...], held: frozenset[str]) -> frozenset:
    """The changes from the first term to each other one in a sentence that holds some of their features."""
    first = _term_features(terms[0]) - held
    return frozenset((first - _term_features(t), _term_features(t) - held - first) for t in terms[1:])


def _explode(batches):
    for part, texts in text_batches(batches, ["text"]):
        ys = part.column("y").to_pylist()
        names, pos = [], []
        for t, y in zip(texts, ys):
            f = text_features(t)
            names += f
            pos += [y] * len(f)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pos, pa.float64())], names=["feature", "y"])


class Toxicity:
    """A weight for each feature, and a bias; the number of distinct changes it was penalised for."""

    def __init__(self, weights: dict[str, float], bias: float, pairs: int = 0):
        self.weights, self.bias, self.pairs = weights, bias, pairs

    def score(self, text: str | None) -> float:
        return self.score_features(text_features(text))

    def score_features(self, found: set[str]) -> float:
        w = self.weights
        value = self.bias + sum(w[f] for f in found if f in w)
        return float(1 / (1 + np.exp(-np.clip(value, -40, 40))))


class Loss:
    """Logistic loss + ridge + penalty * mean squared score change over the pairs, and its gradient.

    rows: the features of each document; pairs: features (lost, won) of each change of a sentence.
    """

    def __init__(self, rows, y: np.ndarray, pairs, n: int, penalty: float, ridge: float):
        self.y, self.n, self.pairs, self.penalty, self.ridge = y, n, len(pairs), penalty, ridge
        self.doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.feat = np.array([f for r in rows for f in r], np.int64)
        self.pair = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
        self.pfeat = np.array([f for a, b in pairs for f in (*a, *b)], np.int64)
        self.sign = np.array([s for a, b in pairs for s in (*[-1.0] * len(a), *[1.0] * len(b))])

    def __call__(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """(loss, gradient of the weights, gradient of the bias)."""
        z = bias + np.bincount(self.doc, w[self.feat], minlength=len(self.y))
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - self.y) / len(self.y)
        loss = float(np.mean(np.logaddexp(0, z) - self.y * z) + self.ridge / 2 * (w @ w))
        grad = np.bincount(self.feat, err[self.doc], minlength=self.n) + self.ridge * w
        if self.pairs:
            change = np.bincount(self.pair, w[self.pfeat] * self.sign, minlength=self.pairs)
            loss += self.penalty * float(np.mean(change ** 2))
            grad += 2 * self.penalty / self.pairs * np.bincount(self.pfeat, change[self.pair] * self.sign, minlength=self.n)
        return loss, grad, float(err.sum())


def train_weights(rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], n: int, penalty: float = PENALTY,
                  ridge: float = RIDGE, steps: int = 1000, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of least ``Loss``, by Adam."""
    loss = Loss(rows, y, pairs, n, penalty, ridge)
    w, bias = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        _, grad, by_bias = loss(w, bias)
        g = np.append(grad, by_bias)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, held: int = 2, rows: int = TRAIN_ROWS,
        penalty: float = PENALTY, groups=IDENTITY_TERMS) -> Toxicity:
    """Learn from about ``rows`` labelled documents outside the held-out fold (``labelled_sample``).

    Features are the ``FEATURES`` terms most over- or under-represented in label 1, and all
    identity terms.  What reaches the driver: that list, of each sampled document the numbers
    of its listed features, and the distinct changes between versions of its sentences.
    """
    sample = labelled_sample(docs, labels, label, mod, held, rows).cache()
    total, positive = sample.agg(F.count("*"), F.sum("y")).first()
    if not total:
        return Toxicity({}, 0.0)
    rate = positive / total
    if rate in (0.0, 1.0):
        return Toxicity({}, 4.0 if rate else -4.0)
    seen = sample.mapInArrow(_explode, "feature string, y double").groupBy("feature").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    z = (F.col("pos") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    top = seen.where(F.col("n") >= MIN_DOCS).withColumn("z", F.abs(z)).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(FEATURES)
    names = sorted({r[0] for r in top.select("feature").collect()} | set().union(*(features(set(g)) for g in groups)))
    place = {f: i for i, f in enumerate(names)}

    def indexed(batches):
        own = lambda fs: sorted(place[f] for f in fs if f in place)
        for part, texts in text_batches(batches, ["text"]):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.string()), part.column("y"), pa.array([own(text_features(t)) for t in texts], pa.list_(pa.int32()))],
                names=["id", "y", "found"])

    def changed(batches):
        own = lambda fs: sorted(place[f] for f in fs if f in place)
        seen = set()
        for _, texts in text_batches(batches, ["text"]):
            seen |= {(tuple(own(a)), tuple(own(b))) for t in texts for a, b in changes(t, groups)}
        found = sorted(x for x in seen if x != ((), ()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1)], names=["a", "b"])

    got = sample.mapInArrow(indexed, "id string, y double, found array<int>").orderBy("id").toArrow()
    # a change is a pair of a term list's entries, less features that the sentence has anyhow: a bounded set
    pairs = [(r.a, r.b) for r in sample.mapInArrow(changed, "a array<int>, b array<int>").distinct().orderBy("a", "b").collect()]
    sample.unpersist()
    w, bias = train_weights(got["found"].to_pylist(), np.array(got["y"].to_pylist()), pairs, len(names), penalty)
    return Toxicity({f: float(x) for f, x in zip(names, w) if x}, bias, len(pairs))


def neutral_mentions(docs: DataFrame, labels: DataFrame, model: Toxicity, label: str = "toxic", threshold: float = THRESHOLD, groups=IDENTITY_TERMS) -> DataFrame:
    """One row: sentences made to name groups in documents labelled 0, and how many of these versions
    score at least ``threshold`` (false positives on neutral mentions)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches):
        n = bad = 0
        for _, texts in text_batches(batches, ["text"]):
            for version in (words | {term} for t in texts for words, terms in mentions(t, groups) for term in terms):
                n, bad = n + 1, bad + (shared.value.score_features(features(version)) >= threshold)
        yield pa.RecordBatch.from_pydict({"versions": [n], "false_positives": [bad]})

    clean = labels.where(F.col(label) == 0).select("doc_id").distinct()
    got = docs.select("doc_id", "text").join(clean, "doc_id", "left_semi").select("text").mapInArrow(judged, "versions long, false_positives long")
    return got.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in got.columns))


def score(docs: DataFrame, model: Toxicity, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (1 if score >= threshold).

    A map over rows; the model is at most ``FEATURES`` weights.  Null, empty and wordless texts
    have no features and score by the bias, low where most labels are 0.  Whole texts are read.
    Repeated rows score alike.  Other columns pass through; score and predicted are replaced.
    Labels of one kind give a constant score, no labels 0.5.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd
        return pd.Series([shared.value.score(t if isinstance(t, str) else None) for t in texts], dtype="float64")

    return docs.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
