"""Operator 4: text quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, labelled_sample, small_batches, spare, text_batches

FORM_TERMS = 1 << 12
WORD_TERMS = 1 << 12
TERMS = FORM_TERMS + WORD_TERMS
#: About so many labelled documents are the neighbours: TRAIN_ROWS x RANK floats are broadcast.
TRAIN_ROWS = 4000
RANK = 64
NEIGHBOURS = 25
THRESHOLD = 0.3

_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of a code point: 0 space, 1 small letter, 2 capital, 3 digit, other signs themselves."""
    global _CLASS
    if _CLASS is None:
        table = np.arange(0x110000, dtype=np.uint32) + 16
        for c in range(0x30000):
            x = chr(c)
            if x == "\n":
                table[c] = 4
            elif x.isspace():
                table[c] = 0
            elif x.isupper():
                table[c] = 2
            elif x.isalpha():
                table[c] = 1
            elif x.isdigit():
                table[c] = 3
        _CLASS = table
    return _CLASS


def _hash(values: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    h = (values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % buckets


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(terms, log-scaled counts) of a text.

    Form terms are n-grams of two to four runs of character classes, so that marks, capitals,
    tables and lists show, and whether a word repeats the one before.  Word terms are hashed words.
    """
    if not text or text.isspace():
        return np.zeros(0, np.int64), np.zeros(0)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kind = _classes()[codes].astype(np.uint64)
    runs = kind[np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))]
    terms, gram = [], runs
    for n in range(2, 5):
        if len(runs) < n:
            break
        gram = gram[:-1] * np.uint64(0x100000001B3) + runs[n - 1:]
        terms.append(_hash(gram, n, FORM_TERMS - 2))
    space = (kind == 0) | (kind == 4)
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(first):
        lower = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        codes = lower if len(lower) == len(codes) else codes
        begin = np.zeros(len(codes), np.int64)
        begin[first] = first
        place = (np.arange(len(codes)) - np.maximum.accumulate(begin)).astype(np.uint64)
        spread = np.uint64(0x9E3779B97F4A7C15) * (place * np.uint64(2) + np.uint64(1))
        weight = np.where(space, np.uint64(0), (codes.astype(np.uint64) + np.uint64(1)) * spread)
        words = np.add.reduceat(weight, first)
        same = np.count_nonzero(words[1:] == words[:-1])
        terms.append(np.repeat([FORM_TERMS - 2, FORM_TERMS - 1], [same, max(len(words) - 1 - same, 0)]))
        terms.append(FORM_TERMS + _hash(words, 7, WORD_TERMS))
    if not terms:
        return np.zeros(0, np.int64), np.zeros(0)
    count = np.bincount(np.concatenate(terms), minlength=TERMS)
    at = np.flatnonzero(count)
    return at, np.log1p(count[at])


class LatentNeighbours:
    """Term weights, the projection and the labelled vectors; all bound by the parameters above."""

    def __init__(self, samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK):
        self.labels = np.asarray(labels, np.float64)
        self.base = float(self.labels.mean()) if len(self.labels) else 0.5
        self.vectors = np.zeros((0, 0), np.float32)
        if not len(samples):
            return
        seen = np.zeros(TERMS)
        for at, _ in samples:
            seen[at] += 1
        self.idf = np.log((1 + len(samples)) / (1 + seen)) + 0.05
        self.axes = _top_axes(lambda: self._blocks(samples), min(rank, len(samples), TERMS))
        self.vectors = np.concatenate([_unit(rows @ self.axes) for rows in self._blocks(samples)])

    def _blocks(self, samples: list[tuple[np.ndarray, np.ndarray]], size: int = 256):
        """The weighted term rows, so many at a time."""
        for start in range(0, len(samples), size):
            some = samples[start:start + size]
            rows = np.zeros((len(some), TERMS), np.float32)
            for row, x in zip(rows, some):
                self._weigh(row, x)
            yield rows

    def _weigh(self, row: np.ndarray, sample: tuple[np.ndarray, np.ndarray]) -> None:
        at, value = sample
        value = value * self.idf[at]
        for half in (at < FORM_TERMS, at >= FORM_TERMS):         # form weighs as much as wording
            norm = np.sqrt((value[half] ** 2).sum())
            if norm > 0:
                row[at[half]] = value[half] / norm * (1.0 if half[0] else 0.5)

    def score(self, texts: list[str | None], neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighted by its cosine."""
        out = np.full(len(texts), self.base)
        if not len(self.vectors):
            return out
        for start in range(0, len(texts), block):
            some = texts[start:start + block]
            rows = np.zeros((len(some), TERMS), np.float32)
            for i, t in enumerate(some):
                self._weigh(rows[i], term_counts(t))
            cosine = _unit(rows @ self.axes) @ self.vectors.T
            k = min(neighbours, cosine.shape[1])
            at = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, at, axis=1), 0).astype(np.float64) ** 4
            total = weight.sum(1)
            vote = (weight * self.labels[at]).sum(1) / np.maximum(total, 1e-12)
            out[start:start + block] = np.where(total > 1e-12, vote, self.base)
        return np.clip(out, 0, 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _top_axes(blocks, rank: int) -> np.ndarray:
    """Leading right singular vectors of the stacked blocks by randomised subspace iteration."""
    basis = np.random.default_rng(0).standard_normal((TERMS, rank + 16)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(sum(rows.T @ (rows @ basis) for rows in blocks()))[0]
    _, _, v = np.linalg.svd(np.concatenate([rows @ basis for rows in blocks()]), full_matrices=False)
    return np.ascontiguousarray((basis @ v.T)[:, :rank])


def _sample_terms(batches):
    for part, texts in text_batches(batches, ["text"]):
        terms = [term_counts(t) for t in texts]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([t[0] for t in terms], pa.list_(pa.int64())),
                                          pa.array([t[1] for t in terms], pa.list_(pa.float64()))], names=["doc_id", "y", "terms", "counts"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> LatentNeighbours:
    """Learn from about ``rows`` labelled documents outside the held-out fold (see
    ``labelled_sample``); their term counts are gathered, nothing else."""
    id_type = dict(docs.dtypes)["doc_id"]
    got = (labelled_sample(docs, labels, label, mod, held, rows).mapInArrow(_sample_terms, f"doc_id {id_type}, y double, terms array<long>, counts array<double>")
           .orderBy("doc_id").toArrow())
    terms, counts = got["terms"].combine_chunks(), got["counts"].combine_chunks()
    at, term, count = terms.offsets.to_numpy(), terms.values.to_numpy(), counts.values.to_numpy()
    samples = [(term[a:b], count[a:b]) for a, b in zip(at[:-1], at[1:])]
    model = LatentNeighbours(samples, got["y"].to_numpy())
    del got, terms, counts, term, count, samples
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: LatentNeighbours, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (1 if score >= threshold).

    A map over rows: exact cosines of every text with all labelled vectors, in blocks.  Null,
    empty and blank texts have no vector and score the mean label; so does everything if nothing
    is labelled (then 0.5).  Whole texts are read.  Equal cosines at the last neighbour: any.
    Repeated rows score alike.  Other columns pass through; score and predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    return docs.withColumn("score", scorer(docs, model)(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scorer(docs: DataFrame, model: LatentNeighbours):
    """The score as a function of a text column."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd
        return pd.Series(shared.value.score([t if isinstance(t, str) else None for t in texts]))

    return scored


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Pipeline form: ``docs`` without the rows predicted 0; same columns, of whatever names."""
    name = spare(docs, "_q_score")
    scored = docs.withColumn(name, scorer(docs, fit(docs, labels, **options))(F.col("text")))
    return scored.where(F.col(name) >= threshold).drop(name)


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
