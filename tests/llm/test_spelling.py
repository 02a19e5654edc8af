"""Spelling variants against brute force over all pairs and all paths."""

import random
import re
import zlib
from collections import Counter

import pytest

from quarry.llm import spelling


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _brute(words, ratio=2):
    out = {}
    for w, n in words.items():
        near = sorted((v for v in words if _near(w, v)), key=lambda v: (-words[v], v))
        form = near[0] if near and words[near[0]] >= ratio * n else None
        out[w] = (form, n, len(near), form and words[form])
    rows = set()
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, m))
    return rows


def _count(rows, noise=97, length=5, least=3):
    low = str.maketrans(spelling.UPPER, spelling.LOWER)
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= length:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least}


def _rows(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


@pytest.mark.parametrize("letters,top", [("ab", 7), ("aéß", 6)])
def test_groups_equal_brute_force(spark, letters, top):
    r = random.Random(len(letters))
    words = {"".join(r.choice(letters) for _ in range(r.randint(1, top))): r.choice([1, 2, 3, 4, 8, 9, 40]) for _ in range(260)}
    got = _rows(spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert len(got) == len(set(got)) and set(got) == _brute(words)


@pytest.mark.parametrize("noise", [1, 3, 97])
def test_word_counts_equal_brute_force(spark, noise):
    r = random.Random(noise)
    vocab = ["".join(r.choice("abcdéÿ×ABZÀ") for _ in range(r.randint(2, 9))) for _ in range(40)]
    rows = [(i // 2 if i % 9 else None, " ,".join(r.choices(vocab, k=r.randint(0, 60)))) for i in range(60)] + [(7, None), (8, ""), (9, "1234 _"), (10, "abcde" * 9000)]
    docs = spark.createDataFrame([(*x, "w") for x in rows], "doc_id long, text string, word string")
    got = {x.word: x.n for x in spelling.word_counts(docs, noise=noise).collect()}
    assert got == _count(rows, noise)


def test_odd_words(spark):
    make = lambda rows: spark.createDataFrame(rows, "word string, n long, form string")
    assert _rows(spelling.variant_groups(make([]))) == []
    got = _rows(spelling.variant_groups(make([(None, 5, "x"), ("", 9, None), ("a", 2, "y"), ("a", 2, "y"), ("b", 1, "y"), ("x" * 5000, 1, "z"), ("x" * 4999 + "y", 2, "z")])))
    assert set(got) == {("", None, "", 9, 0, None), ("a", None, "a", 4, 1, None), ("b", "a", "a", 1, 1, 4),
                        ("x" * 5000, "x" * 4999 + "y", "x" * 4999 + "y", 1, 1, 2), ("x" * 4999 + "y", None, "x" * 4999 + "y", 2, 1, None)}
    with pytest.raises(ValueError):
        spelling.variant_groups(make([]), ratio=1)


def test_ties_and_long_paths(spark):
    words = {"a" * (5 + i): 3 * 2 ** i for i in range(12)} | {"aaaab": 6, "aaaac": 6, "aaaad": 3}
    got = _rows(spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert set(got) == _brute(words)


def test_query_on_documents(spark):
    from quarry.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = _rows(QUERIES["op11_spelling_variants"](spark, sf))
    words = _count(rows)
    by_near = {}
    for w in words:                              # brute force by deletion neighbourhoods, checked by _near
        for i in range(len(w)):
            by_near.setdefault(w[:i] + w[i + 1:], set()).add(w)
        by_near.setdefault(w, set()).add(w)
    near = {w: {v for k in [w, *(w[:i] + w[i + 1:] for i in range(len(w)))] for v in by_near.get(k, ()) if _near(w, v)} for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w
    assert len(got) == len(words) > 500
    assert set(got) == {(w, form[w], root(w), n, len(near[w]), form[w] and words[form[w]]) for w, n in words.items()}
