import random

import numpy as np
import pytest

from quarry.llm import ngram_join as J


def brute(rows, words, share):
    sets = {i: set(J.shingle_set(t, words).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and share[1] * both >= share[0] * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n, hot):
    """Random texts of 1 to 80 words, ``hot`` near copies of one, chains of small edits, copies."""
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(400))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        kind = r.random()
        if i < hot:
            t = list(base)
            for _ in range(r.randrange(4)):
                t[r.randrange(len(t))] = word()
        elif kind < 0.5 and rows:
            t = r.choice(rows)[1].split(" ")
            if kind < 0.35:
                t[r.randrange(len(t))] = word()
            if kind < 0.1:
                t += [word()]
        else:
            t = [word() for _ in range(r.randrange(1, 80))]
        rows.append((i * 7 % 100_003, " ".join(t)))
    return rows


@pytest.mark.parametrize("words, share, hot", [(3, (90, 100), 120), (5, (80, 100), 60), (2, (60, 100), 20)])
def test_equals_brute_force(docs, words, share, hot):
    rows = corpus(hot, 300, hot)
    got = J.jaccard_components(docs(rows), words=words, share=share, tile_rows=16).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, words, share)


def test_shingles_follow_ascii_rules():
    assert len(J.shingle_set("A b\x0bC d", 3)) == 1                     # no-break space is no separator
    assert (J.shingle_set("A B C D") == J.shingle_set("a b\tc\n d")).all()
    assert (J.shingle_set("É b c") != J.shingle_set("é b c")).any()          # only A-Z are lower-cased
    assert len(J.shingle_set("one two")) == 1 and not len(J.shingle_set(" \n"))
    assert len(J.shingle_set("a b c a b c a b c")) == 3


@pytest.mark.parametrize("share", [(90, 100), (80, 100), (1, 2)])
def test_linked_sets_share_a_bucket(share):
    """The guarantee of the tiles, for pairs that just make the threshold, at every size."""
    r = np.random.default_rng(1)
    for size in [*range(1, 60), 100, 333, 1000]:
        for other in {size, max(1, -(-size * share[0] // share[1]))}:
            least = -(-share[0] * (size + other) // (share[0] + share[1]))
            pool = np.unique(r.integers(0, 1 << 63, 3 * size + 10, dtype=np.uint64))
            r.shuffle(pool)
            a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[:least], pool[size:size + other - least]]))
            if least <= min(size, other):
                assert set(J.bucket_keys(a, share).tolist()) & set(J.bucket_keys(b, share).tolist())


def test_bitmaps_bound_the_overlap():
    r = np.random.default_rng(2)
    for n in (1, 20, 700):
        pool = np.unique(r.integers(0, 1 << 63, 2 * n + 20, dtype=np.uint64))
        for cut in range(0, n + 1, max(1, n // 10)):
            a, b = np.sort(pool[:n]), np.sort(pool[cut:n + cut])
            both = len(np.intersect1d(a, b))
            mask = next(J.may_link([J.bitmap(a)], np.array([n]), [J.bitmap(b)], np.array([n])))[1]
            assert mask[0] or 100 * both < 90 * (2 * n - both)


def test_odd_rows(odd_docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(odd_docs.selectExpr("*", "1 AS key", "2 AS n", "3 AS root")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (3, 5), 6: (3, 5), 7: (1, 7), None: (3, None)}
    assert J.jaccard_components(odd_docs.limit(0)).count() == 0


def test_keep_first_keeps_one_of_each_group(docs):
    rows = corpus(5, 200, 40)
    kept = J.keep_first(docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source"]
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute(rows, 5, (80, 100)).items() if i == c}
