"""The Merkle manifest against a plain recursive version."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quarry.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, digest string, g string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _up(nodes):
    """[(digest, siblings of each leaf below it)] -> root digest; fills the lists."""
    level = [(d, [(k, [], [])]) for k, d in enumerate(nodes)]
    while len(level) > 1:
        out = []
        for i in range(0, len(level), 2):
            run = level[i:i + 2]
            below = []
            for j, (_, held) in enumerate(run):
                for k, sib, fold in held:
                    others = [d for x, (d, _) in enumerate(run) if x != j]
                    below.append((k, sib + others, fold + [(j, others)]))
            out.append((_h(*(d for d, _ in run)), below))
        level = out
    return level[0]


def _brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [_up([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs]
    root, top = _up([t[0] for t in trees])
    top = {k: (s, f) for k, s, f in top}
    out = []
    for at, (g, (sub, held)) in enumerate(zip(langs, trees)):
        order = sorted(by[g], key=lambda x: x[:3])
        for k, sib, fold in held:
            r = order[k][3]
            d = order[k][2]
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                d = _leaf((*r[:3], r[3] + 1, r[4]))
            for j, others in fold + top[at][1]:
                d = _h(*(others + [d] if j else [d] + others))
            out.append((r[0], order[k][2], sub, root, _h(*(sib + top[at][0])), d, d == root))
    return sorted(out, key=str)


def _rows(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def test_odd_rows_equal_brute_force(spark, monkeypatch):
    r = random.Random(3)
    langs = [None, "", "en", "en", "en", "zé", "z", "=", "😀"]
    rows = [(r.choice([None, r.randint(-5, 30), r.randint(-1 << 63, (1 << 63) - 1), r.randint(0, 200_000)]), r.choice([None, "", "web"]), r.choice(langs),
             r.choice([None, 0, 9, 99]), r.choice([None, "", "é", "x" * 3000])) for _ in range(300)]
    rows += rows[:40] + [rows[0]] * 9 + [(7, "web", "en", 99, "t")] * 50
    got = _rows(merkle.manifest(_docs(spark, rows)))
    assert got == _brute(rows)
    assert {x[-1] for x in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_small_tables(spark, n):
    rows = [(i, "s", "en", 4, "text") for i in range(n)]
    assert _rows(merkle.manifest(_docs(spark, rows))) == _brute(rows)
    assert _rows(merkle.manifest(_docs(spark, [(i, "s", str(i), 4, None) for i in range(n)]))) == _brute([(i, "s", str(i), 4, None) for i in range(n)])


def test_empty_table(spark):
    assert merkle.manifest(_docs(spark, [])).collect() == []


def test_several_slot_arrays(spark, monkeypatch):
    """One group holds most rows and needs two floors of arrays; another has a short last array."""
    rows = [(i * 37 - 50_000, "s", "en" if i % 10 else "de", i, "t") for i in range(10_000)]
    assert _rows(merkle.manifest(_docs(spark, rows))) == _brute(rows)


def test_blocks_round_trip():
    for ids in (np.array([0, 5, 65535]), np.arange(0, 65536, 3), np.arange(65536)):
        counts = np.ones(len(ids), np.int64)
        held, c = merkle._packed(ids, counts)
        assert c is None and len(held) <= 8192
        back, ones = merkle._unpacked(held, c)
        assert (back == ids).all() and (ones == 1).all()
        held, c = merkle._packed(ids, counts + 1)
        assert (merkle._unpacked(held, c)[1] == 2).all()


def test_query_on_documents(spark):
    from quarry.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _rows(QUERIES["op12_merkle_manifest"](spark, sf)) == _brute(rows)
