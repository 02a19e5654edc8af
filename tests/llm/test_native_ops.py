"""Line dedup, decontamination and mixing: against brute force and DuckDB."""

import random
import re

import pytest
from oracle import compare, duck

from quarry.llm import decontam, line_dedup, mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_oracle(spark, name):
    ok, said = compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE_SQL[name])
    assert ok, said


def test_site_lines(docs):
    rows = [(i, f"menu\nstory {i}\n menu \n\n" + ("foot" if i < 6 else "tail"), "en", "a") for i in range(20)]
    rows += [(100 + i, "menu\nother", "en", None) for i in range(4)]            # under five pages
    got = {r.doc_id: r for r in line_dedup.drop_site_lines(docs(rows), ratio=0.5).collect()}
    assert got[0].text == "story 0\n\nfoot" and (got[0].n_lines, got[0].n_dropped) == (5, 2)
    assert got[7].text == "story 7\n" and got[7].n_dropped == 3                 # tail: 14 of 20 pages
    assert got[100].text == "menu\nother" and got[100].n_dropped == 0


def test_site_lines_default_ratio(docs):
    """A licence line on 8 of 500 pages goes, one on 5 of them stays."""
    rows = [(i, f"story {i}" + ("\nlicence" if i < 8 else "\nrare" if i < 13 else ""), "en", "a") for i in range(500)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_site_lines(docs(rows)).collect()}
    assert got[0] == ("story 0", 1) and got[8] == ("story 8\nrare", 0) and sum(n for _, n in got.values()) == 8


def test_site_lines_odd_rows(odd_docs):
    clash = odd_docs.selectExpr("*", "1 AS n_lines", "2 AS pages", "3 AS h", "'k' AS k")
    got = line_dedup.drop_site_lines(clash, ratio=0.3, min_pages=3)
    rows = got.collect()
    assert len(rows) == 9 and {r.pages for r in rows} == {2}
    assert [r.text for r in rows if r.doc_id in (5, 6)] == [""] * 3 and [(r.text, r.n_lines) for r in rows if r.doc_id == 1] == [(None, 0)]
    assert line_dedup.drop_site_lines(clash.limit(0)).count() == 0


def tokens(t):
    return [x for x in re.split(r"[^\w]+|_+", (t or "").lower()) if x]


def brute(docs, items):
    """Every alignment of every document with every item."""
    found = {}
    for d, text in docs:
        a = tokens(text)
        for k, item in items:
            b = tokens(item)
            size = min(13, len(b))
            best = 0
            for shift in range(-len(b), len(a)):
                same = [0 <= shift + p < len(a) and a[shift + p] == x for p, x in enumerate(b)]
                best = max([best, *(sum(same[s:s + size]) for s in range(len(b) - size + 1))])
            if len(b) >= 11 and best >= -(-8 * size // 10):
                found[d, k] = best
    return found


def test_decontamination_equals_brute_force(spark, docs):
    """Whole items, parts, and items with substituted words, a passage in a third of the documents."""
    r = random.Random(3)
    word = lambda: "w" + str(r.randrange(300))
    items = [(k, " ".join(word() for _ in range(r.randrange(8, 40)))) for k in range(12)]
    rows = []
    for i in range(90):
        body = [word() for _ in range(r.randrange(0, 120))]
        if i % 3 == 0 or i % 5 == 0:
            item = (items[0] if i % 3 == 0 else items[i % 12])[1].split()
            if i % 2 and len(item) > 16:
                for p in range(4, len(item), 14):
                    item[p] = word()
            if i % 4 == 1:
                item = item[len(item) // 3:]
            at = r.randrange(len(body) + 1)
            body[at:at] = item
        rows.append((i, ", ".join(body).upper() if i % 7 == 0 else " ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(g.doc_id, g.item_id): g.n_match for g in decontam.find_contaminated(docs(rows), bench).collect()}
    want = brute(rows, items)
    assert len(want) > 30 and not set(got) - set(want)
    sure = {k for k in want if want[k] == min(13, len(items[k[1]][1].split()))}          # a run long enough for a certain seed
    assert sure <= set(got) and len(got) >= 0.95 * len(want)
    assert all(got[k] == want[k] for k in got)


def every_match(docs, items):
    """As brute, but for items of every length."""
    found = {}
    for d, text in docs:
        a = tokens(text)
        for k, item in items:
            b = tokens(item)
            size = min(13, len(b))
            best = 0
            for shift in range(-len(b), len(a)):
                same = [0 <= shift + p < len(a) and a[shift + p] == x for p, x in enumerate(b)]
                best = max([best, *(sum(same[s:s + size]) for s in range(len(b) - size + 1))])
            if best >= -(-8 * size // 10):
                found[d, k] = best
    return found


def test_masks_leave_no_substitution_out():
    for n in range(1, 14):
        miss = n - -(-8 * n // 10)
        assert decontam.covers(decontam.masks_for(n, miss), n, miss), n
    assert decontam.masks_for(50, 25) == ("1",)


def test_decontamination_finds_every_substitution_and_short_items(spark, docs):
    """Passages of 1 to 18 tokens with up to three substitutions, at all offsets, whole or cut at an end of the document."""
    r = random.Random(7)
    items = [(n, " ".join(f"i{n}x{p}" for p in range(n))) for n in (*range(1, 19), 30)]
    rows = []
    for n, text in items:
        for k in range(0, 4):
            for _ in range(12):
                part = text.split()
                for p in r.sample(range(n), min(k, n)):
                    part[p] = "other"
                lead = [f"d{r.randrange(400)}" for _ in range(r.randrange(9))]
                cut = r.choice((0, 0, 1, 2))
                body = part[cut:] if cut else lead + part
                rows.append((len(rows), " ".join(body + ["end"] * r.randrange(3))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(g.doc_id, g.item_id): g.n_match for g in decontam.find_contaminated(docs(rows), bench).collect()}
    want = every_match(rows, items)
    assert {k for _, k in want} == {n for n, _ in items} and got == want


def test_decontamination_without_broadcast(spark, docs, monkeypatch):
    item = " ".join(f"t{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    rows = docs([(1, f"before {item} after"), (2, "nothing of it"), (None, item), (1, f"before {item} after")])
    for limit in (decontam.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
        got = {(g.doc_id, g.item_id) for g in decontam.find_contaminated(rows, bench).collect()}
        assert got == {(1, 1), (1, None), (None, 1), (None, None)}
    assert [r.doc_id for r in decontam.decontaminate(rows, bench).collect()] == [2]


def test_decontamination_odd_rows(spark, odd_docs):
    bench = spark.createDataFrame([(1, "word " * 30)], "item_id long, text string")
    clash = odd_docs.selectExpr("*", "1 AS item", "2 AS pos", "3 AS h", "'x' AS hit")
    assert {r.doc_id for r in decontam.find_contaminated(clash, bench).collect()} == {4}
    assert decontam.decontaminate(clash, bench).count() == 8
    assert decontam.decontaminate(clash, bench.limit(0)).count() == 9
    assert decontam.find_contaminated(clash.limit(0), bench).count() == 0


def test_raking_meets_the_marginals(spark):
    cells = spark.createDataFrame([("a", "x", 100.0), ("a", "y", 10.0), ("b", "x", 5.0), ("b", "y", 85.0)], "p string, q string, t double")
    w = mixing.rake(cells, {"p": {"a": 0.5, "b": 0.5}, "q": {"x": 0.3, "y": 0.7}}, rounds=40).toPandas()
    share = lambda c: (w.groupby(c).w.sum() / w.w.sum()).to_dict()
    assert share("q") == pytest.approx({"x": 0.3, "y": 0.7}) and share("p") == pytest.approx({"a": 0.5, "b": 0.5}, abs=1e-3)
    odds = w.set_index(["p", "q"]).w                                        # raking keeps the odds ratio
    assert odds["a", "x"] * odds["b", "y"] / (odds["a", "y"] * odds["b", "x"]) == pytest.approx(100 * 85 / (10 * 5))


def test_mixing_expectation(docs):
    rows = [(i, "one two three four", ("en", "de")[i % 4 == 0], f"s{i % 3}") for i in range(6000)]
    df = mixing.with_tokens_and_topic(docs(rows))
    drawn = mixing.mix_to_targets(df, {"lang": {"en": 0.5, "de": 0.5}}, keep=0.3).toPandas()
    assert len(drawn) == pytest.approx(1800, rel=0.1) and (drawn.lang == "de").mean() == pytest.approx(0.5, abs=0.04)
    assert mixing.mix_to_targets(df, {"lang": {"de": 1.0}}, keep=0.5).where("lang = 'en'").count() == 0


def test_mixing_odd_rows(odd_docs):
    df = mixing.with_tokens_and_topic(odd_docs.selectExpr("*", "1 AS p", "2 AS t", "3 AS w", "4 AS g"))
    got = mixing.mix_to_targets(df, keep=1.0)
    assert got.columns.count("p") == 1 and {"t", "w", "g"} <= set(got.columns)
    assert got.where("tokens > 0").count() == 6
    assert mixing.mix_to_targets(df.limit(0)).count() == 0


def test_clashing_names_and_ties(spark, docs):
    rows = docs([(1, "a b c d e f g h"), (2, "nothing of it")]).selectExpr("*", "5 AS _q_bad", "6 AS _q_score")
    items = spark.createDataFrame([(7, "a b c d e f g h"), (7, "a b c d e f"), (7, "a b c d e f")], "item_id int, text string")
    kept = decontam.decontaminate(rows, items)
    assert kept.columns == rows.columns and [(r.doc_id, r["_q_bad"]) for r in kept.collect()] == [(2, 5)]
    found = decontam.find_contaminated(rows, items).collect()
    assert [(r.doc_id, r.item_id, r.n_match, r.n_window, r.item_tokens) for r in found] == [(1, 7, 8, 8, 8)]
