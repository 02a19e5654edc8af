import binascii

import numpy as np
import pytest

from quarry.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def crc(i, mod):
    return binascii.crc32(str(i).encode()) % mod


def test_toxicity_held_out(spark):
    got = queries.op2_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == 1000 and all(got.held_out == [crc(i, 4) == 2 for i in got.doc_id])
    assert ((got.predicted == 1) == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    both = got.merge(labels, on="doc_id")
    assert (both.predicted == both.toxic)[both.held_out].mean() >= 0.9
    assert both.predicted[(both.toxic == 0) & both.held_out].mean() <= 0.02


def test_counterfactual_penalty_takes_the_weight_off_group_names():
    """Group names only stand in toxic training texts; swapped sentences make them weigh alike."""
    place = {"insult": 0, "groupa": 1, "groupb": 2, "plain": 3}
    rows = [[0, 1]] * 20 + [[0]] * 5 + [[3]] * 40 + [[2, 3]] * 10
    y = np.array([1.0] * 25 + [0.0] * 50)
    pairs = [([1], [2]), ([2], [1]), ([0, 1], [0, 2])]
    free, _ = toxicity.train_weights(rows, y, [], 4)
    fair, bias = toxicity.train_weights(rows, y, pairs, 4, penalty=50.0)
    a, b = place["groupa"], place["groupb"]
    assert free[a] - free[b] > 1.0 and abs(fair[a] - fair[b]) < 0.1
    assert bias + fair[a] < 0 < bias + fair[0] + fair[b]


def test_swapped_sentences():
    pairs = toxicity.swapped("A woman spoke. Nothing here.", (("person", "woman", "man"),))
    assert [("w:person" in b, "w:man" in b) for _, b in pairs] == [(True, False), (False, True)]
    assert all("w:woman" in a and "w:woman" not in b and "w:nothing" not in a for a, b in pairs)
    assert toxicity.swapped(None) == toxicity.swapped("") == []


def test_gradient_equals_differences():
    r = np.random.default_rng(4)
    rows = [sorted(set(r.integers(0, 8, 4).tolist())) for _ in range(30)]
    loss = toxicity.Loss(rows, (r.random(30) > 0.5).astype(float), [([0, 1], [2]), ([], [3]), ([4], [5, 6])], 8, 0.7, 0.01)
    w, bias = r.normal(size=8), 0.3
    _, grad, by_bias = loss(w, bias)
    for i in range(8):
        d = np.eye(8)[i] * 1e-6
        assert abs((loss(w + d, bias)[0] - loss(w - d, bias)[0]) / 2e-6 - grad[i]) < 1e-6
    assert abs((loss(w, bias + 1e-6)[0] - loss(w, bias - 1e-6)[0]) / 2e-6 - by_bias) < 1e-6


def test_penalty_lowers_scores_of_neutral_mentions(spark):
    """Insults of the training texts often name one group; neutral sentences that name it must not pay for it."""
    r = np.random.default_rng(1)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        named = "muslims" if bad and i % 8 else "women" if not bad and i % 5 == 0 else ""
        rows.append((i, " ".join([*(word() for _ in range(6)), "zxcvb" if bad and i % 3 else "", named]), "en"))
        marks.append((i, int(bad)))
    d, m = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    free, fair = (toxicity.fit(d, m, penalty=p) for p in (0.0, toxicity.PENALTY))
    a, b = ("a quiet word of muslims", "a quiet word of women")
    assert fair.pairs > 50 and free.score(a) >= 0.3 > fair.score(a) and abs(fair.score(a) - fair.score(b)) < 0.05 < free.score(a) - free.score(b)
    assert fair.score("zxcvb") >= 0.3
    rates = [toxicity.neutral_mentions(d, m, x).first() for x in (free, fair)]
    assert rates[0].versions == rates[1].versions > 1000 and rates[1].false_positives < rates[0].false_positives


def test_pairs_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.pairs >= sum(len(g) - 1 for g in toxicity.IDENTITY_TERMS)
    got = toxicity.neutral_mentions(docs, labels, model).first()
    assert got.versions > 1000 and got.false_positives / got.versions < 0.02


def test_quality_held_out(spark):
    got = queries.op4_quality(spark, SF).toPandas()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert len(got) == 1000 and all(got.held_out == [crc(i, 5) == 0 for i in got.doc_id])
    assert (both.predicted == both.quality)[both.held_out].mean() >= 0.95


def test_votes_are_exact_cosines():
    """The blocked products equal a plain neighbour search over the same vectors."""
    texts = [f"{'Word ' * (i % 7 + 1)}number {i} {'!! ' * (i % 3)}" for i in range(80)]
    labels = np.array([i % 3 == 0 for i in range(80)], float)
    m = quality.LatentNeighbours([quality.term_counts(t) for t in texts], labels)
    got = m.score(texts[:30], neighbours=5, block=7)
    for t, s in zip(texts[:30], got):
        row = np.zeros(quality.TERMS, np.float32)
        m._weigh(row, quality.term_counts(t))
        v = row @ m.axes
        cos = (m.vectors @ v) / np.linalg.norm(v)
        at = np.argsort(-cos)[:5]
        assert s == pytest.approx((cos[at] ** 4 * labels[at]).sum() / (cos[at] ** 4).sum(), abs=1e-3)


def test_language_held_out(spark):
    got = queries.op5_language(spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert (both.lang_pred == both.lang)[both.held_out].mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_mixture_recovers_proportions():
    """Two made-up languages; a text of both gets both, in proportion, a text of one just one."""
    r = np.random.default_rng(0)
    say = lambda letters, n: " ".join("".join(r.choice(list(letters), 5)) for _ in range(n))
    table = np.stack([np.bincount(langid.trigrams([say(x, 4000)])[0], minlength=langid.BUCKETS) + 0.1 for x in ("abcdef", "mnopqr")], axis=1)
    logp = np.log(table / table.sum(0))
    share, words = langid.mixture([say("abcdef", 30) + " " + say("mnopqr", 10), say("mnopqr", 25), "", None, "12 34 !"], logp)
    assert share[0] == pytest.approx([0.75, 0.25], abs=0.05) and share[1].tolist() == [0, 1]
    assert words.tolist() == [40, 25, 0, 0, 0] and not share[2:].any()


def test_odd_rows_and_no_labels(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    clash = odd_docs.selectExpr("*", "7 AS score", "'x' AS y", "'z' AS lang_pred")
    for lab in (labels, labels.limit(0)):
        q = quality.score(clash, quality.fit(clash, lab)).collect()
        t = toxicity.score(clash, toxicity.fit(clash, lab)).collect()
        for rows in (q, t):
            assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.y == "x" for r in rows)
    assert {r.score for r in toxicity.score(odd_docs, toxicity.Toxicity({}, 0.0)).collect()} == {0.5}
    kept = quality.keep_good(clash, labels)
    assert kept.columns == clash.columns and {r.score for r in kept.collect()} <= {7}
    found = langid.identify(odd_docs, langid.train(odd_docs)).collect()
    assert len(found) == 9 and {r.doc_id for r in found if r.lang_pred == "und"} == {1, 2, 3}
    none = langid.identify(odd_docs, langid.train(odd_docs.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    empty = odd_docs.limit(0)
    assert langid.identify(empty, langid.train(odd_docs)).count() == 0 and quality.score(empty, quality.fit(empty, labels)).count() == 0
