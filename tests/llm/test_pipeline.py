"""Each stage of the pipeline on what the one before kept, against brute force."""

import random

import corpus_pipeline as P
from test_native_ops import brute as leaks
from test_ngram_join import brute as groups

from quarry.llm import mixing


def test_stages(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(3)]
    rows, labels = [], []
    for i in range(240):
        lines = ["Home | About" if i % 2 else "shared foot line", *(" ".join(word() for _ in range(12)) for _ in range(5))]
        if i % 9 == 1 and rows[i - 1][0] % 6 != 5:
            lines = rows[i - 1][1].split("\n")
        if i % 11 == 2:
            lines.insert(2, items[i % 3][1])
        bad = i % 6 == 5
        text = " ".join(w.upper() + "!!" for w in " ".join(lines).split()) if bad else "\n".join(lines)
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        labels.append((i, int(not bad), 0))
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols, out = docs.columns, []
    for name, step in P.STAGES:
        docs = P.stage(step(spark, docs, d), "test-pipeline")
        out.append({x.doc_id: x for x in docs.collect()})
        if len(out) < 5:
            assert docs.columns == cols, name
    assert set(out[0]) == {i for i, q, _ in labels if q}
    assert set(out[1]) == set(out[0])
    for i, x in out[1].items():
        assert x.text == "\n".join(t for t in rows[i][1].split("\n") if t not in ("Home | About", "shared foot line")) and x.n_chars == len(x.text)
    after = [(i, x.text) for i, x in out[1].items()]
    assert set(out[2]) == {i for i, (_, c) in groups(after, 5, (80, 100)).items() if i == c}
    hit = {i for i, _ in leaks([(i, x.text) for i, x in out[2].items()], items)}
    assert hit and set(out[3]) == set(out[2]) - hit
    assert 0 < len(out[4]) < len(out[3]) and set(out[4]) <= set(out[3])
    again = P.run(spark, d)
    assert {x.doc_id for x in again.collect()} == set(out[4]) and {"tokens", "topic", "p"} <= set(again.columns)
    total = sum(mixing.with_tokens_and_topic(spark.createDataFrame(list(out[3].values()))).toPandas().tokens)
    assert abs(sum(x.tokens for x in out[4].values()) / total - mixing.KEEP) < 0.2
