import numpy as np

from quarry.llm import embed_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_equals_brute_force_with_a_hot_group(spark):
    """A third of all vectors in one tight group, cut into many tiles; counts and components hold."""
    r = np.random.default_rng(4)
    x = r.standard_normal((900, 32))
    x[:300] = x[0] + 0.03 * r.standard_normal((300, 32))
    x[300:340] = x[300] + 0.01 * r.standard_normal((40, 32))
    x = x.astype(np.float32)
    rows = [(int(i * 13 % 2003), v.tolist(), 0) for i, v in enumerate(x)]
    got = {g.vec_id: g for g in E.near_duplicates(spark.createDataFrame(rows, SCHEMA), tile=64, leaf=64).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    ids = np.array([i for i, _, _ in rows])
    assert [got[i].n_links for i in ids] == link.sum(1).tolist()
    label = ids.copy()
    for _ in range(20):
        label = np.minimum(label, np.where(link, label[None, :], 1 << 40).min(1))
    assert [got[i].component_id for i in ids] == label.tolist()
    assert all(g.kept == (g.component_id == g.vec_id) for g in got.values())


def test_recall_on_the_given_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in E.near_duplicates(e).collect()}
    rows = e.toPandas()
    u = np.array(rows.embedding.tolist(), np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert sum(min(got[i], n) for i, n in zip(rows.vec_id, want)) >= 0.99 * want.sum()
    assert all(got[i] <= n for i, n in zip(rows.vec_id, want))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.01], 1), (2, [2.0, 0.01], 1), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0),
            (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [1e30, 0.0], 0), (None, [1.0, 0.0], 0), (11, [-1.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 10: (2, 1), None: (0, None), **{i: (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 11)}}
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
