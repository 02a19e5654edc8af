import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quarry.operators import regression as RG
from quarry.operators.boosting import BoostedTrees, BoostedTreesModel


def _plain(x, y, rounds, rate, l2, depth, leaves, min_rows):
    """The same trees by trying every value of every feature as a cut, on all rows at once."""
    pred = np.full(len(y), y.mean())
    for _ in range(rounds):
        g = pred - y
        value = lambda r: -rate * g[r].sum() / (len(r) + l2)

        def split(rows, level):
            best = None
            if level < depth:
                score = lambda r: g[r].sum() ** 2 / (len(r) + l2)
                for j in range(x.shape[1]):
                    for c in np.unique(x[rows, j])[:-1]:
                        a, b = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                        gain = (score(a) + score(b) - score(rows)) / 2
                        if min(len(a), len(b)) >= min_rows and gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                            best = gain, a, b
            return best

        nodes = [(np.arange(len(y)), 0, split(np.arange(len(y)), 0))]
        while len(nodes) < leaves and any(n[2] for n in nodes):
            k = max((i for i, n in enumerate(nodes) if n[2]), key=lambda i: nodes[i][2][0])
            _, level, (_, a, b) = nodes.pop(k)
            nodes += [(r, level + 1, split(r, level + 1)) for r in (a, b)]
        pred = pred.copy()
        for rows, _, _ in nodes:
            pred[rows] += value(rows)
    return pred


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 20, 500), rng.integers(0, 2, 500), rng.integers(0, 9, 500), np.ones(500)]).astype(float)
    y = 3 * (x[:, 0] > 11) + 2 * x[:, 1] * (x[:, 2] > 4) - 0.3 * x[:, 2] + rng.normal(scale=0.2, size=500)
    df = spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], ["id", "features", "y"])
    return df.repartition(4), x, y


@pytest.mark.parametrize("rounds, l2, depth, leaves, min_rows", [(12, 1.0, 3, 1 << 16, 1), (4, 0.0, 64, 9, 20), (1, 0.0, 1, 2, 1), (2, 1.0, 6, 1 << 16, 1)])
def test_equal_to_plain_numpy(data, rounds, l2, depth, leaves, min_rows):
    df, x, y = data
    m = BoostedTrees(labelCol="y", rounds=rounds, rate=0.3, l2=l2, maxDepth=depth, maxLeaves=leaves, minRows=min_rows).fit(df)
    got = np.array([r.prediction for r in m.transform(df).orderBy("id").collect()])
    assert np.allclose(got, _plain(x, y, rounds, 0.3, l2, depth, leaves, min_rows), atol=1e-9)
    assert max(t["feature"].count(-1) for t in m.parts["trees"]) <= leaves
    shares = m.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares[3] == 0


def test_saved_and_read_again(data, tmp_path):
    df, _, _ = data
    m = BoostedTrees(labelCol="y", rounds=2).fit(df)
    m.write().overwrite().save(str(tmp_path / "m"))
    again = BoostedTreesModel.load(str(tmp_path / "m"))
    assert m.transform(df).orderBy("id").collect() == again.transform(df).orderBy("id").collect()


def test_odd_rows(spark, data):
    df, _, _ = data
    one = df.where("id = 0")
    m = BoostedTrees(labelCol="y", rounds=3).fit(one)
    row = m.transform(one).first()
    assert row.prediction == row.y and m.parts["trees"] == []
    assert BoostedTrees(labelCol="y", rounds=3).fit(df.where("false")).transform(one).first().prediction == 0.0
    assert BoostedTrees(labelCol="y").fit(df.withColumn("y", F.lit(None).cast("double"))).parts["trees"] == []
    nan = spark.createDataFrame([(Vectors.dense(v), t) for v, t in [(1.0, 0.0), (2.0, 0.0), (float("nan"), 6.0), (float("nan"), 6.0)]], ["features", "y"])
    got = BoostedTrees(labelCol="y", rounds=1, rate=1.0, l2=0.0, maxDepth=1).fit(nan).transform(nan).collect()
    assert [r.prediction for r in got] == [0.0, 0.0, 6.0, 6.0]


def test_beats_the_mean_in_the_pipeline(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), "uvw"[i % 3], 5.0 * float(a > 0.3) + (i % 3) + 1) for i, a in enumerate(rng.random(300))]
    df = spark.createDataFrame(rows, "id int, a double, c string, y double")
    for name in ("boost_depthwise", "boost_leafwise"):
        m = RG.fit_pipeline(df, name, ["a"], ["c"], "y", rounds=20)
        got = RG.regression_metrics(RG.predict(m, df, ["a"]), "y").first()
        assert got.r2 > 0.95
        assert RG.importance_table(m, RG.predict(m, df, ["a"])).first().feature == "a"
