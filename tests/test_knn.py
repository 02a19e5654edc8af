"""M5 against brute force: every pair of rows, nan-Euclidean distance, ties by key."""

import math
import random

import pytest

from quarry.operators import knn


def _brute(rows, cols, k):
    out = {}
    for key, *x in rows:
        for j, c in enumerate(cols):
            if x[j] is not None:
                continue
            near = []
            for other, *y in rows:
                both = [i for i in range(len(cols)) if x[i] is not None and y[i] is not None]
                if y[j] is not None and both:
                    near.append((sum((x[i] - y[i]) ** 2 for i in both) * (len(cols) / len(both)), other, y[j]))
            near = sorted(near)[:k]
            if near:
                out[key, c] = sum(v for _, _, v in near) / len(near)
    return out


def _check(spark, rows, cols, k):
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))
    got = {(r.key, r.variable): r.value for r in knn.knn_fills(df, cols, "id", k).collect()}
    want = _brute(rows, cols, k)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[x], want[x], rel_tol=1e-9, abs_tol=1e-9) for x in want)
    return df


@pytest.mark.parametrize("cols,k,values", [(["a", "b", "c"], 5, 1000), (["a", "b", "c", "d"], 3, 4), (["a", "b"], 1, 50)])
def test_equals_brute_force(spark, cols, k, values):
    r = random.Random(values)
    rows = [(i, *(None if r.random() < 0.15 else float(r.randint(0, values)) for _ in cols)) for i in range(400)]
    _check(spark, rows, cols, k)


def test_a_third_of_rows_at_one_point_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(knn, "TILE_DONORS", 16)
    monkeypatch.setattr(knn, "TILE_RECEIVERS", 20)
    r = random.Random(8)
    rows = [(i, 5.0, 5.0, float(i % 7)) if i % 3 == 0 else (i, r.random() * 10, r.random() * 10, None if i % 5 == 0 else r.random()) for i in range(450)]
    rows += [(1000 + i, 5.0, 5.0, None) for i in range(60)]
    _check(spark, rows, ["a", "b", "c"], 5)


def test_fixture_and_odd_rows(spark):
    rows = [(1, 1.0, 2.0), (2, 1.0, 4.0), (3, 9.0, 8.0), (4, 1.0, None), (5, None, 8.0), (6, None, None)]
    df = _check(spark, rows, ["a", "b"], 2)
    got = {r.id: (r.a, r.b) for r in knn.knn_impute(df, ["a", "b"], "id", 2).collect()}
    assert got[4] == (1.0, 3.0) and got[5] == (5.0, 8.0) and got[1] == (1.0, 2.0)
    assert got[6] == (3.0, 5.5)                              # nothing to compare by: the means
    empty = spark.createDataFrame([], "id long, a double, b double")
    assert knn.knn_fills(empty, ["a", "b"], "id").collect() == []
    full = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None)], "id long, a double, b double")
    assert [tuple(x) for x in knn.knn_impute(full, ["a", "b"], "id").orderBy("id").collect()] == [(1, 1.0, None), (2, 2.0, None)]
    with pytest.raises(ValueError):
        knn.knn_fills(full, ["a"], "id", features=["b"])
