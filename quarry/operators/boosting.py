"""Gradient boosted regression trees (L9, L10): splits and leaf values from sums of gradients and
Hessians, depth-wise or leaf-wise (best-first) growth, as a Spark ML estimator.

Features are cut into at most 255 bins once.  A pass over the rows sums gradients per (node,
feature, bin): each task adds up its own rows, so a pass shuffles and returns a table whose size is
set by nodes × features × bins, however many rows there are.  Of two siblings only the smaller is
summed; the other is its parent minus it.  A pass serves all nodes whose children may be wanted,
so a tree takes about as many passes as it is deep, also when it grows best leaf first.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

#: Accuracy of the quantile sketch that cuts bins: rank errors are below rows / SKETCH.
SKETCH = 10_000
#: Trees after which the predictions of the training rows are written again.
REFRESH = 10
#: Most nodes that one pass sums up.
NODES = 128


def walk(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The node of ``tree`` in which each row of ``bins`` ends."""
    feature, cut, left, right = (np.array(tree[k], np.int64) for k in ("feature", "cut", "left", "right"))
    at = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        node = at[rows]
        at[rows] = np.where(bins[rows, feature[node]] <= cut[node], left[node], right[node])
    return at


def to_bins(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bin i of a feature holds values up to its cut i; NaN lies in the last bin."""
    if not cuts:
        return np.zeros((len(x), 0), np.uint8)
    return np.column_stack([np.searchsorted(np.array(c, np.float64), x[:, j]) for j, c in enumerate(cuts)]).astype(np.uint8)


def best_split(grad: np.ndarray, count: np.ndarray, l2: float, min_rows: int) -> tuple[float, int, int] | None:
    """(gain, feature, cut) of the best split of a node, from its (feature, bin) sums; None if none gains.

    Gains that agree to 9 digits are ties: the first feature and the smallest cut win, whatever
    the order in which partitions were added up.
    """
    gl, nl = grad.cumsum(1)[:, :-1], count.cumsum(1)[:, :-1]
    g, n = grad[0].sum(), count[0].sum()
    nr = n - nl
    ok = (nl >= min_rows) & (nr >= min_rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, gl ** 2 / (nl + l2) + (g - gl) ** 2 / (nr + l2) - g ** 2 / (n + l2), -np.inf) / 2
    top = gain.max(initial=-np.inf)
    if not top > 1e-9 * max(1.0, g ** 2 / (n + l2)):
        return None
    j, b = np.argwhere(gain >= top * (1 - 1e-9))[0]
    return float(top), int(j), int(b)


class _Tree:
    """A tree while it grows: nodes with known sums, split ahead of need so that one pass over the
    rows serves many nodes."""

    def __init__(self, sums, l2: float, min_rows: int, max_depth: int, max_leaves: int):
        self.l2, self.min_rows, self.max_depth, self.max_leaves = l2, min_rows, max_depth, max_leaves
        self.feature, self.cut, self.left, self.right, self.depth = [], [], [], [], []
        self.sums, self.split = [], []
        self._add(0)
        self._know(0, *sums([0], self.shape())[0])

    def _add(self, depth: int) -> int:
        for part, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.depth, depth), (self.sums, None), (self.split, None)):
            part.append(v)
        return len(self.feature) - 1

    def _know(self, i: int, grad: np.ndarray, count: np.ndarray) -> None:
        self.sums[i] = grad, count
        self.split[i] = best_split(grad, count, self.l2, self.min_rows) if self.depth[i] < self.max_depth else None

    def shape(self) -> dict:
        return {"feature": self.feature, "cut": self.cut, "left": self.left, "right": self.right}

    def _choose(self) -> tuple[set[int], list[int]]:
        """Nodes split best-first as far as known; and, if that stops at a leaf whose children are
        not known, this leaf with the others that may be split next, wherever they lie."""
        leaves, taken = [0], set()
        while len(taken) + 1 < self.max_leaves:
            i = max((i for i in leaves if self.split[i]), key=lambda i: (self.split[i][0], -i), default=None)
            if i is None:
                return taken, []
            if self.left[i] < 0:
                others = [k for k, s in enumerate(self.split) if s and self.left[k] < 0 and k != i]
                others.sort(key=lambda k: -self.split[k][0])
                return taken, [i, *others[:min(self.max_leaves - 1 - len(taken), NODES) - 1]]
            leaves.remove(i)
            taken.add(i)
            leaves += [self.left[i], self.right[i]]
        return taken, []

    def grow(self, sums) -> set[int]:
        while True:
            taken, wanted = self._choose()
            if not wanted:
                return taken
            small = []
            for i in wanted:
                _, j, b = self.split[i]
                self.feature[i], self.cut[i] = j, b
                self.left[i], self.right[i] = self._add(self.depth[i] + 1), self._add(self.depth[i] + 1)
                count = self.sums[i][1][j]
                small.append(self.left[i] if 2 * count[:b + 1].sum() <= count.sum() else self.right[i])
            for i, s, (grad, count) in zip(wanted, small, sums(small, self.shape())):
                other = self.left[i] + self.right[i] - s
                self._know(s, grad, count)
                self._know(other, self.sums[i][0] - grad, self.sums[i][1] - count)

    def finished(self, taken: set[int], rate: float) -> tuple[dict, dict[int, float]]:
        """The tree of the nodes taken, with leaf values, and each feature's gain."""
        out, gains = {"feature": [], "cut": [], "left": [], "right": [], "value": []}, {}

        def put(i: int) -> int:
            at = len(out["feature"])
            grad, count = self.sums[i]
            value = -rate * grad[0].sum() / max(count[0].sum() + self.l2, 1e-300)
            for k, v in (("feature", -1), ("cut", 0), ("left", -1), ("right", -1), ("value", float(value))):
                out[k].append(v)
            if i in taken:
                gain, j, b = self.split[i]
                gains[j] = gains.get(j, 0.0) + gain
                out["feature"][at], out["cut"][at] = j, b
                out["left"][at], out["right"][at] = put(self.left[i]), put(self.right[i])
            return at
        put(0)
        return out, gains


def _add_trees(pred: np.ndarray, trees: list[dict], bins: np.ndarray) -> np.ndarray:
    for t in trees:
        pred = pred + np.array(t["value"])[walk(t, bins)]
    return pred


def _rows_of(batch, width: int):
    column = batch.column("bins").cast(pa.large_binary())
    _, ends, held = column.buffers()
    start = int(np.frombuffer(ends, np.int64)[column.offset]) if batch.num_rows else 0
    bins = np.frombuffer(held or b"", np.uint8)[start:start + batch.num_rows * width].reshape(batch.num_rows, width)
    return bins, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "pred"))


def _sums(state: DataFrame, trees: list[dict], cuts: list[list[float]]):
    """A function (nodes, tree so far) -> the (feature, bin) sums of gradient and rows of each node.
    Of a feature with two bins only the rows in the second are added up; the first has the rest."""
    width, n_bins = len(cuts), max(map(len, cuts)) + 1
    narrow = np.array([j for j, c in enumerate(cuts) if len(c) == 1], np.int64)
    wide = [j for j, c in enumerate(cuts) if len(c) != 1]

    def sums(nodes: list[int], shape: dict):
        slot = {i: s for s, i in enumerate(nodes)}

        def run(batches):
            size = len(nodes) * width * n_bins
            grad, count = np.zeros(size), np.zeros(size, np.int64)
            of = np.full(len(shape["feature"]), -1, np.int64)
            for i, s in slot.items():
                of[i] = s
            whole, rows = np.zeros(len(nodes)), np.zeros(len(nodes), np.int64)
            for batch in batches:
                bins, y, pred = _rows_of(batch, width)
                s = of[walk(shape, bins)]
                here = np.flatnonzero(s >= 0)
                s, bins = s[here], bins[here]
                g = _add_trees(pred[here], trees, bins) - y[here]
                whole += np.bincount(s, g, len(nodes))
                rows += np.bincount(s, minlength=len(nodes))
                for j in wide:
                    key = (s * width + j) * n_bins + bins[:, j]
                    grad += np.bincount(key, g, size)
                    count += np.bincount(key, minlength=size)
                at, j = np.nonzero(bins[:, narrow])                 # most are 0: only the others are added up
                key = (s[at] * width + narrow[j]) * n_bins + 1
                grad += np.bincount(key, g[at], size)
                count += np.bincount(key, minlength=size)
            of_bin = grad.reshape(len(nodes), width, n_bins), count.reshape(len(nodes), width, n_bins)
            for part, total in zip(of_bin, (whole, rows)):
                part[:, narrow, 0] = total[:, None] - part[:, narrow, 1]
            k = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(grad[k]), pa.array(count[k])], names=["k", "g", "n"])

        total = state.mapInArrow(run, "k long, g double, n long").groupBy("k").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
        grad, count = np.zeros(len(nodes) * width * n_bins), np.zeros(len(nodes) * width * n_bins, np.int64)
        k = total.column("k").to_numpy()
        grad[k], count[k] = total.column("g").to_numpy(), total.column("n").to_numpy()
        return list(zip(grad.reshape(len(nodes), width, n_bins), count.reshape(len(nodes), width, n_bins)))
    return sums


def feature_cuts(df: DataFrame, features: str, width: int, max_bins: int) -> list[list[float]]:
    """For each slot of a vector column the upper ends of its bins but the last: observed values at
    even ranks, from one scan with a bounded sketch a slot.  A slot of two values always has a cut,
    and so has one with NaN, which lies above all values."""
    x = vector_to_array(F.col(features))
    at = F.array(*[F.lit(i / (max_bins - 1)) for i in range(max_bins - 1)])
    known = [F.nanvl(x[j], F.lit(None).cast("double")) for j in range(width)]
    one = [F.struct(F.percentile_approx(v, at, F.lit(SKETCH)).alias("q"), F.max(v).alias("top"),
                    F.coalesce(F.bool_or(F.isnan(x[j])), F.lit(False)).alias("nan")).alias(f"c{j}") for j, v in enumerate(known)]
    found = df.agg(*one).first()
    return [sorted({v for v in q or [] if v < top} | ({top} if nan and top is not None else set())) for q, top, nan in found]


class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    rounds = Param(Params._dummy(), "rounds", "number of trees", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "factor on leaf values", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "added to the Hessian sum of a node", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth of a leaf", TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "most leaves of a tree, best gains first", TypeConverters.toInt)
    minRows = Param(Params._dummy(), "minRows", "fewest rows of a leaf", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, up to 255", TypeConverters.toInt)
    fitted = Param(Params._dummy(), "fitted", "JSON: base, cuts, trees, gains", TypeConverters.toString)


class BoostedTreesModel(Model, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Base value plus the leaf values of all trees; NaN goes with the largest values."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", fitted=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def parts(self) -> dict:
        return json.loads(self.getOrDefault(self.fitted))

    @property
    def featureImportances(self):
        """Share of each feature in the total gain of all splits."""
        p = self.parts
        gain = np.zeros(len(p["cuts"]))
        for j, v in p["gains"].items():
            gain[int(j)] = v
        return Vectors.dense(gain / (gain.sum() or 1.0))

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self.parts

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            bins = to_bins(np.vstack(x.to_numpy()), p["cuts"])
            return pd.Series(_add_trees(np.full(len(x), p["base"]), p["trees"], bins))
        return df.withColumn(self.getPredictionCol(), score(vector_to_array(F.col(self.getFeaturesCol()))))


class BoostedTrees(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Squared-error boosting.  A row's gradient is prediction minus label, its Hessian 1.

    The first prediction is the mean label.  A split of gradient sums GL, GR over nL, nR rows gains
    (GL²/(nL+l2) + GR²/(nR+l2) − G²/(n+l2)) / 2; a leaf's value is −rate · G / (n + l2).  A tree
    grows best gain first to ``maxLeaves`` leaves and ``maxDepth`` levels; where only the depth
    binds, that is depth-wise growth.  Rows without a label are left out.  NaN features count as the
    largest value.  Without rows every prediction is 0.  Cuts and sums, of a size that features,
    bins and leaves set, pass through the driver; rows do not.
    """

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", rounds=100, rate=0.1, l2=1.0,
                 maxDepth=6, maxLeaves=1 << 16, minRows=1, maxBins=128):
        super().__init__()
        self._setDefault(rounds=100, rate=0.1, l2=1.0, maxDepth=6, maxLeaves=1 << 16, minRows=1, maxBins=128)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        rounds, rate, l2, depth, leaves, min_rows, max_bins = (self.getOrDefault(getattr(self, k)) for k in (
            "rounds", "rate", "l2", "maxDepth", "maxLeaves", "minRows", "maxBins"))
        if not 2 <= max_bins <= 255:
            raise ValueError("maxBins must be between 2 and 255")
        features, label = self.getFeaturesCol(), self.getLabelCol()
        rows = df.where(F.col(label).isNotNull()).select(F.col(features).alias("features"), F.col(label).cast("double").alias("y"))
        first = rows.agg(F.avg("y"), F.max(F.size(vector_to_array("features")))).first()
        base, width = first[0] or 0.0, first[1] or 0
        cuts, trees, gains = (feature_cuts(rows, "features", width, max_bins) if width else []), [], {}

        def binned(batches):
            for batch in batches:
                if batch.num_rows:
                    bins = to_bins(np.vstack(batch.column("x").to_numpy(zero_copy_only=False)), cuts)
                    yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), batch.column("y"),
                                                      pa.array(np.full(len(bins), base))], names=["bins", "y", "pred"])

        def refreshed(batches, new):
            for batch in batches:
                if batch.num_rows:
                    bins, _, pred = _rows_of(batch, width)
                    yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), pa.array(_add_trees(pred, new, bins))],
                                                     names=["bins", "y", "pred"])

        schema, n_bins = "bins binary, y double, pred double", max(map(len, cuts), default=0) + 1
        if width and n_bins > 1:
            state = cut_lineage(rows.select(vector_to_array("features").alias("x"), "y").mapInArrow(binned, schema))
            pending: list[dict] = []
            for _ in range(rounds):
                if len(pending) >= REFRESH:
                    state = cut_lineage(state.mapInArrow(lambda b, new=pending: refreshed(b, new), schema))
                    pending = []
                sums = _sums(state, pending, cuts)
                tree = _Tree(sums, l2, min_rows, depth, leaves)
                done, gain = tree.finished(tree.grow(sums), rate)
                pending = [*pending, done]
                trees.append(done)
                for j, v in gain.items():
                    gains[j] = gains.get(j, 0.0) + v
        fitted = json.dumps({"base": base, "cuts": cuts, "trees": trees, "gains": gains})
        return BoostedTreesModel(featuresCol=features, labelCol=label, predictionCol=self.getPredictionCol(), fitted=fitted)
