"""Operator 3: near-duplicate embeddings by a forest of random-projection trees with spill."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import connected_components, runs, stage

COSINE = 0.95
TREES = 6
#: About so many vectors a leaf; a leaf that cannot be split well is larger and compared in tiles.
LEAF = 256
TILE = 1024
#: Vectors this near to a split (of unit length) go to both sides.
SPILL = 0.02
#: The forest is fitted on about so many vectors, chosen by a hash of the id.
FIT_ROWS = 16_384


@dataclass
class Tree:
    """Inner nodes: direction, threshold and two children; a child below 0 is leaf -child - 1."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    leaves: int

    def route(self, x: np.ndarray, spill: float) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows) for every leaf that rows reach."""
        out, todo = [], [(0 if len(self.thresholds) else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((-node - 1, rows))
                continue
            at = x[rows] @ self.directions[node] - self.thresholds[node]
            todo += [(int(self.children[node, 0]), rows[at <= spill]), (int(self.children[node, 1]), rows[at >= -spill])]
        return out


def fit_tree(sample: np.ndarray, scale: float, leaf: int, spill: float, rng: np.random.Generator) -> Tree:
    """Splits at the median along random directions until a node stands for ``leaf`` vectors
    (``scale`` times its sample), has too small a sample, or spills mostly to both sides."""
    directions, thresholds, children, leaves = [], [], [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) * scale > leaf and len(rows) >= 16:
            for _ in range(4):
                d = rng.standard_normal(sample.shape[1])
                d /= np.linalg.norm(d)
                at = sample[rows] @ d
                cut = float(np.median(at))
                left, right = rows[at <= cut + spill], rows[at >= cut - spill]
                if len(left) + len(right) <= 1.4 * len(rows) and max(len(left), len(right)) < 0.9 * len(rows):
                    node = len(thresholds)
                    directions.append(d)
                    thresholds.append(cut)
                    children.append([0, 0])
                    children[node] = [grow(left), grow(right)]
                    return node
        leaves += 1
        return -leaves

    grow(np.arange(len(sample)))
    return Tree(np.array(directions).reshape(len(thresholds), sample.shape[1]), np.array(thresholds), np.array(children, int).reshape(-1, 2), max(leaves, 1))


def compare_block(leaf: int, ids: np.ndarray, vectors: np.ndarray, leaves: list[list[int]], first: np.ndarray, second: np.ndarray,
                  cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links counted here by row, smallest connected row of the block by row).

    Compares the rows ``first`` with the rows ``second`` (equal or disjoint).  A pair counts only
    in the first leaf, in the order of numbers, that both vectors are in.
    """
    count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    hit = vectors[first] @ vectors[second].T >= cosine
    if len(first) == len(second) and first[0] == second[0]:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return count, root
    before = sorted({x for own in leaves for x in own if x < leaf})
    if before:
        column = {x: i for i, x in enumerate(before)}
        member = np.zeros((len(ids), len(before)), np.float32)
        for i, own in enumerate(leaves):
            member[i, [column[x] for x in own if x < leaf]] = 1
        hit &= member[first] @ member[second].T == 0
    count[first] += hit.sum(1)
    if first[0] != second[0] or len(first) != len(second):
        count[second] += hit.sum(0)
    while True:                                     # smallest row over links, until it stands
        low = root.copy()
        low[first] = np.minimum(low[first], np.where(hit, root[second], len(ids)).min(1))
        low[second] = np.minimum(low[second], np.where(hit, root[first][:, None], len(ids)).min(0))
        low = low[low]
        if (low == root).all():
            return count, root
        root = low


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, trees: int = TREES,
                    leaf: int = LEAF, tile: int = TILE, spill: float = SPILL, fit_rows: int = FIT_ROWS, seed: int = 3) -> DataFrame:
    """One row per id: id, n_links, component_id, kept (the id is the smallest of its component).

    Every vector goes down every tree; one near a split goes down both sides.  All vectors of a
    leaf are compared in double precision, each pair once: in the first leaf that both share.
    So n_links counts different partners without a table of pairs, and a block returns, for the
    components, one row per linked vector.  Split directions are random and thresholds are medians of
    a sample of about ``fit_rows`` vectors.  A leaf of more than ``tile`` vectors, such as a large
    group of copies, is cut into tiles by a hash of the id, and every two tiles are compared in a task
    of their own: nothing is capped.  A pair that no leaf holds is missed (see the README for the recall).

    Vectors that are null, empty, zero or hold null or non-finite values link with nothing, and
    so do vectors without an id (one row, null component_id).  Vectors of different lengths do not
    link.  Rows repeating an id are one vector: the smallest in array order.  An empty table gives an empty
    one.  Columns but the id and the vector are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector).alias("x"))
    x = F.col("x")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    rows = stage(rows.select("id", F.when(F.coalesce(usable, F.lit(False)), x).alias("x")), "vectors")
    usable_rows = rows.where("x is not null")
    sizes = {r["d"]: r["n"] for r in usable_rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rng = np.random.default_rng(seed)
    forests, base = {}, 0
    for d, n in sorted(sizes.items()):
        share = min(1.0, fit_rows / n)
        sample = usable_rows.where((F.size("x") == d) & (u < share)).select("x").toArrow()["x"]
        sample = _unit(np.array(sample.to_pylist(), np.float64).reshape(-1, d))
        forests[d] = []
        for _ in range(trees):
            forests[d].append((base, fit_tree(sample, n / max(len(sample), 1), leaf, spill, rng)))
            base += forests[d][-1][1].leaves
    shared = spark.sparkContext.broadcast(forests)

    def route(batches):
        for batch in batches:
            ids, lists = batch.column("id"), batch.column("x").to_pylist()
            length = np.array([len(v) for v in lists])
            reached: list[list[int]] = [[] for _ in lists]
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                unit = _unit(np.array([lists[i] for i in at], np.float64))
                for first, tree in shared.value[int(d)]:
                    for k, own in tree.route(unit, spill):
                        for i in own:
                            reached[at[i]].append(first + k)
            yield pa.RecordBatch.from_arrays([ids, pa.array([np.array(v, np.float64).tobytes() for v in lists], pa.binary()),
                                              pa.array([sorted(r) for r in reached], pa.list_(pa.int32()))], names=["id", "x", "leaves"])

    routed = stage(usable_rows.mapInArrow(route, "id long, x binary, leaves array<int>"), "vectors-routed")
    in_leaf = routed.select("id", F.explode("leaves").alias("leaf"))
    big = stage(in_leaf.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > tile)
                .select("leaf", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "vectors-leaves")
    member = routed.select("id", "x", "leaves", F.explode("leaves").alias("leaf")).join(big, "leaf", "left")
    parts = F.coalesce("tiles", F.lit(1))
    member = member.withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = (member.select("leaf", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "id", "x", "leaves")
             .repartition("leaf", "one", "two").sortWithinPartitions("leaf", "one", "two", "own", "id"))

    def compare(batches):
        for group in runs(batches, 3):
            key, one, two = group[0][:3]
            own, ids = np.array([g[3] for g in group]), np.array([g[4] for g in group])
            first, second = np.flatnonzero(own == one), np.flatnonzero(own == two)
            if not len(first) or not len(second):
                continue
            unit = _unit(np.frombuffer(b"".join(g[5] for g in group)).reshape(len(group), -1))
            count, root = compare_block(key, ids, unit, [g[6] for g in group], first, second, cosine)
            some = np.flatnonzero(count)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(count[some])], names=["a", "b", "n"])

    found = stage(dealt.mapInArrow(compare, "a long, b long, n long"), "vectors-links")
    links = found.groupBy("a").agg(F.sum("n").alias("n_links"))
    part = connected_components(found.select("a", "b"))
    out = rows.select("id").join(links, F.col("id") == F.col("a"), "left").join(part, F.col("id") == F.col("v"), "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (component == F.col("id")).alias("kept"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)      # first by size, so that squares stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)
