"""M5 — exact k-nearest-neighbour imputation by nan-Euclidean distance.

The distance of two rows is ``sqrt(p / s · Σ (x − y)²)`` over the s of p features that both have.
Rows are grouped by target column, the receiver's present features and the common ones; in a group
the distance is plain Euclidean.  Donors at one point count by their k smallest keys, receivers
once.  Pivots cut the donors of a group into cells; triangle and hyperplane bounds tell which cells can
hold a receiver's k nearest, and only these meet, in tiles of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage

#: Pivots of a group (else the root of its points), donors of a tile, receivers of a group that share a tile.
MAX_PIVOTS, TILE_DONORS, TILE_RECEIVERS = 4096, 4096, 1 << 20


def _groups(patterns: Sequence[int], targets: Sequence[int]) -> list[tuple[int, int, int, int, list[int]]]:
    """(group, target, receiver pattern, common features, donor patterns); bit i: feature i is there."""
    out = []
    for j in targets:
        donors = [q for q in patterns if q >> j & 1]
        for p in (p for p in patterns if p and not p >> j & 1):
            for common in sorted({p & q for q in donors} - {0}):
                out.append((len(out), j, p, common, [q for q in donors if p & q == common]))
    return out


def _squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sums of squared differences, added feature by feature."""
    total = np.zeros((len(points), len(others)))
    for i in range(points.shape[1]):
        total += (points[:, i, None] - others[None, :, i]) ** 2
    return total


def _points(column, p: int) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(-1, p)


def _to_cells(pivots: dict[int, np.ndarray], p: int):
    """Donors -> with their nearest pivot and the distance to it."""
    def run(frames):
        for f in frames:
            cell, away = np.zeros(len(f), np.int32), np.zeros(len(f))
            pts, gid = _points(f["point"], p), f["gid"].to_numpy()
            for g in np.unique(gid):
                at = np.flatnonzero(gid == g)
                head = np.r_[True, (np.diff(pts[at], axis=0) != 0).any(1)]              # donors of a point lie together
                of, heads = np.cumsum(head) - 1, at[head]
                for part in np.array_split(heads, -(-len(heads) // 1024)):
                    d = _squares(pts[part], pivots[g])
                    cell[part] = d.argmin(1)
                    away[part] = np.sqrt(d.min(1))
                cell[at], away[at] = cell[heads[of]], away[heads[of]]
            yield f.assign(cell=cell, away=away)
    return run


def _visits(pivots: dict[int, np.ndarray], cells: dict[int, tuple], k: int, p: int):
    """Receivers -> one row per tile of the cells that may hold one of their k nearest donors."""
    import pandas as pd

    def reach(point, g):
        n, radius, nearest, tiles = cells[g]
        own = pivots[g]
        d = np.sqrt(_squares(point[None], own)[0])
        far = d + radius
        order = np.argsort(far)
        enough = np.flatnonzero(np.cumsum(n[order]) >= k)
        limit = far[order[enough[0]]] if len(enough) else np.inf
        limit = min(limit, (d + nearest).min())                       # a cell's k-th donor from its pivot; inf if it has fewer
        best = int(d.argmin())
        between = np.sqrt(_squares(own[best][None], own)[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between > 0, (d ** 2 - d[best] ** 2) / (2 * between), 0.0)
        slack = 1e-9 * (1 + limit + d.max()) if np.isfinite(limit) else 0.0
        return np.flatnonzero((n > 0) & (np.maximum(d - radius, plane) <= limit + slack)), tiles

    def run(frames):
        for f in frames:
            pts, gid, rows = _points(f["point"], p), f["gid"].to_numpy(), []
            for i in range(len(f)):
                hit, tiles = reach(pts[i], gid[i])
                rows += [(i, c, t) for c in hit.tolist() for t in range(tiles[c])]
            at = [r[0] for r in rows]
            yield pd.DataFrame({"gid": gid[at].astype(np.int32), "cell": np.array([r[1] for r in rows], np.int32), "tile": np.array([r[2] for r in rows], np.int32),
                                "split": f["split"].to_numpy()[at].astype(np.int32), "point": f["point"].iloc[at].tolist()})
    return run


def _nearest(k: int, p: int):
    """Rows of a tile, donors first -> each receiver with its k nearest donors of the tile."""
    import pandas as pd

    def run(frames):
        now, keys, values, donors = None, [], [], []
        for f in frames:
            cols = [f[c].to_numpy() for c in ("gid", "cell", "tile", "split", "kind")]
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
            for part in np.split(np.arange(len(f)), cut):
                if not len(part):
                    continue
                tile = tuple(int(c[part[0]]) for c in cols[:4])
                if tile != now:
                    now, keys, values, donors = tile, [], [], []
                rows = f.iloc[part]
                if cols[4][part[0]] == 0:
                    keys.append(rows["key"].to_numpy(np.int64)), values.append(rows["value"].to_numpy(np.float64)), donors.append(_points(rows["point"], p))
                    continue
                key, value, own = np.concatenate(keys), np.concatenate(values), np.concatenate(donors)
                order = np.argsort(key, kind="stable")
                key, value, own = key[order], value[order], own[order]
                keys, values, donors = [key], [value], [own]
                for some in np.array_split(np.arange(len(rows)), -(-len(rows) // 256)):
                    d = _squares(_points(rows["point"].iloc[some], p), own)
                    best = np.argsort(d, axis=1, kind="stable")[:, :k]          # equal distances: smallest key first
                    at = np.repeat(some, best.shape[1])
                    flat = best.ravel()
                    yield pd.DataFrame({"gid": np.full(len(at), now[0], np.int32), "point": rows["point"].iloc[at].tolist(), "donor": key[flat],
                                        "value": value[flat], "d2": np.take_along_axis(d, best, 1).ravel()})
    return run


def knn_fills(df: DataFrame, cols: Sequence[str], key: str, k: int = 5, features: Sequence[str] | None = None) -> DataFrame:
    """``(key, variable, value)`` for every null of ``cols`` in a row with a key that has a donor: the
    mean of its k nearest rows that have the column (all, if fewer), ties by the smaller donor key.

    ``key`` must be a unique integer; ``features`` (default ``cols``, of which they must be a superset) at most
    12.  NaN counts as null.  Rows without any feature, and columns without donors, give no row.
    Through the driver go the patterns of present features, the pivots and a row per cell.
    """
    features = list(features or cols)
    if not set(cols) <= set(features) or len(features) > 12:
        raise ValueError("features must hold all of cols, and be at most 12")
    p, spark = len(features), df.sparkSession
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    pattern = sum((F.when(value[c].isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(features)), F.lit(0))
    x = cut_lineage(df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.array(*value.values()).alias("x"), pattern.cast("int").alias("pattern")))
    seen = [r["pattern"] for r in x.select("pattern").distinct().collect()]                 # at most 2^p
    groups = _groups(sorted(seen), [features.index(c) for c in cols])
    if not groups:
        return spark.createDataFrame([], "key long, variable string, value double")
    use = spark.createDataFrame([(g, j, s, p / s.bit_count(), q, 0) for g, j, _, s, qs in groups for q in qs] + [(g, j, s, p / s.bit_count(), r, 1) for g, j, r, s, _ in groups],
                                "gid int, target int, common int, scale double, pattern int, kind int")
    # of donors that agree in all features only the k smallest keys can count, in any group
    alike = Window.partitionBy("pattern", *[F.element_at("x", i + 1) for i in range(p)]).orderBy("key")
    few = x.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k).drop("_n")
    masked = F.transform("x", lambda v, i: F.when(F.getbit("common", i) == 1, v).otherwise(0.0))
    wanting = x.join(F.broadcast(use.where("kind = 1")), "pattern").withColumn("point", masked)     # one small row per group and pattern
    giving = few.join(F.broadcast(use.where("kind = 0")), "pattern").withColumn("point", masked)
    by_point = Window.partitionBy("gid", *[F.element_at("point", i + 1) for i in range(p)]).orderBy("key")
    donors = (giving.select("gid", "point", "key", F.element_at("x", F.col("target") + 1).alias("value"))
              .withColumn("_n", F.row_number().over(by_point)).where(F.col("_n") <= k))
    donors = cut_lineage(donors)
    sizes = {r["gid"]: r["n"] for r in donors.where("_n = 1").groupBy("gid").agg(F.count("*").alias("n")).collect()}
    most = F.element_at(F.create_map(*[F.lit(v) for g, n in sizes.items() for v in (g, min(MAX_PIVOTS, math.isqrt(n) + 1))]), F.col("gid"))
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.xxhash64("point"), "key"))
    chosen = donors.where("_n = 1").withColumn("_r", rank).where(F.col("_r") <= MAX_PIVOTS).where(F.col("_r") <= most).select("gid", "point").collect()
    pivots = {g: np.array([r["point"] for r in chosen if r["gid"] == g], np.float64) for g in sizes}
    placed = cut_lineage(donors.select("gid", "point", "key", "value").mapInPandas(_to_cells(pivots, p), "gid int, point array<double>, key long, value double, cell int, away double"))
    in_cell = Window.partitionBy("gid", "cell").orderBy("away")
    kth = placed.select("gid", "cell", "away").withColumn("_n", F.row_number().over(in_cell)).where(F.col("_n") <= k).groupBy("gid", "cell").agg(F.max("away").alias("near"))
    stats = placed.groupBy("gid", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).join(kth, ["gid", "cell"]).collect()   # a row per pivot
    cells = {g: (np.zeros(len(v), np.int64), np.zeros(len(v)), np.full(len(v), np.inf), np.zeros(len(v), np.int64)) for g, v in pivots.items()}
    for r in stats:
        n, radius, near, tiles = cells[r["gid"]]
        c = r["cell"]
        n[c], radius[c], tiles[c] = r["n"], r["radius"], -(-r["n"] // TILE_DONORS)
        if r["n"] >= k:
            near[c] = r["near"]
    points = cut_lineage(wanting.where(F.col("gid").isin(list(sizes))).select("gid", "point").distinct())
    splits = {r["gid"]: -(-r["n"] // TILE_RECEIVERS) for r in points.groupBy("gid").agg(F.count("*").alias("n")).collect()}
    if not splits:
        return spark.createDataFrame([], "key long, variable string, value double")
    parts = F.element_at(F.create_map(*[F.lit(v) for g, n in splits.items() for v in (g, n)]), F.col("gid"))
    visits = points.withColumn("split", F.pmod(F.xxhash64("point"), parts).cast("int")).mapInPandas(
        _visits(pivots, cells, k, p), "gid int, cell int, tile int, split int, point array<double>")
    n_tiles = spark.createDataFrame([(g, c, int(t)) for g, v in cells.items() for c, t in enumerate(v[3]) if t], "gid int, cell int, tiles int")
    dealt = (placed.join(F.broadcast(n_tiles), ["gid", "cell"]).where(F.col("gid").isin(list(splits)))           # a row per pivot
             .select("gid", "cell", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int").alias("tile"),
                     F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("split"), F.lit(0).alias("kind"), "point", "key", "value"))
    none = F.lit(None)
    both = dealt.unionByName(visits.select("*", F.lit(1).alias("kind"), none.cast("long").alias("key"), none.cast("double").alias("value")))
    place = ["gid", "cell", "tile", "split"]
    near = (both.repartition(*place).sortWithinPartitions(*place, "kind")
            .mapInPandas(_nearest(k, p), "gid int, point array<double>, donor long, value double, d2 double"))
    found = near.withColumn("_n", F.row_number().over(Window.partitionBy("gid", "point").orderBy("d2", "donor"))).where(F.col("_n") <= k)
    found = cut_lineage(found.select("gid", "point", "donor", "value", "d2"))
    candidates = wanting.select("gid", "point", "target", "scale", F.col("key").alias("own")).join(found, ["gid", "point"])
    order = Window.partitionBy("own", "target").orderBy(F.col("d2") * F.col("scale"), "donor")
    best = candidates.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).groupBy("own", "target").agg(F.avg("value").alias("value"))
    names = F.element_at(F.array(*map(F.lit, features)), F.col("target") + 1)
    return best.select(F.col("own").alias("key"), names.alias("variable"), "value")


def knn_impute(df: DataFrame, cols: Sequence[str], key: str, k: int = 5, features: Sequence[str] | None = None) -> DataFrame:
    """M5 — nulls of ``cols`` filled by ``knn_fills``, or by the column's mean where no donor is
    comparable; the columns become DOUBLE, values that are there stay."""
    fills = knn_fills(df, cols, key, k, features).groupBy(F.col("key").alias("_own")).agg(*[F.max(F.when(F.col("variable") == c, F.col("value"))).alias(f"_fill_{c}") for c in cols])
    means = df.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c) for c in cols]).first()
    joined = df.join(fills, F.col(key) == F.col("_own"), "left")
    own = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    return joined.withColumns({c: F.coalesce(own[c], F.col(f"_fill_{c}"), F.lit(means[c]).cast("double")) for c in cols}).select(*df.columns)
