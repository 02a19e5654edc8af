"""Operator 12: a Merkle manifest of a dataset, with a proof for every row.

Where a row's leaf stands in its group comes from bitmaps, not from a sort by id: each task makes
compressed bitmaps of its ids (blocks of 2^16, as in roaring bitmaps), these are merged by group and
block, sums of their population counts form a directory, and a rank query gives the coordinate.  Leaves
then go to slot arrays of 4,096 neighbours, which reduce twelve levels of the tree at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import stage

#: Fields of a leaf, in this order; the tampering of the query. Fixed by the contract.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_MOD = 7
#: Bits of an id within a bitmap block, levels of the tree within a slot array.
BLOCK_BITS, LEVELS = 16, 12
#: Ids that a task holds before it hands on its bitmaps.
HELD_IDS = 1 << 20

_NONE, _RIGHT, _LEFT = 0, 1, 2          # the other node of a run: there is none, it follows, it leads
_STEP = 33                              # a step of a path: one of these and the other's digest


def leaf(columns: list[Column]) -> Column:
    """Lower-case hex sha256 of the columns: each ``-`` if null, else UTF-8 byte count, ``:``, value."""
    parts = []
    for c in columns:
        c = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# -- coordinates ---------------------------------------------------------------------------------

def _packed(ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes | None]:
    """Sorted distinct 16-bit ids as a bitmap, or as a list where that is shorter; and how often
    each occurs, if any occurs more than once."""
    if len(ids) * 2 < 1 << (BLOCK_BITS - 3):
        held = ids.astype("<u2").tobytes()
    else:
        bits = np.zeros(1 << BLOCK_BITS, np.uint8)
        bits[ids] = 1
        held = np.packbits(bits, bitorder="little").tobytes()
    return held, None if (counts == 1).all() else counts.astype("<i8").tobytes()


def _unpacked(held: bytes, counts: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if len(held) == 1 << (BLOCK_BITS - 3):
        ids = np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little"))
    else:
        ids = np.frombuffer(held, "<u2").astype(np.int64)
    return ids, np.ones(len(ids), np.int64) if counts is None else np.frombuffer(counts, "<i8")


def _sum_by_id(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(ids, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, counts)
    return found, total


_BLOCKS = "g string, block long, ids binary, counts binary, n long"


def _task_blocks(batches):
    """Rows (g, id) -> the compressed bitmaps of this task, one a group and block."""
    held: dict[tuple[str, int], list[np.ndarray]] = {}
    size = 0

    def flush():
        rows = []
        for (g, block), parts in held.items():
            ids, counts = np.unique(np.concatenate(parts), return_counts=True)
            rows.append((g, block, *_packed(ids, counts), int(counts.sum())))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))],
                                          names=["g", "block", "ids", "counts", "n"])

    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        groups = batch.column("g").dictionary_encode()
        code, names = groups.indices.to_numpy(zero_copy_only=False), groups.dictionary.to_pylist()
        block = ids >> BLOCK_BITS
        order = np.lexsort((block, code))
        cut = np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(block[order]) != 0)) + 1
        for at in np.split(order, cut):
            if len(at):
                held.setdefault((names[code[at[0]]], int(block[at[0]])), []).append((ids[at] & ((1 << BLOCK_BITS) - 1)).astype(np.int64))
        size += len(ids)
        if size >= HELD_IDS:
            yield flush()
            size = 0
    if held:
        yield flush()


def _merge_blocks(parts):
    """The bitmaps of one group and block -> their union."""
    ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for held, c in zip(parts.column("ids").to_pylist(), parts.column("counts").to_pylist()):
        more = _unpacked(held, c)
        ids, counts = np.concatenate([ids, more[0]]), np.concatenate([counts, more[1]])
    ids, counts = _sum_by_id(ids, counts)
    held, c = _packed(ids, counts)
    return pa.table({"g": [parts.column("g")[0].as_py()], "block": [parts.column("block")[0].as_py()], "ids": pa.array([held], pa.binary()),
                     "counts": pa.array([c], pa.binary()), "n": pa.array([int(counts.sum())], pa.int64())})


def directory(rows: DataFrame) -> DataFrame:
    """(g, id) rows -> merged blocks (g, block, ids, counts, n) with ``start``: the rows of the group in
    the blocks before.

    Starts are summed over three levels of 2^16 children each, so no window grows with the group.
    """
    blocks = stage(rows.mapInArrow(_task_blocks, _BLOCKS).groupBy("g", "block").applyInArrow(_merge_blocks, _BLOCKS), "merkle-blocks")
    level = blocks.select("g", F.col("block").alias("key"), "n")
    out, starts = blocks, []
    for shift in (0, 16, 32):
        level = level.withColumn("parent", F.shiftright("key", 16) if shift < 32 else F.lit(0))
        over = Window.partitionBy("g", "parent").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        before = level.select(F.col("g").alias("_g"), F.col("key").alias("_key"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias(f"_{shift}"))
        out = out.join(before, (F.col("g") == F.col("_g")) & (F.shiftright("block", shift) == F.col("_key"))).drop("_g", "_key")
        level = level.groupBy("g", F.col("parent").alias("key")).agg(F.sum("n").alias("n"))
        starts.append(F.col(f"_{shift}"))
    return out.select(*blocks.columns, sum(starts[1:], starts[0]).alias("start"))


_TIED = "tied"


def _ranked(columns: list[str]):
    """Rows of a block behind its bitmap -> the columns, pos (rows before those of the same id), tied
    (several rows have it)."""
    def run(batches):
        cum = many = start = None
        for batch in batches:
            kind = np.asarray(batch.column("kind").to_numpy(zero_copy_only=False))
            cuts = np.concatenate([np.flatnonzero(kind == 0), [len(kind)]])
            bounds = [0, *cuts] if len(cuts) and cuts[0] != 0 else list(cuts)
            for a, b in zip(bounds, bounds[1:]):
                if kind[a] == 0:
                    ids, counts = _unpacked(batch.column("ids")[a].as_py(), batch.column("counts")[a].as_py())
                    per = np.zeros(1 << BLOCK_BITS, np.int64)
                    per[ids] = counts
                    cum, many = np.cumsum(per) - per, per > 1
                    start = batch.column("start")[a].as_py()
                    a += 1
                if b > a:
                    part = batch.slice(a, b - a)
                    low = part.column("id").to_numpy(zero_copy_only=False) & ((1 << BLOCK_BITS) - 1)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(start + cum[low], pa.int64()), pa.array(many[low])],
                                                     names=[*columns, "pos", _TIED])
    return run


def _tie_order(rows: DataFrame, columns: list[str], first: str) -> DataFrame:
    """Rows that share group and id get places by ``first`` (a hash): pos grows by the rows before.

    Equal rows are one with a count until the end; hashes are cut into 2^16 ranges first, so rows that
    share an id, however many, are not ordered in one task.
    """
    by = ["g", "id"]
    equal = rows.groupBy(*columns, "pos").agg(F.count("*").alias("c")).withColumn("range", F.conv(F.substring(F.hex(first), 1, 4), 16, 10).cast("int"))
    equal = stage(equal, "merkle-ties")
    ranges = equal.groupBy("g", "id", "range").agg(F.sum("c").alias("c"))
    over = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("g").alias("_g"), F.col("id").alias("_id"), F.col("range").alias("_range"), F.coalesce(F.sum("c").over(over), F.lit(0)).alias("a"))
    inside = Window.partitionBy(*by, "range").orderBy(*[c for c in columns if c not in by]).rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("b", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    placed = placed.join(ranges, F.col("g").eqNullSafe(F.col("_g")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("range") == F.col("_range")))
    step = 1 << 12                                    # long runs of equal rows unfold in two steps
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / step)))
    unfolded = placed.withColumn("part", part).withColumn("k", F.explode(F.sequence(F.col("part") * step, F.least(F.col("c"), (F.col("part") + 1) * step) - 1)))
    return unfolded.select(*columns, (F.col("pos") + F.col("a") + F.col("b") + F.col("k")).alias("pos"))


def coordinates(rows: DataFrame, first: str) -> DataFrame:
    """Adds ``pos``: the place of each row in its group g by id, from 0; nulls lead, ties go by the
    binary column ``first`` and then the other columns.  Rows are (g string, id long, ...)."""
    columns = rows.columns
    types = [f.dataType for f in rows.schema]
    known, unknown = rows.where("id is not null"), rows.where("id is null")
    blocks = directory(known.select("g", "id"))
    none = lambda t: F.lit(None).cast(t)
    head = blocks.select(*(F.col("g") if c == "g" else none(t).alias(c) for c, t in zip(columns, types)), "block", F.lit(0).alias("kind"), "ids", "counts", "start")
    body = known.select(*columns, F.shiftright("id", BLOCK_BITS).alias("block"), F.lit(1).alias("kind"), none("binary").alias("ids"),
                        none("binary").alias("counts"), none("long").alias("start"))
    dealt = head.unionByName(body).repartition("g", "block").sortWithinPartitions("g", "block", "kind")
    schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in zip(columns, types))
    ranked = stage(dealt.mapInArrow(_ranked(columns), f"{schema}, pos long, {_TIED} boolean"), "merkle-ranked")
    out = ranked.where(f"not {_TIED}").drop(_TIED)
    tied = ranked.where(_TIED).drop(_TIED)
    if not tied.isEmpty():
        out = out.unionByName(_tie_order(tied, columns, first))
    if not unknown.isEmpty():
        lead = unknown.groupBy("g").agg(F.count("*").alias("lead")).select(F.col("g").alias("_g"), "lead")
        out = (out.join(lead, F.col("g") == F.col("_g"), "left").withColumn("pos", F.col("pos") + F.coalesce("lead", F.lit(0)))
               .select(*columns, "pos").unionByName(_tie_order(unknown.withColumn("pos", F.lit(0).cast("long")), columns, first)))
    return out


# -- the tree ------------------------------------------------------------------------------------

def _hex(digest: bytes) -> bytes:
    return digest.hex().encode()


def _depth(n: int) -> int:
    return (n - 1).bit_length() if n > 1 else 0


def _levels(digests: list[bytes], depth: int) -> list[list[bytes]]:
    """The nodes of a slot array, level by level: runs of two become their hash, the last may be one."""
    out = [digests]
    for _ in range(depth):
        low = [d.hex() for d in out[-1]]
        out.append([hashlib.sha256("".join(low[i:i + 2]).encode()).digest() for i in range(0, len(low), 2)])
    return out


def _path(levels: list[list[bytes]], slot: int) -> bytes:
    steps = []
    for nodes in levels[:-1]:
        other = slot ^ 1
        steps.append(bytes([_NONE]) + bytes(32) if other >= len(nodes) else bytes([_LEFT if slot & 1 else _RIGHT]) + nodes[other])
        slot >>= 1
    return b"".join(steps)


def _slots(table) -> tuple[list[bytes], np.ndarray, int]:
    """The digests of a slot array in their slots, each row's slot, and the levels to reduce."""
    pos = table.column("pos").to_numpy()
    slot = pos & ((1 << LEVELS) - 1)
    found = table.column("digest").to_pylist()
    digests: list = [None] * len(found)
    for s, d in zip(slot.tolist(), found):
        digests[s] = d
    return digests, slot, min(LEVELS, _depth(table.column("n")[0].as_py()))


_NODE = "g string, pos long, n long, digest binary"


def _reduce(table):
    digests, _, depth = _slots(table)
    n = table.column("n")[0].as_py()
    return pa.table({"g": [table.column("g")[0].as_py()], "pos": pa.array([int(table.column("pos")[0].as_py()) >> LEVELS], pa.int64()),
                     "n": pa.array([-(-n // (1 << LEVELS))], pa.int64()), "digest": pa.array([_levels(digests, depth)[-1][0]], pa.binary())})


def _paths(table, tails):
    """Path of each node of a slot array: its steps in the array, then those of the array above."""
    digests, slot, depth = _slots(table)
    levels, tail = _levels(digests, depth), tails.column("path")[0].as_py()
    return pa.table({"g": table.column("g"), "pos": table.column("pos"), "path": pa.array([_path(levels, s) + tail for s in slot.tolist()], pa.binary())})


def _array() -> Column:
    return F.shiftright("pos", LEVELS).alias("array")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """(g, pos, n, digest) with n nodes in each group -> [nodes, nodes twelve levels up, ..., roots]."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(stage(out[-1].select("g", "pos", "n", "digest").groupBy("g", _array()).applyInArrow(_reduce, _NODE), "merkle-nodes"))
        most = -(-most // (1 << LEVELS))
    return out


def descend(floors: list[DataFrame], tails: DataFrame, down_to: int) -> DataFrame:
    """Paths (g, pos, path) of the nodes of floor ``down_to``, from the paths of the roots."""
    for nodes in reversed(floors[down_to:-1]):
        tails = stage(nodes.select("g", "pos", "n", "digest").groupBy("g", _array())
                      .cogroup(tails.groupBy("g", F.col("pos").alias("array"))).applyInArrow(_paths, "g string, pos long, path binary"), "merkle-paths")
    return tails


def _fold(digest: bytes, path: bytes) -> bytes:
    for i in range(0, len(path), _STEP):
        side, other = path[i], path[i + 1:i + _STEP]
        joined = _hex(digest) if side == _NONE else _hex(digest) + _hex(other) if side == _RIGHT else _hex(other) + _hex(digest)
        digest = hashlib.sha256(joined).digest()
    return digest


def _prove(table, tails):
    """Every leaf of a slot array: the hash of its siblings and the root that it folds to."""
    digests, slot, depth = _slots(table)
    levels, tail = _levels(digests, depth), tails.column("path")[0].as_py()
    own_digests, proof, folded = table.column("digest").to_pylist(), [], []
    for s, own, other in zip(slot.tolist(), own_digests, table.column("tampered").to_pylist()):
        path = _path(levels, s) + tail
        proof.append(hashlib.sha256(b"".join(_hex(path[i + 1:i + _STEP]) for i in range(0, len(path), _STEP) if path[i] != _NONE)).hexdigest())
        folded.append(_fold(own if other is None else other, path).hex())
    hexed = lambda v: pa.array([d.hex() for d in v], pa.string())
    root = lambda name: pa.array([tails.column(name)[0].as_py().hex()] * len(slot), pa.string())
    return pa.table({"doc_id": table.column("id"), "leaf": hexed(own_digests), "subroot": root("subroot"), "root": root("root"),
                     "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string())})


_PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _group_name(lang: Column) -> Column:
    """Null sorts first, then names by their bytes; never null."""
    return F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), lang))


def _numbered(groups: DataFrame) -> DataFrame:
    """Adds ``at``: the place of each row by g.  Ranges of g are numbered apart and shifted by the rows
    of the ranges before (one row a range)."""
    ranged = stage(groups.repartitionByRange("g").withColumn("range", F.spark_partition_id()), "merkle-groups")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("c"))
    before = sizes.select(F.col("range").alias("_range"), F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("g"))
    return ranged.withColumn("own", own).join(F.broadcast(before), F.col("range") == F.col("_range")).withColumn("at", F.col("own") + F.col("before") - 1).drop("range", "_range", "own", "before")


def manifest(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", group: str = "lang", tamper: str = "n_chars", tamper_mod: int = TAMPER_MOD) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes the fields; per group leaves ascend by id, and runs of two become their hash until
    one node stays, the subroot; subroots in the order of the group (null first, then by UTF-8 bytes)
    become the root the same way.  proof_sha256 hashes the siblings from the leaf to the root.
    folded_root is recomputed from the siblings and the leaf, or, where ``tamper_mod`` divides the crc32 of the
    id as text, from the leaf with ``tamper`` raised by 1 (nulls stay); verified: it equals the root.

    Rows without an id come first in their group and are never tampered with; rows that share an id
    are ordered by leaf, so equal rows take consecutive places.  Null and empty texts and columns are
    hashed as such, texts whole.  An empty table gives an empty one; other columns are not read.  Ids
    must be integers.
    """
    columns = [F.col(c) for c in fields]
    raised = [F.col(c) + 1 if c == tamper else F.col(c) for c in fields]
    hit = (F.crc32(F.col(id_col).cast("string").cast("binary")) % tamper_mod == 0) & F.col(tamper).isNotNull()
    leaves = stage(docs.select(_group_name(F.col(group)).alias("g"), F.col(id_col).cast("long").alias("id"), F.unhex(leaf(columns)).alias("digest"),
                               F.when(hit, F.unhex(leaf(raised))).alias("tampered")), "merkle-leaves")
    placed = coordinates(leaves, "digest")
    sizes = leaves.groupBy("g").agg(F.count("*").alias("n")).select(F.col("g").alias("_g"), "n")
    placed = stage(placed.join(sizes, F.col("g") == F.col("_g")).drop("_g"), "merkle-placed")
    floors = climb(placed)
    subroots = _numbered((floors[-1] if len(floors) > 1 else placed).select("g", F.col("digest").alias("subroot")))
    n_groups = subroots.count()
    top = subroots.select(F.lit("").alias("g"), F.col("at").alias("pos"), F.lit(n_groups).cast("long").alias("n"), F.col("subroot").alias("digest"))
    top_floors = climb(top)
    root = top_floors[-1].first()
    top_paths = descend(top_floors, top_floors[-1].select("g", "pos", F.lit(b"").alias("path")), 0).select(F.col("pos").alias("at"), "path")
    named = stage(subroots.join(top_paths, "at").select("g", "subroot", F.lit(root and bytes(root.digest)).cast("binary").alias("root"), "path"), "merkle-subroots")
    tails = descend(floors, named.select("g", F.lit(0).cast("long").alias("pos"), "path"), 1)
    ends = tails.join(named.select(F.col("g").alias("_g"), "subroot", "root"), F.col("g") == F.col("_g")).select("g", "pos", "path", "subroot", "root")
    proven = (placed.select("g", "id", "pos", "n", "digest", "tampered").groupBy("g", _array())
              .cogroup(ends.groupBy("g", F.col("pos").alias("key"))).applyInArrow(_prove, _PROVEN))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("doc_id", id_col)


#: The same manifest in DuckDB SQL; it has no crc32, so the table of that checksum is derived first.
ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
  FROM range(256) r(i)),
hashed AS (
  SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 7 = 0 AS hit,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents d, crc_table),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN hit AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS tampered
  FROM hashed),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes(g, level, pos, n, h) AS (
  SELECT g, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY g, level, pos // 2),
subroots AS MATERIALIZED (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2),
tree AS MATERIALIZED (SELECT g, level, pos, n, h FROM nodes UNION ALL SELECT '#', level, pos, n, h FROM tops),
depths AS MATERIALIZED (SELECT g, max(level) AS depth FROM tree GROUP BY g),
folds(g, row, tree, level, pos, h, siblings) AS (
  SELECT g, pos, g, 0, pos, coalesce(tampered, leaf), '' FROM placed
  UNION ALL
  SELECT f.g, f.row, CASE WHEN up THEN '#' ELSE f.tree END, CASE WHEN up THEN 0 ELSE f.level + 1 END, CASE WHEN up THEN r.pos ELSE f.pos // 2 END,
         CASE WHEN up THEN f.h WHEN s.h IS NULL THEN sha256(f.h) WHEN f.pos % 2 = 0 THEN sha256(f.h || s.h) ELSE sha256(s.h || f.h) END,
         CASE WHEN up THEN siblings ELSE siblings || coalesce(s.h, '') END
  FROM (SELECT f.*, f.level = d.depth AS up FROM folds f JOIN depths d ON d.g = f.tree WHERE f.level < d.depth OR f.tree <> '#') f
  JOIN subroots r ON r.g = f.g
  LEFT JOIN tree s ON s.g = f.tree AND s.level = f.level AND s.pos = xor(f.pos, 1) AND NOT up)
SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, sha256(f.siblings) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN subroots r ON r.g = p.g
JOIN (SELECT h FROM tops WHERE n = 1) t ON true
JOIN folds f ON f.g = p.g AND f.row = p.pos AND f.tree = '#'
JOIN depths d ON d.g = '#' AND d.depth = f.level
"""
