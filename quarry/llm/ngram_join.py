"""Operator 1: exact Jaccard join of word n-gram sets, and its connected components.

Sets are compared only within tiles of two neighbouring size bands.  A tile cuts the hash range
into so many parts that two sets above the threshold must agree on one of them, and sets that
agree on a part share a bucket.  Within a bucket, parity bitmaps bound the overlap of two sets
from above; what passes is decided by intersecting the sorted hash arrays.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import connected_components, runs, stage, text_batches, unstage, within_small_batches

WORDS = 3
#: Two sets link when SHARE[1] * |intersection| >= SHARE[0] * |union|.
SHARE = (90, 100)
#: Members of a bucket that one task compares at once with as many others.
TILE_ROWS = 512
#: Blocks with the same smallest members that one task is dealt, and pairs that it holds to name each once.
HOME_BLOCKS, HELD_PAIRS = 256, 1 << 18
#: Characters of text that a task turns into sets at once, and prints of sets that it remembers.
PIECE, SEEN = 1 << 20, 1 << 17
#: The ids of sets that share a bucket are broadcast up to this number (about 20 bytes each), else shuffled.
BROADCAST_IDS = 1_000_000

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M3
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of words.

    A-Z is lower-cased; words stand between ASCII white space.  Fewer words than n are one n-gram;
    no words none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(h))
    out = h[:len(h) - n + 1] + _U(n)
    for i in range(1, n):
        out = _mix(out * _M1) + h[i:len(h) - n + 1 + i]
    return np.unique(_mix(out))


@lru_cache(maxsize=None)
def _tiles(share: tuple[int, int]) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray, int]]]:
    """(first size of each band, (part bounds, part salts, empty parts allowed) of each tile).

    Sets that link lie in the same band or in neighbouring ones.  Tile i serves pairs whose smaller
    set is in band i; these differ in at most ``most`` elements, so of most + 1 + e parts at least
    e + 1 agree.  A set with at most e empty parts then agrees on one that is not empty.
    """
    low, high = share
    bands = [1]
    while bands[-1] < 1 << 31:
        bands.append(max(bands[-1] + 1, (bands[-1] - 1) * high // low + 1))
    tiles = []
    for i in range(len(bands) - 2):
        top = bands[i + 1] + bands[i + 2] - 2
        most = max(s - 2 * -(-low * s // (low + high)) for s in range(max(2, top - 40), top + 1))
        empty = 0
        for _ in range(20):
            mean = (most + 1 + empty) * math.exp(-bands[i] / (most + 1 + empty))
            wanted = 0 if mean < 1e-3 else min(most + 2, math.ceil(mean + 4 * math.sqrt(mean)))
            if wanted <= empty:
                break
            empty = wanted
        tiles.append((most + 1 + empty, empty))
    return bands, tiles


@lru_cache(maxsize=4096)
def _parts(share: tuple[int, int], tile: int) -> tuple[np.ndarray, np.ndarray, int]:
    k, empty = _tiles(share)[1][tile]
    bounds = np.array([(j << 64) // k for j in range(1, k)], np.uint64)
    salts = _mix((np.arange(k, dtype=np.uint64) + _U(tile << 32)) * _M1 + _U(k))
    return bounds, salts, empty


def bucket_keys(hashes: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """The buckets of a set: one for each part that is not empty, in the tiles of its own band and
    of the band below.  If more parts are empty than a tile allows for, these count too."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    bands, _ = _tiles(share)
    band = int(np.searchsorted(bands, len(hashes), side="right")) - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(hashes + _M1))])
    out = []
    for tile in sorted({max(band - 1, 0), band}):
        bounds, salts, empty = _parts(share, tile)
        cut = np.concatenate([[0], np.searchsorted(hashes, bounds), [len(hashes)]])
        size = np.diff(cut)
        keys = _mix(total[cut[1:]] - total[cut[:-1]] + salts)
        out.append(keys if np.count_nonzero(size == 0) > empty else keys[size > 0])
    return np.concatenate(out)


def bitmap(hashes: np.ndarray) -> bytes:
    """A parity bitmap of 8 to 16 bits an element: bit i tells whether an odd number of elements
    hash to i.  The bits in which two bitmaps differ bound the symmetric difference from below."""
    width = max(512, 1 << (8 * len(hashes) - 1).bit_length())
    at = (_mix(hashes ^ _M3) & _U(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(bits: bytes, words: int) -> np.ndarray:
    """The bitmap of a smaller width: its halves combined until it has so many 64-bit words."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) > words:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


def _short(bits: bytes) -> bytes:
    """Half of the bitmap's width, for the first look at many sets; the bound holds for any width."""
    return _folded(bits, len(bits) // 16).tobytes()


def may_link(bits: list[bytes], sizes: np.ndarray, other: list[bytes], other_sizes: np.ndarray, share: tuple[int, int] = SHARE):
    """Yields (row, mask over the others): where the bound from bitmaps and sizes allows a link."""
    words = min(map(len, [*bits, *other])) // 8
    x, y = (np.array([_folded(b, words) for b in part]) for part in (bits, other))
    for i in range(len(x)):
        total = sizes[i] + other_sizes
        most = np.minimum((total - np.bitwise_count(x[i] ^ y).sum(1)) // 2, np.minimum(sizes[i], other_sizes))
        yield i, share[1] * most >= share[0] * (total - most)


def _prints(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two 64-bit sums over the hashes of each set: equal sets have equal ones."""
    return [np.array([f(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for f in (_mix, lambda s: _mix(s * _M1 + _M2))]


def _signatures(words: int):
    """Size and prints of each row's set."""
    def run(batches):
        for part, texts in text_batches(batches, ["text"], PIECE):
            sets = [shingle_set(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, _prints(sets))],
                                             names=["id", "n", "f1", "f2"])
    return run


def _keys(words: int, share: tuple[int, int]):
    """(key, f1): the buckets of each row's set; of equal sets that follow each other closely in a task
    only one has any, and rows without an id have none."""
    def run(batches):
        seen: set[tuple[int, int]] = set()
        for part, texts in text_batches(batches, ["text"], PIECE):
            sets = [shingle_set(t, words) for t, known in zip(texts, part.column("id").is_valid().to_pylist()) if known]
            sums = _prints(sets)
            if len(seen) > SEEN:
                seen.clear()
            keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for x, y, s in zip(sums[0].tolist(), sums[1].tolist(), sets):
                if (x, y) not in seen:
                    seen.add((x, y))
                    keys.append(bucket_keys(s, share))
                    owner.append(np.full(len(keys[-1]), x, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner))], names=["key", "f1"])
    return run


def _sets(words: int):
    def run(batches):
        for part, texts in text_batches(batches, ["text"], PIECE):
            sets = [shingle_set(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *map(pa.array, _prints(sets)), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([bitmap(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "f1", "f2", "n", "bits", "elements"])
    return run


def _linked(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that link: first by bitmaps, then by intersecting the sorted arrays."""
    def bound(batches):
        for batch in batches:
            a, b, na, nb, xa, xb = (c.to_pylist() for c in batch.columns)
            keep = [bool(next(may_link([p], np.array([m]), [q], np.array([n]), share))[1][0]) for p, q, m, n in zip(xa, xb, na, nb)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("xa"), batch.column("xb")):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(share[1] * both >= share[0] * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    small = sets.select("id", "n", "bits")
    screened = (pairs.join(small.toDF("b", "nb", "xb"), "b").join(small.toDF("a", "na", "xa"), "a")
                .select("a", "b", "na", "nb", "xa", "xb").mapInArrow(bound, "a long, b long"))
    whole = sets.select("id", "elements")
    return (screened.join(whole.toDF("b", "xb"), "b").join(whole.toDF("a", "xa"), "a").select("a", "b", "xa", "xb")
            .mapInArrow(exact, "a long, b long"))


def _shortened(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([_short(b) for b in batch.column("bits").to_pylist()], pa.binary())], names=["id", "n", "short"])


def _tile_pairs(buckets: DataFrame, part: DataFrame, sets: DataFrame, share: tuple[int, int], rows: int) -> DataFrame:
    """Pairs of a bucket that may link and are not yet in one component.

    buckets: (key, id); part: (v, root), the components so far.  A bucket whose members are all in
    one component is done; of buckets with the same members one is looked at.  Its members, in
    the order of their components, are cut into tiles of ``rows``, and every two tiles that are not
    wholly of one component are compared, by their short bitmaps.

    Near copies share hundreds of buckets with almost the same members.  So blocks are dealt by the
    smallest ids of their two tiles (their home), up to HOME_BLOCKS of one home to a task, and a task
    names a pair once for all it has read (in rounds of HELD_PAIRS).  This only saves repeats: the
    distinct at the end remains.
    """
    placed = buckets.join(part, F.col("id") == F.col("v"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    placed = stage(placed, "join-open")
    h = F.xxhash64("id")
    what = (placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"),
                                      F.sum(F.shiftright(h, 20)).alias("s"), F.bit_xor(h).alias("x"))
            .where("low <> high").groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key"))
    order = Window.partitionBy("key").orderBy("root", "id")
    tiled = stage(placed.join(what, "key").withColumn("tile", F.floor((F.row_number().over(order) - 1) / F.lit(rows)).cast("int")), "join-tiles")
    tiles = tiled.groupBy("key", "tile").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("id").alias("home"))
    one, two = tiles.toDF("key", "one", "low1", "high1", "home1"), tiles.toDF("key", "two", "low2", "high2", "home2")
    blocks = stage(one.join(two, "key").where("one <= two and not (low1 = high1 and low2 = high2 and low1 = low2)")
                   .select("home1", "home2", "key", "one", "two"), "join-blocks")
    crowds = blocks.groupBy("home1", "home2").agg(F.ceil(F.count("*") / F.lit(HOME_BLOCKS)).alias("crowds"))
    dealt_to = F.pmod(F.xxhash64("key", "one", "two"), F.col("crowds")).cast("int")
    blocks = (blocks.join(crowds, ["home1", "home2"]).withColumn("crowd", dealt_to).drop("crowds")
              .withColumn("tile", F.explode(F.array_distinct(F.array("one", "two")))))
    short = sets.select("id", "n", "bits").mapInArrow(_shortened, "id long, n long, short binary")
    member = blocks.join(tiled, ["key", "tile"]).join(short, "id")
    home = ["home1", "home2", "crowd"]
    dealt = (member.select(*home, "key", "one", "two", "tile", "id", "root", "n", "short").repartition(*home)
             .sortWithinPartitions(*home, "key", "one", "two", "tile"))

    def candidates(group):
        tile, ids, roots, n = (np.array([r[i] for r in group]) for i in (6, 7, 8, 9))
        bits = [r[10] for r in group]
        a, b = np.flatnonzero(tile == tile[0]), np.flatnonzero(tile == tile[-1])
        found = [np.zeros((0, 2), np.int64)]
        for i, mask in may_link([bits[i] for i in a], n[a], [bits[j] for j in b], n[b], share):
            hit = ids[b[mask & (roots[b] != roots[a[i]])]]
            found.append(np.column_stack([np.minimum(hit, ids[a[i]]), np.maximum(hit, ids[a[i]])]))
        return np.concatenate(found)

    def compare(batches):
        held, rows = [], 0
        for group in runs(batches, 6):
            found = candidates(group)
            if len(found):
                held.append(found)
                rows += len(found)
            if rows > HELD_PAIRS:
                held = [np.unique(np.concatenate(held), axis=0)]
                rows = len(held[0])
                if 2 * rows > HELD_PAIRS:
                    yield _pair_batch(held[0])
                    held, rows = [], 0
        if rows:
            yield _pair_batch(np.unique(np.concatenate(held), axis=0))

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE,
                       tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per id: id, n_shingles (size of its set), component_id (smallest id reachable by links).

    Equal sets are one class, shown by their smallest id, so copies cost a row each and no more.
    A class is first compared with the class it shares most buckets with (as the smallest id
    there), then with the smallest of all its buckets, and last, in tiles, with whatever in its
    buckets is not in its component yet.  So groups of near copies cost about a row per bucket and
    member; every link between different sets either is found or joins sets already connected.

    Sets are compared by 64-bit hashes of their n-grams, classes by 128 bits (buckets by 64).  Null and empty texts
    and texts without words: size 0, linked with nothing.  Whole texts are read.  Rows repeating an
    id are one document: that with the smallest set.  Rows without an id are one row, with null
    component_id.  Ids must be integers.  An empty table gives an empty one; columns but the id
    and the text are not read.
    """
    with within_small_batches(docs.sparkSession):
        return _components(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), words, share, tile_rows).select(
            F.col("id").alias(id_col), "n_shingles", "component_id")


def _components(rows: DataFrame, words: int, share: tuple[int, int], tile_rows: int) -> DataFrame:
    signed = stage(rows.mapInArrow(_signatures(words), "id long, n long, f1 long, f2 long"), "join-signed")
    ids = signed.groupBy("id").agg(F.min(F.struct("n", "f1", "f2")).alias("s"), F.count("*").alias("rows")).select("id", "s.*", "rows")
    named = F.col("id").isNotNull() & (F.col("n") > 0)
    shared = (ids.where(named).groupBy("n", "f1", "f2").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
              .where("copies > 1").drop("copies"))
    ids = ids.join(stage(shared, "join-copies"), ["n", "f1", "f2"], "left")
    ids = stage(ids.withColumn("class", F.when(named, F.coalesce("first", "id"))).drop("first"), "join-ids")
    unstage(signed)
    per_key = Window.partitionBy("key")
    keyed = rows.mapInArrow(_keys(words, share), "key long, f1 long").withColumns({"low": F.min("f1").over(per_key), "high": F.max("f1").over(per_key)})
    keyed = stage(keyed.where("low <> high").select("key", "f1").distinct(), "join-keys")
    classes = ids.where(F.col("class") == F.col("id"))
    buckets = keyed.join(classes.select("f1", "id"), "f1").select("key", "id")
    lowest = buckets.groupBy("key").agg(F.min("id").alias("low"))
    buckets = stage(buckets.join(lowest, "key"), "join-buckets")
    unstage(keyed)
    wanted = stage(classes.join(buckets.select("id"), "id", "left_semi").select(F.col("id").alias("want"), F.col("f1").alias("w1"), F.col("f2").alias("w2"), "rows"), "join-wanted")
    listed, repeated = wanted.select("want", "w1", "w2"), not wanted.where("rows > 1").isEmpty()
    if wanted.count() <= BROADCAST_IDS:
        listed = F.broadcast(listed)
    sets = rows.join(listed.select("want"), F.col("id") == F.col("want"), "left_semi")
    sets = sets.mapInArrow(_sets(words), "id long, f1 long, f2 long, n long, bits binary, elements binary")
    sets = sets.join(listed, (F.col("id") == F.col("want")) & (F.col("f1") == F.col("w1")) & (F.col("f2") == F.col("w2")), "left_semi")
    sets = stage(sets.dropDuplicates(["id"]) if repeated else sets, "join-sets")

    stars = stage(buckets.where("id <> low").groupBy(F.col("low").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared")), "join-stars")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    links = stage(_linked(best, sets, share), "join-links")
    near = links.select(F.col("b").alias("v"), F.col("a").alias("root"))        # one link each: enough to skip pairs of one star
    rest = _apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), near)
    links = links.unionByName(stage(_linked(rest, sets, share), "join-links"))
    part = connected_components(links)
    more = stage(_linked(_tile_pairs(buckets.select("key", "id"), part, sets, share, tile_rows), sets, share), "join-links")
    if not more.isEmpty():
        part = connected_components(links.unionByName(more))
    found = ids.join(part, F.col("class") == F.col("v"), "left")
    return found.select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "class", "id").alias("component_id"))


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    of_a, of_b = part.toDF("a", "ra"), part.toDF("b", "rb")
    return (pairs.join(of_a, "a", "left").join(of_b, "b", "left")
            .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """Pipeline form: of each component the row with the smallest id; same columns.

    Rows repeating an id, or without one, all stay or go together; the latter stay.
    """
    groups = jaccard_components(docs, id_col, text, words, share)
    gone = groups.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).cast(docs.schema[id_col].dataType))
    return docs.join(gone, id_col, "left_anti")
