"""Operator 13: best-fit packing of documents into sequences, certified by lower bounds.

Documents are cut into pieces of the sequence length, the remainder first; full pieces are
sequences of their own.  The others are dealt evenly to partitions, each packed best-fit
decreasing.  Dual feasible functions bound each partition's number of bins from below; one with a
gap lets its bins exchange pieces and packs those with room again.  A partition that then meets its bound keeps
its bins but the emptiest; one that does not gives up all bins with room.  What is given up is
dealt anew, to fewer partitions, and packed again, until one partition holds it or all pieces
together meet their own bound.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage, text_batches
from quarry.llm.tokens import default_vocabulary, encoder

#: Tokens of a sequence, and the id that ends a document (fixed by the contract).
CAPACITY, END = 1024, 2
#: Pieces that one task packs at most, about.
PARTITION_ROWS = 1 << 16
#: Partners that a bin looks at for a swap of one of its pieces.
DRAWN = 16
#: Rounds of exchange at most: each has fewer pieces, and a round that saves no bin is the last.
ROUNDS = 12


# -- pieces --------------------------------------------------------------------------------------

def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: the first takes the remainder."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _token_ids(path: str, end: int):
    """Arrow batches with a ``text`` column -> (batch slice, list of id arrays with the end added)."""
    def run(batches):
        encode = encoder(path)
        for part, texts in text_batches(batches, ["text"], 1 << 20):
            yield part, [np.array([*ids, end], np.uint32) for ids in encode([t or "" for t in texts])]
    return run


def _cut(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches):
        for part, docs in _token_ids(path, end)(batches):
            row, piece, start, length, crc, held = [], [], [], [], [], []
            for i, ids in enumerate(docs):
                for k, (s, n) in enumerate(cut_points(len(ids), capacity)):
                    own = ids[s:s + n]
                    row.append(i), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    if with_ids:
                        held.append(own.astype(np.int32))
            found = {"doc_id": part.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32())}
            found |= {name: pa.array(c, pa.int64()) for name, c in (("start", start), ("length", length), ("ids_crc32", crc))}
            if with_ids:
                found["ids"] = pa.array(held, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(found)
    return run


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "uid")
_PLACED = _PIECE + ", uid long, bin long, offset long, kept boolean, part long"


# -- packing one partition -----------------------------------------------------------------------

@lru_cache(maxsize=8)
def _bound_tables(capacity: int) -> np.ndarray:
    """One row per dual feasible function, its value for each length 0..capacity, as integers; the
    last column is the function's value of a full bin.

    For k up to half the capacity: lengths over capacity - k count as a whole bin, those under k not
    at all, the others as themselves.  For whole parts m: a length counts as floor((m + 1) x / capacity)
    of m parts, or exactly x / capacity where (m + 1) x is a multiple of the capacity.
    """
    x = np.arange(capacity + 1)
    rows = []
    for k in range(0, capacity // 2 + 1):
        rows.append(np.append(np.where(x > capacity - k, capacity, np.where(x < k, 0, x)), capacity))
    for m in range(1, min(100, capacity)):
        parts = (m + 1) * x
        exact = parts % capacity == 0
        rows.append(np.append(np.where(exact, m * x, parts // capacity * capacity), m * capacity))
    return np.array(rows, np.int64)


def least_bins(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """A lower bound of the bins that pieces need; counts[x] pieces have the length x."""
    tables = _bound_tables(capacity)
    total = tables[:, :-1] @ counts
    return int(max(-(-t // f) for t, f in zip(total.tolist(), tables[:, -1].tolist())))


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the room left in each bin: longest first, each into the
    fullest bin that has room (of these the last touched), else into a new one."""
    bins, offsets, room = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0                                            # bit r: a bin with exactly r left exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = with_room[left].pop()
            if not with_room[left]:
                some &= ~(1 << left)
        else:
            b, left = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - left
        room[b] = left - n
        if left > n:
            with_room[left - n].append(b)
            some |= 1 << (left - n)
    return bins, offsets, np.array(room, np.int64)


def exchange(lengths: np.ndarray, bins: np.ndarray, room: np.ndarray, capacity: int = CAPACITY, seed: int = 0) -> np.ndarray:
    """Moves room of one bin to another, so that it gathers in few; returns the new bin of each piece.

    A bin with room r takes a piece of length r, or swaps one of length x for one of x + r, from the
    bin with most room among some drawn ones that have such a piece, full ones too: the first is then
    full, the other has r more.
    """
    rng = random.Random(seed)
    bins, room, sizes = bins.tolist(), room.tolist(), lengths.tolist()
    inside: list[set[int]] = [set() for _ in room]
    where: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, (b, n) in enumerate(zip(bins, sizes)):
        inside[b].add(i)
        where[n].append(i)
    todo = [b for b, r in enumerate(room) if r]
    for a in sorted(todo, key=lambda b: (room[b], b)):
        r = room[a]
        best = None
        for i in [None, *inside[a]] if 0 < r < capacity else []:
            held = where[r + (0 if i is None else sizes[i])] if r + (0 if i is None else sizes[i]) <= capacity else []
            for j in held if len(held) <= DRAWN else rng.sample(held, DRAWN):
                if bins[j] != a and (best is None or (room[bins[j]], len(inside[bins[j]])) > best[0]):
                    best = (room[bins[j]], len(inside[bins[j]])), i, j
        if best is None:
            continue
        _, i, j = best
        b = bins[j]
        inside[b].remove(j), inside[a].add(j)
        bins[j] = a
        if i is not None:
            inside[a].remove(i), inside[b].add(i)
            bins[i] = b
        room[a], room[b] = 0, room[b] + r
    return np.array(bins, np.int64)


def repack(lengths: np.ndarray, capacity: int = CAPACITY, tries: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best-fit decreasing; while it misses its bound, bins exchange pieces and those left open are
    packed again.  Returns bins, offsets, room and the bound."""
    least = least_bins(np.bincount(lengths, minlength=capacity + 1), capacity)
    bins, _, room = best_fit(lengths, capacity)
    for attempt in range(tries):
        if len(room) <= least:
            break
        moved = exchange(lengths, bins, room, capacity, attempt)
        left = capacity - np.bincount(moved, lengths, len(room)).astype(np.int64)
        again = np.flatnonzero(left[moved] > 0)
        full, fixed = np.unique(moved[left[moved] == 0], return_inverse=True)
        more, _, more_room = best_fit(lengths[again], capacity)
        if len(full) + len(more_room) > len(room):
            continue
        bins = np.empty_like(bins)
        bins[left[moved] == 0], bins[again] = fixed, more + len(full)
        room = np.concatenate([np.zeros(len(full), np.int64), more_room])
    order = np.lexsort((np.arange(len(bins)), bins))
    filled = np.cumsum(lengths[order]) - lengths[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(bins, lengths, len(room)).astype(np.int64))])[:-1]
    offsets = np.empty(len(bins), np.int64)
    offsets[order] = filled - start[bins[order]]
    return bins, offsets, room, least


def _pack(capacity: int, last: bool):
    """A partition's pieces with bin, offset and ``kept``: false for what it gives up."""
    def run(part):
        lengths = part.column("length").to_numpy()
        bins, offsets, room, bound = repack(lengths, capacity)
        gap = len(room) > bound
        keep = np.ones(len(room), bool)
        if not last:
            keep = room == 0 if gap else np.arange(len(room)) != int(np.argmax(room))
            keep |= room == 0
        out = {c: part.column(c) for c in _COLUMNS}
        return pa.table(out | {"bin": pa.array(bins), "offset": pa.array(offsets), "kept": pa.array(keep[bins]), "part": part.column("part")})
    return run


def _deal(pool: DataFrame, rows: int, round_no: int, capacity: int, last: bool) -> DataFrame:
    parts = max(1, -(-rows // PARTITION_ROWS))
    dealt = pool.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(_pack(capacity, last), _PLACED)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id",
                   text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id, offset (and its ids).

    A row's tokens are the ids of its whole text by the vocabulary file, then ``end``; null and
    empty texts are the end alone.  Rows that repeat an id, or have none, are documents of their own
    (ids must be integers); an empty table gives an empty one; other columns are not read.  No row is
    dropped and no text cut but into pieces.  ids_crc32 is of little-endian unsigned 32-bit ids.

    Partitions are dealt by a hash of the piece's own number, so none grows with an id or a source.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = rows.mapInArrow(_cut(path, capacity, end, with_ids), _PIECE + (", ids array<int>" if with_ids else ""))
    tokenised = stage(cut.withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    pieces, full = tokenised.select(*_COLUMNS), F.col("length") == capacity
    out = [pieces.where(full).select(*_COLUMNS, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool, given_up = pieces.where(~full), None
    lengths = np.zeros(capacity + 1, np.int64)
    for r in pool.groupBy("length").agg(F.count("*").alias("c")).collect():               # at most capacity - 1 rows
        lengths[r.length] = r.c
    left, least, settled, used = int(lengths.sum()), least_bins(lengths, capacity), 0, None
    for round_no in range(ROUNDS):
        if not left:
            break
        last = left <= PARTITION_ROWS or round_no == ROUNDS - 1
        placed = stage(_deal(pool, left, round_no, capacity, last), "packing-round")
        bins = placed.groupBy("part", "bin").agg(F.first("kept").alias("kept"), F.count("*").alias("rows"))
        now = {r.kept: (r.bins, r.rows) for r in bins.groupBy("kept").agg(F.count("*").alias("bins"), F.sum("rows").alias("rows")).collect()}
        kept, given = now.get(True, (0, 0)), now.get(False, (0, 0))
        if used is not None and kept[0] + given[0] > used:
            out.append(given_up)                          # the exchange cost bins: what was there before stands
            break
        number = F.lit(round_no << 56).cast("long") + F.col("part") * (1 << 32) + F.col("bin")
        numbered = placed.select(*_COLUMNS, number.alias("sequence_id"), "offset", "kept")
        if last or kept[0] + given[0] == used or settled + kept[0] + given[0] == least:
            out.append(numbered.drop("kept"))
            break
        out.append(numbered.where("kept").drop("kept"))
        given_up = numbered.where("not kept").drop("kept")
        pool, settled, used, left = given_up.select(*_COLUMNS), settled + kept[0], given[0], given[1]
    packed = out[0]
    for more in out[1:]:
        packed = packed.unionByName(more)
    if with_ids:
        packed = packed.join(tokenised.select("uid", "ids"), "uid")
    return packed.drop("uid").withColumnRenamed("doc_id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """Pieces with their ids -> the token sequences: (sequence_id, ids array<int>).  A sequence is a
    bounded group."""
    pieces = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return pieces.select("sequence_id", F.flatten("p.ids").alias("ids"))
