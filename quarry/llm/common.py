"""Helpers shared by the operators of this package: staged tables, components, id splits."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir


#: The minima of so many links (at most two rows of 16 bytes a link) may be broadcast.
BROADCAST_LINKS = 500_000


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the folder that the cluster shares (``spark.checkpoint.dir``)."""
    return os.path.join(checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    It cuts lineage like a checkpoint, survives lost executors, and unlike one keeps column
    pruning, compression and the size that the planner needs to choose a join.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more: what came from it is staged itself."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark hand Python at most ``rows`` rows at a time, for the rest of the session: for lazy
    results, which run when the caller wants them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


@contextmanager
def within_small_batches(spark: SparkSession, rows: int = 1000):
    """Inside, Spark hands Python at most ``rows`` rows at a time: rows of long texts and arrays
    would else fill a worker's memory, and workers keep what they once had.  Afterwards the session
    has its own setting again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (v, root): every vertex of a link with the smallest vertex it can reach.

    Alternates two star operations until the links no longer change.  The large star hangs the
    larger neighbours of each vertex on the smallest one; the small star does so with the smaller
    ones.  Both keep connectivity and never add links, so the table shrinks to one link per
    vertex.  Minima come from a pre-aggregated groupBy and an equi-join, which adaptive execution
    splits when one vertex holds many links.  Self-links and rows with a null end are ignored; no
    links give an empty result.
    """
    a, b = F.col("a"), F.col("b")
    work = stage(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    before = _mark(work)
    hint = F.broadcast if before[0] <= BROADCAST_LINKS else lambda df: df
    while before[0]:
        both = work.unionByName(work.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = work.join(hint(low), F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct()
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        hung = large.join(hint(small), F.col("a") == F.col("u"))
        work = stage(hung.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        after = _mark(work)
        if after == before:
            break
        before = after
    roots = work.select(b.alias("v")).distinct().select("v", F.col("v").alias("root"))
    return work.select(a.alias("v"), b.alias("root")).unionByName(roots)


def _mark(links: DataFrame) -> tuple:
    """Number of links and an order-free sum over them, to see whether a round changed any."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(h, 24)), F.bit_xor(h)).first())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, rows: int, seed: int = 1) -> DataFrame:
    """About ``rows`` labelled documents (doc_id, text, y) outside the held-out fold, all if fewer.

    A row is taken by a hash of its id, with the chance rows / eligible, so the sample is the same
    on every run and its size is bound by the parameter (give or take a few square roots).  An id
    labelled both ways counts as 1; of rows repeating an id the smallest text is taken.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", mod) != held))
             .groupBy("doc_id").agg(F.max(label).cast("double").alias("y")))
    eligible = known.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = F.broadcast(known.where(u < rows / max(eligible, 1)))        # at most about ``rows`` ids
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def text_batches(batches, columns: list[str], size: int = 1 << 22):
    """Arrow batches -> pieces of about ``size`` characters of their first text column.

    Yields (arrow slice, list of texts); keeps what a task holds at once bound by the piece and
    the longest single text.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(columns[0])), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                part = batch.slice(start, i - start)
                yield part, part.column(columns[0]).to_pylist()
                start, held = i, 0
            held += n
        if start < len(lengths):
            part = batch.slice(start)
            yield part, part.column(columns[0]).to_pylist()


def runs(batches, keys: int):
    """Lists of consecutive rows (tuples) whose first ``keys`` values are equal, across batches."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != last and held:
                yield held
                held = []
            last = row[:keys]
            held.append(row)
    if held:
        yield held


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
