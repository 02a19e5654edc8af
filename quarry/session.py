"""Session helpers: sensible defaults for analytics jobs and a cluster-safe checkpoint dir."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quarry", driver_memory: str | None = None,
                  checkpoint: str | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE, skew-join splitting and UTC time.

    On a cluster ``master`` is left to spark-submit; ``shuffle_partitions`` is only a
    starting point — AQE coalesces small partitions and splits skewed ones at run time.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          # checkpoint files of intermediates are deleted once their DataFrame is unreachable
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor, so its heap is the memory budget
        b = b.config("spark.driver.memory", driver_memory or "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint:
        b = b.config("spark.checkpoint.dir", checkpoint)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the session has none (local tests) is a scratch folder created; on a cluster the
    setting must point at shared storage, never at a machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at shared storage "
                               "(a machine-local folder does not survive executor loss)")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")      # local mode only (tests, single machine)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Write an intermediate that several branches of one plan consume (a value-count table,
    a pair-count table) once, instead of letting each branch re-derive it from the source."""
    return cut_lineage(df) if enabled else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint dir for intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)
