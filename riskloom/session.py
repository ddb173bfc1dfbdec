"""Session helpers: a local builder for tests, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _heap_gb() -> int:
    """Half of the memory this process may use, 16 GB at most: Python workers need the rest."""
    have = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    limit = Path("/sys/fs/cgroup/memory.max")
    if limit.exists() and (told := limit.read_text().strip()).isdigit():
        have = min(have, int(told))
    return max(1, min(16, have >> 31))


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "riskloom") -> SparkSession:
    """A single-machine session; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", f"{_heap_gb()}g")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost together with the executor that wrote it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for checkpoints")
        named = tempfile.mkdtemp(prefix="run-riskloom-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared checkpoint folder; it survives the loss of executors.

    The plan runs once (a reliable ``checkpoint()`` runs it twice), and readers get column
    pruning and real sizes, so later joins are planned on facts.
    """
    path = f"{checkpoint_root(df.sparkSession)}/tables/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fill_cores(df: DataFrame) -> DataFrame:
    """Spread a scan of fewer splits than cores before costly row work; larger inputs stay unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
