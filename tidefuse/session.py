"""Session helpers: local sessions for tests, the UTC check, shared scratch folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
LISTING_SETTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def local_session(name: str = "tidefuse", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects. Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Call sites of column expressions are recorded otherwise, at a cost per call.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def require_utc(spark: SparkSession) -> None:
    """Time arithmetic runs on epoch microseconds, which needs a zone without clock changes."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, found {zone}")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. A local master may fall
    back to a temporary folder; anything else without the setting is an error,
    because executors could not see a folder of the driver's machine.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    current = context.getCheckpointDir()
    if root is None and current is not None:
        return current
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tidefuse-")
    if current is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody used yet, below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def few_tasks(spark: SparkSession) -> int:
    """Tasks for work on many small files: a few per core."""
    return max(32, 4 * spark.sparkContext.defaultParallelism)


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Folders listed inside are dealt to a few tasks per core.

    Spark starts a task per folder up to ten thousand, and starting one costs more than listing it.
    """
    before = spark.conf.get(LISTING_SETTING)
    spark.conf.set(LISTING_SETTING, str(min(int(before), few_tasks(spark))))
    try:
        yield
    finally:
        spark.conf.set(LISTING_SETTING, before)
