"""File-level questions: which runs are complete, how much data is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefuse.session import few_tasks, listing
from tidefuse.sources.logs import run_of_file

# The files a run needs, and the mark of a stored matrix.
REQUIRED_FILES = ("gpu_metrics.csv", "system_metrics.csv", "training_metrics.csv")
MATRIX_MARK = "_metadata.yaml"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and run of every file below a folder; contents are not read."""
    with listing(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # A task would take a few files, however small, and starting one costs more than that.
    return found.coalesce(few_tasks(spark)).select("path", "length", run_of_file(F.col("path")).alias("run_id"),
                        F.element_at(F.split("path", "/"), -1).alias("file"))


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """run_id of every folder right below ``path``, also of empty ones; files are not listed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Told by their statuses: a listing that gives files alone looks up the owner of every entry, by a process each on a local disk.
    names = [e.getPath().getName() for e in system.listStatus(target) if e.isDirectory()]
    return spark.createDataFrame([(n,) for n in sorted(names) if not n.startswith(("_", "."))], "run_id string")


def run_completeness(files: DataFrame, required: Sequence[str] = REQUIRED_FILES,
                     runs: DataFrame | None = None) -> DataFrame:
    """Runs with the required files they lack. ``runs`` names also those without any file."""
    wanted = F.array(*[F.lit(f) for f in required])
    if runs is not None:
        files = files.select("run_id", "file").unionByName(runs.select("run_id", F.lit(None).cast("string").alias("file")))
    present = F.collect_set(F.when(F.col("file").isin(*required), F.col("file")))
    return (
        files.groupBy("run_id").agg(present.alias("_have"))
        .select("run_id", F.array_join(F.array_except(wanted, "_have"), ",").alias("missing"))
        .withColumn("complete", F.col("missing") == "")
    )


def file_inventory(files: DataFrame) -> DataFrame:
    return files.groupBy("run_id").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"),
        F.count_if(F.col("file").endswith(MATRIX_MARK)).alias("matrices"),
    )
