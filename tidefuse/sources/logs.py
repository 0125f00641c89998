"""Raw log files as lines in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_ORDER = ("file", "_split", "_line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and a sortable position.

    Spark has no line numbers, but the start of a split and the row's place in
    it order the lines of a file, also when a large file is read by many tasks.
    Rolled files of one run follow each other by name, so ``LINE_ORDER`` orders
    a whole run. Blank lines are dropped, undecodable bytes are replaced.
    """
    return (
        spark.read.text(path)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias(LINE_ORDER[1]),
            F.monotonically_increasing_id().alias(LINE_ORDER[2]),
        )
        .where(F.length(F.trim("line")) > 0)
    )


def run_of_file(file: Column) -> Column:
    """Run directories hold the files of a run: .../<run>/<file>."""
    return F.element_at(F.split(file, "/"), -2)
