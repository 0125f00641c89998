"""Log tailing: a stream of rolled files, parsed with the batch columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidefuse.functions.logparse import parse_lines
from tidefuse.functions.timeops import us_of
from tidefuse.session import listing


#: Micro-batches that the files of a folder are dealt to at most. Each has a fixed cost, so their number is bounded, not their size.
BACKLOG_BATCHES = 64


def batch_files(spark: SparkSession, folder: str, files_per_batch: int) -> int:
    """Files of one micro-batch: ``files_per_batch``, or more if the folder holds too many for that.

    All files count that are there when the stream starts, those read before it was stopped too.
    """
    with listing(spark):
        present = spark.read.format("binaryFile").load(folder).select("length").count()
    return max(files_per_batch, -(-present // BACKLOG_BATCHES))


def tail_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New lines of a folder. Writers roll files: a file is read once, when it appears.

    A backlog of many files takes at most ``BACKLOG_BATCHES`` micro-batches. Lines pass through the
    tasks of a batch one by one, so a larger batch has more tasks and needs no more memory.
    """
    return (
        spark.readStream.option("maxFilesPerTrigger", batch_files(spark, folder, files_per_batch)).text(folder)
        .withColumnRenamed("value", "line")
    )


def tail_records(spark: SparkSession, folder: str) -> DataFrame:
    return parse_lines(tail_lines(spark, folder))


def alerts(records: DataFrame) -> DataFrame:
    """Rows worth showing: steps, evaluations, alarming events and phase changes."""
    return records.where(
        F.col("metric_type").isNotNull() | F.col("event_nan_loss").isNotNull()
        | F.col("event_oom").isNotNull() | F.col("event_high_loss").isNotNull()
        | F.col("phase").isNotNull()
    )


def append_to(
    stream: DataFrame, path: str, checkpoint: str,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Append a stream to parquet exactly once; by default in batches of five seconds."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def append_present(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived so far to parquet exactly once, and wait until that is done.

    Each batch lists its files anew, by the settings of the stream's session at that time.
    """
    with listing(stream.sparkSession):
        query = append_to(stream, path, checkpoint, {"availableNow": True})
        query.awaitTermination()
    return query


def slot_counts(stream: DataFrame, granularity: float, late: str = "10 minutes",
                kind: str = "event_type") -> DataFrame:
    """Events per run, slot and kind; rows later than the watermark are left to the batch job."""
    width = f"{us_of(granularity)} microseconds"
    timed = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return (
        timed.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", width), "run_id", kind)
        .agg(F.count("*").alias("n"))
        .select("run_id", F.col("window.start").cast("timestamp_ntz").alias("slot"), kind, "n")
    )


def slot_partials(
    stream: DataFrame, path: str, granularity: float, kind: str = "event_type",
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Counts per run, slot and kind of each micro-batch, in a folder of its own below ``path``.

    However late a row is, its batch counts it: ``read_slots`` sums up. A batch that is repeated
    after a failure writes its folder anew, so nothing is counted twice.
    """
    width = f"{us_of(granularity)} microseconds"

    def step(batch: DataFrame, epoch: int) -> None:
        timed = batch.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        timed.groupBy(F.window("timestamp", width), "run_id", kind).agg(F.count("*").alias("n")).select(
            "run_id", F.col("window.start").cast("timestamp_ntz").alias("slot"), kind, "n",
        ).write.mode("overwrite").parquet(f"{path}/partials/epoch={epoch}")

    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"processingTime": "5 seconds"})).start()
    )


def read_slots(spark: SparkSession, path: str, kind: str = "event_type") -> DataFrame:
    """The counts so far, late rows included."""
    return spark.read.parquet(f"{path}/partials").groupBy("run_id", "slot", kind).agg(F.sum("n").alias("n"))
