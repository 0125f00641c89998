"""Scans of sample files with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefuse.functions.measures import percent_of, supported_number


# The columns of the sample files and their types.
DEVICE = {
    "run_id": T.StringType(),
    "timestamp": T.TimestampNTZType(),
    "gpu_id": T.IntegerType(),
    "name": T.StringType(),
    "utilization_gpu": T.DoubleType(),
    "utilization_memory": T.DoubleType(),
    "memory_total": T.LongType(),
    "memory_used": T.LongType(),
    "memory_free": T.LongType(),
    "memory_percent": T.DoubleType(),
    "temperature": T.DoubleType(),
    "power_draw": T.DoubleType(),
}

# Fixed values.
HOST = {
    "run_id": T.StringType(),
    "timestamp": T.TimestampNTZType(),
    "cpu_percent": T.DoubleType(),
    "cpu_percent_max": T.DoubleType(),
    "cpu_freq_current": T.DoubleType(),
    "load_avg_1min": T.DoubleType(),
    "load_avg_5min": T.DoubleType(),
    "load_avg_15min": T.DoubleType(),
    "memory_percent": T.DoubleType(),
    "swap_percent": T.DoubleType(),
    "disk_percent": T.DoubleType(),
    "disk_read_rate": T.DoubleType(),
    "disk_write_rate": T.DoubleType(),
    "cpu_count_physical": T.IntegerType(),
    "cpu_count_logical": T.IntegerType(),
    "process_count": T.IntegerType(),
    "process_running": T.IntegerType(),
    "process_sleeping": T.IntegerType(),
    "memory_total": T.LongType(),
    "memory_available": T.LongType(),
    "memory_used": T.LongType(),
    "memory_free": T.LongType(),
    "memory_cached": T.LongType(),
    "memory_buffers": T.LongType(),
    "swap_total": T.LongType(),
    "swap_used": T.LongType(),
    "swap_free": T.LongType(),
    "disk_total": T.LongType(),
    "disk_used": T.LongType(),
    "disk_free": T.LongType(),
    "disk_read_count": T.LongType(),
    "disk_write_count": T.LongType(),
    "disk_read_bytes": T.LongType(),
    "disk_write_bytes": T.LongType(),
    "disk_read_time": T.LongType(),
    "disk_write_time": T.LongType(),
    "network_bytes_sent": T.LongType(),
    "network_bytes_recv": T.LongType(),
    "network_packets_sent": T.LongType(),
    "network_packets_recv": T.LongType(),
    "network_errin": T.LongType(),
    "network_errout": T.LongType(),
    "network_dropin": T.LongType(),
    "network_dropout": T.LongType(),
    "gpu_util": T.DoubleType(),
    "gpu_memory_used": T.DoubleType(),
    "gpu_memory_total": T.DoubleType(),
    "gpu_temperature": T.DoubleType(),
}

# Fixed values.
RECORD = {
    "run_id": T.StringType(),
    "timestamp": T.TimestampNTZType(),
    "line_no": T.LongType(),
    "step": T.LongType(),
    "anomaly_step": T.LongType(),
    "loss": T.DoubleType(),
    "learning_rate": T.DoubleType(),
    "throughput": T.DoubleType(),
    "step_time": T.DoubleType(),
    "eval_loss": T.DoubleType(),
    "eval_accuracy": T.DoubleType(),
    "eval_f1": T.DoubleType(),
    "eval_precision": T.DoubleType(),
    "eval_recall": T.DoubleType(),
    "metric_type": T.StringType(),
    "phase": T.StringType(),
    "anomaly_type": T.StringType(),
    "anomaly_value": T.StringType(),
    "raw_line": T.StringType(),
    "event_nan_loss": T.IntegerType(),
    "event_oom": T.IntegerType(),
    "event_high_loss": T.IntegerType(),
    "event_error": T.IntegerType(),
    "event_warning": T.IntegerType(),
}


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by their header, the first line of each; one pass over the lines, none is parsed."""
    # The first split of a file begins with it, and a task reads a split in order.
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("row"))
    first = lines.groupBy("file").agg(F.min_by("value", "row").alias("header"))
    out: dict[str, list[str]] = {}
    # A name per file, which the driver lists to plan a scan anyway.
    for row in first.orderBy("file").collect():
        out.setdefault(row["header"], []).append(row["file"])
    return out


def scan_csv(spark: SparkSession, path: str, known: dict[str, T.DataType]) -> DataFrame:
    """CSV files of one kind, whose columns and their order may differ from file to file.

    Files with one header are read together with its schema, and the classes are united by
    name: columns that some files lack are null in their rows. Columns without a known type
    are read as text.
    """
    classes = headers(spark, path)
    if not classes:
        raise ValueError(f"no lines below {path}")
    parts = []
    for header, files in classes.items():
        if len(classes) == 1:
            files = [path]
        names = spark.read.option("header", True).csv(spark.sparkContext.parallelize([header], 1)).columns
        schema = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in names])
        parts.append(spark.read.schema(schema).options(header=True, enforceSchema=False, mode="PERMISSIVE").csv(files))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def device_query_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Device query output: fields in fixed order, no header.

    Lines with fewer than nine fields or with an unreadable number are dropped.
    """
    parts = F.transform(F.split(F.trim(F.col(line)), ","), lambda p: F.trim(p))
    kept = [c for c in lines.columns if c != line]
    cells = lines.select(*kept, parts.alias("_p")).where(F.size("_p") >= 9)

    def field(i: int):
        return F.col("_p")[i]

    parsed = cells.select(
        *kept,
        field(0).try_cast("int").alias("gpu_id"),
        field(1).alias("name"),
        supported_number(field(2), "int").alias("utilization_gpu"),
        supported_number(field(3), "int").alias("utilization_memory"),
        field(4).try_cast("long").alias("memory_total"),
        field(5).try_cast("long").alias("memory_used"),
        field(6).try_cast("long").alias("memory_free"),
        supported_number(field(7), "int").alias("temperature"),
        supported_number(field(8), "double").alias("power_draw"),
    )
    numbers = ["gpu_id", "utilization_gpu", "utilization_memory", "memory_total", "memory_used",
               "memory_free", "temperature", "power_draw"]
    return parsed.dropna(subset=numbers).withColumn(
        "memory_percent", percent_of(F.col("memory_used"), F.col("memory_total"))
    )

