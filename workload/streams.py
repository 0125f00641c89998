"""Streaming queries, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidefuse.session import scratch_path
from tidefuse.streaming import counters, growing, tail
from workload.base import EV, query, rounded
from workload.logs import (
    EVENT_CELLS, PHASE_CELL, RECORD_CELLS, SQL_LINES, STEP_CELLS, TIME_CELL, TYPE_CELL, lines, with_auc,
)

ONCE = {"availableNow": True}
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def drain(stream, path: str) -> None:
    tail.append_present(stream, f"{path}/data", f"{path}/checkpoint")


def rolled_logs(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "rolled")
    lines(spark, sf_dir).select("line").write.option("maxRecordsPerFile", 2000).text(path)
    return path


def stream_events(spark: SparkSession, sf_dir: str):
    return (
        spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        .select("event_id", F.col("ts").alias("timestamp"), "user_id", "event_type", "value",
                F.concat(F.lit("run_"), (F.col("user_id") % 8).cast("string")).alias("run_id"))
    )


@query("stream_log_tail", f"WITH {SQL_LINES} SELECT line, count(*) AS n FROM lines GROUP BY 1")
def stream_log_tail(spark, sf_dir):
    out = scratch_path(spark, "tail")
    drain(tail.tail_lines(spark, rolled_logs(spark, sf_dir), files_per_batch=3), out)
    return spark.read.parquet(f"{out}/data").groupBy("line").agg(F.count("*").alias("n"))


@query("stream_growing_log", f"WITH {SQL_LINES} SELECT line, count(*) AS n FROM lines GROUP BY 1")
def stream_growing_log(spark, sf_dir):
    """Lines by byte offsets, from a folder to which files come between two triggers."""
    path, out = scratch_path(spark, "growing"), scratch_path(spark, "tail")
    written = lines(spark, sf_dir)
    for part in (F.col("line_no") % 3 != 0, F.col("line_no") % 3 == 0):
        written.where(part).select("line").write.mode("append").text(path)
        drain(growing.tail_growing(spark, path), out)
    return spark.read.parquet(f"{out}/data").groupBy("line").agg(F.count("*").alias("n"))


@query("stream_parse_append", f"WITH {SQL_LINES} SELECT {TIME_CELL} AS timestamp, {RECORD_CELLS} FROM lines")
def stream_parse_append(spark, sf_dir):
    out = scratch_path(spark, "parsed")
    drain(tail.tail_records(spark, rolled_logs(spark, sf_dir)), out)
    return with_auc(spark.read.parquet(f"{out}/data"))


@query("stream_buffered", f"WITH {SQL_LINES}, r AS (SELECT {TYPE_CELL} FROM lines) SELECT metric_type, count(*) AS n FROM r GROUP BY 1")
def stream_buffered(spark, sf_dir):
    """Several micro-batches into one table: of two files each, or of more where many wait."""
    out = scratch_path(spark, "buffered")
    raw = tail.tail_lines(spark, rolled_logs(spark, sf_dir), files_per_batch=2)
    drain(tail.parse_lines(raw), out)
    return spark.read.parquet(f"{out}/data").groupBy("metric_type").agg(F.count("*").alias("n"))


@query("stream_alerts", f"""WITH {SQL_LINES}, r AS (SELECT {STEP_CELLS}, {TYPE_CELL}, {PHASE_CELL}, {EVENT_CELLS} FROM lines)
SELECT metric_type, phase, anomaly_type, anomaly_step, count(*) AS n FROM r
WHERE metric_type IS NOT NULL OR event_nan_loss = 1 OR event_oom = 1 OR event_high_loss = 1 OR phase IS NOT NULL GROUP BY 1, 2, 3, 4""")
def stream_alerts(spark, sf_dir):
    out = scratch_path(spark, "alerts")
    drain(tail.alerts(tail.tail_records(spark, rolled_logs(spark, sf_dir))), out)
    return spark.read.parquet(f"{out}/data").groupBy("metric_type", "phase", "anomaly_type", "anomaly_step").agg(
        F.count("*").alias("n")
    )


@query("stream_counter_rate", f"""WITH {EV}, c AS (
  SELECT run_id, user_id, event_id, us, event_id % 1000 AS bytes,
    lag(event_id % 1000) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS pb,
    lag(us) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS pu FROM ev)
SELECT event_id, bytes, round(CASE WHEN pb IS NULL OR us <= pu THEN 0 WHEN bytes < pb THEN NULL
  ELSE (bytes - pb) / ((us - pu) / 1000000.0) END, 6) AS bytes_rate FROM c""")
def stream_counter_rate(spark, sf_dir):
    """Samples arrive in four parts, each of many files; the stream is stopped and started again between them."""
    whole = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    samples = whole.select(
        F.concat(F.lit("run_"), (F.col("user_id") % 8).cast("string")).alias("run_id"),
        F.col("user_id").alias("host_id"), F.col("ts").alias("timestamp"), "event_id",
        (F.col("event_id") % 1000).alias("bytes"),
    )
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "rates")
    day = F.dayofmonth("timestamp")
    for first, end in ((1, 9), (9, 17), (17, 25), (25, 32)):
        samples.where((day >= first) & (day < end)).repartition(4).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(samples.schema).parquet(inbox)
        counters.stream_counter_rates(
            stream, ["bytes"], out, order=("timestamp", "event_id"), trigger=ONCE, expire=366 * 86_400.0,
        ).awaitTermination()
    return rounded(counters.read_rates(spark, out).select("event_id", "bytes", "bytes_rate"))


@query("stream_slot_counts", f"""WITH {EV} SELECT run_id, date_trunc('hour', timestamp) AS slot, event_type, count(*) AS n FROM ev GROUP BY 1, 2, 3""")
def stream_slot_counts(spark, sf_dir):
    """Two arrivals; the second one brings rows of all days, long after the first has passed them."""
    arrivals, out = scratch_path(spark, "arrivals"), scratch_path(spark, "slots")
    whole = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    schema = "event_id long, timestamp timestamp_ntz, event_type string, run_id string"
    samples = whole.select("event_id", F.col("ts").alias("timestamp"), "event_type",
                           F.concat(F.lit("run_"), (F.col("user_id") % 8).cast("string")).alias("run_id"))
    for late in (F.col("event_id") % 5 != 0, F.col("event_id") % 5 == 0):
        samples.where(late).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(schema).parquet(arrivals)
        tail.slot_partials(stream, out, 3600, trigger=ONCE).awaitTermination()
    return tail.read_slots(spark, out)


@query("stream_closed_slots", f"""WITH {EV}, c AS (SELECT run_id, date_trunc('hour', timestamp) AS slot, event_type, count(*) AS n FROM ev GROUP BY 1, 2, 3)
SELECT * FROM c WHERE slot + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM ev) - INTERVAL 10 MINUTE""")
def stream_closed_slots(spark, sf_dir):
    """Closed windows only: append mode gives a window out once the watermark has passed it."""
    out = scratch_path(spark, "slots")
    drain(tail.slot_counts(stream_events(spark, sf_dir), 3600), out)
    return spark.read.parquet(f"{out}/data")
