"""Roll-up, alignment, fill, features and the matrix on events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefuse.functions import measures, timeops
from tidefuse.operators import align, features, fill, matrix, quality, rollup
from tidefuse.plans.fusion import fused_series, labelled_matrix
from workload.base import (
    BLOCK_SLOTS, DEVICE_COLUMNS, EV, EVENT_COLUMNS, HOST_NUMBERS, HOUR, HOUR_US, RECORD_NUMBERS,
    SQL_ALIGNED, SQL_HOST_ROLLUP, SQL_ROUTED_TWO, TEN, W_AHEAD, W_BACK, devices, events, hosts, query, r6,
    records, rounded, routed, routed_two, sql_devices, sql_device_rollup, sql_filled, sql_hosts,
    sql_record_rollup, sql_records, sql_round, sql_ceil, sql_slots,
)

NUMBERS = DEVICE_COLUMNS + HOST_NUMBERS + RECORD_NUMBERS
SLOT_TS = "make_timestamp(slot) AS timestamp"


def rolled(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    """The three rolled-up sources, and the time span of the raw ones."""
    dev, host, rec = routed(events(spark, sf_dir))
    sources = [rollup.device_rollup(dev, 4), rollup.host_samples(host), rollup.training_rollup(rec, "line_no")]
    return sources, align.time_span([dev, host, rec])


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, span = rolled(spark, sf_dir)
    return align.align(sources, HOUR, BLOCK_SLOTS, span)


def filled(spark: SparkSession, sf_dir: str, event_fill: str = "zero") -> DataFrame:
    sources, span = rolled(spark, sf_dir)
    return fill.fuse(sources, HOUR, event_fill, BLOCK_SLOTS, span)


def derived(spark: SparkSession, sf_dir: str, **columns: str | None) -> DataFrame:
    """Filled series with its lagged columns, made while empty slots unfold."""
    sources, span = rolled(spark, sf_dir)
    return features.fuse_derived(sources, HOUR, "zero", BLOCK_SLOTS, span, **columns)


# --- roll-ups ---------------------------------------------------------------

@query("gpu_rollup", f"""WITH {EV}, {sql_devices()}, {sql_device_rollup()}
SELECT run_id, timestamp, {', '.join(r6(c) for c in DEVICE_COLUMNS)} FROM dev_roll""")
def gpu_rollup(spark, sf_dir):
    return rounded(rollup.device_rollup(devices(events(spark, sf_dir))))


@query("training_rollup", f"""WITH {EV}, {sql_records()}, {sql_record_rollup()}
SELECT run_id, timestamp, {', '.join(r6(c) for c in RECORD_NUMBERS)}, event_error, event_warning FROM rec_roll""")
def training_rollup(spark, sf_dir):
    return rounded(rollup.training_rollup(records(events(spark, sf_dir)), "line_no"))


@query("prefix_rename", f"""WITH {EV}, {sql_hosts()}
SELECT run_id, timestamp, cpu_percent AS sys_cpu_percent, memory_percent AS sys_memory_percent,
       disk_percent AS sys_disk_percent, state AS sys_state FROM host""")
def prefix_rename(spark, sf_dir):
    return rollup.host_samples(hosts(events(spark, sf_dir)))


@query("split_metric_type", f"""WITH {EV}, {sql_records()}
SELECT run_id, line_no, metric_type AS part, CASE metric_type WHEN 'training_step' THEN loss ELSE eval_loss END AS shown_loss
FROM rec WHERE metric_type IS NOT NULL""")
def split_metric_type(spark, sf_dir):
    steps, evals = rollup.split_by_metric_type(records(events(spark, sf_dir)))
    keys = ["run_id", "line_no", F.col("metric_type").alias("part")]
    return steps.select(*keys, F.col("loss").alias("shown_loss")).unionByName(
        evals.select(*keys, F.col("eval_loss").alias("shown_loss"))
    )


@query("slot_dedupe", f"""WITH {EV}, {sql_hosts()}
SELECT run_id, make_timestamp({sql_round('us')}) AS timestamp, round(avg(cpu_percent), 6) AS cpu_percent,
       round(avg(memory_percent), 6) AS memory_percent, round(avg(disk_percent), 6) AS disk_percent,
       arg_max(state, timestamp) FILTER (state IS NOT NULL) AS state
FROM host GROUP BY 1, 2""")
def slot_dedupe(spark, sf_dir):
    return rounded(align.slot_dedupe(hosts(events(spark, sf_dir)), HOUR))


@query("status_counts", f"""WITH {EV}
SELECT run_id, date_trunc('hour', timestamp) AS timestamp, count(*) AS process_count,
       count(*) FILTER (event_type = 'click') AS process_running,
       count(*) FILTER (event_type = 'view') AS process_sleeping
FROM ev GROUP BY 1, 2""")
def status_counts(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "sleeping") \
        .otherwise("zombie")
    hour = timeops.from_micros(timeops.floor_us(timeops.micros("timestamp"), HOUR_US))
    return rollup.status_counts(
        events(spark, sf_dir).select("run_id", hour.alias("timestamp"), status.alias("status"))
    )


@query("gpu_usage_summary", f"""WITH {EV}
SELECT run_id, max(p) AS max_gpu_util, round(avg(p), 6) AS avg_gpu_util, max(m) AS max_gpu_memory,
       max(p) > 50 AS well_used FROM ev GROUP BY 1""")
def gpu_usage_summary(spark, sf_dir):
    samples = events(spark, sf_dir).select(
        "run_id", F.col("p").alias("gpu_util"), F.col("m").alias("gpu_memory_used")
    )
    return rounded(rollup.device_usage(samples))


@query("step_time_summary", f"""WITH {EV}, {sql_records()}
SELECT run_id, count(step_time) AS steps, round(avg(step_time), 6) AS avg_step_time,
       sum(step_time) AS total_time FROM rec GROUP BY 1""")
def step_time_summary(spark, sf_dir):
    return rounded(rollup.step_times(records(events(spark, sf_dir))))


@query("argmax_accuracy", """WITH hit AS (
  SELECT label, CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label THEN 1 ELSE 0 END AS ok
  FROM embeddings)
SELECT label, count(*) AS n, round(avg(ok), 6) AS accuracy FROM hit GROUP BY 1""")
def argmax_accuracy(spark, sf_dir):
    from workload.base import table

    return rounded(rollup.accuracy(table(spark, sf_dir, "embeddings"), "embedding", "label", ["label"]))


@query("core_max", """SELECT vec_id, CAST(coalesce(list_max(embedding), 0) AS DOUBLE) AS busiest,
  CAST(coalesce(list_max(list_filter(embedding, lambda x: x > 2)), 0) AS DOUBLE) AS busiest_hot FROM embeddings""")
def core_max(spark, sf_dir):
    from workload.base import table

    values = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", measures.largest_core(values).alias("busiest"),
        measures.largest_core(F.filter(values, lambda x: x > 2)).alias("busiest_hot"),
    )


# --- grid and alignment -------------------------------------------------------

@query("time_round", f"""WITH {EV}, half AS (SELECT event_id, us - us % {HOUR_US // 2} AS us FROM ev)
SELECT event_id, make_timestamp(us // {HOUR_US} * {HOUR_US}) AS down, make_timestamp({sql_ceil('us')}) AS up,
       make_timestamp({sql_round('us')}) AS nearest FROM half""")
def time_round(spark, sf_dir):
    half = timeops.floor_us(timeops.micros("timestamp"), HOUR_US // 2)
    us = F.col("us")
    return events(spark, sf_dir).select("event_id", half.alias("us")).select(
        "event_id",
        timeops.from_micros(timeops.floor_us(us, HOUR_US)).alias("down"),
        timeops.from_micros(timeops.ceil_us(us, HOUR_US)).alias("up"),
        timeops.from_micros(timeops.round_us(us, HOUR_US)).alias("nearest"),
    )


@query("time_span", f"""WITH {EV}
SELECT run_id, min(t) AS min_ts, max(t) AS max_ts FROM (
  SELECT run_id, timestamp AS t FROM ev UNION ALL SELECT run_id, {TEN} FROM ev) GROUP BY 1""")
def time_span(spark, sf_dir):
    ev = events(spark, sf_dir)
    return align.time_span([hosts(ev), devices(ev)])


@query("time_grid", f"WITH {SQL_ALIGNED} SELECT run_id, {SLOT_TS} FROM grid")
def time_grid(spark, sf_dir):
    return align.time_grid(align.time_span(routed(events(spark, sf_dir))), HOUR, BLOCK_SLOTS)


@query("align_sources", f"""WITH {SQL_ALIGNED}
SELECT run_id, {SLOT_TS}, {', '.join(r6(c) for c in NUMBERS + EVENT_COLUMNS)}, sys_state FROM aligned""")
def align_sources(spark, sf_dir):
    return rounded(aligned(spark, sf_dir))


@query("align_two_sources", f"""WITH {SQL_ROUTED_TWO}, {sql_record_rollup()}, {SQL_HOST_ROLLUP},
{sql_slots("host_roll", "host_slot", HOST_NUMBERS, ("sys_state",))}, {sql_slots("rec_roll", "rec_slot", RECORD_NUMBERS)},
two_span AS (
  SELECT run_id, min(us) // {HOUR_US} * {HOUR_US} AS lo, {sql_ceil('max(us)')} AS hi
  FROM (SELECT run_id, us FROM host UNION ALL SELECT run_id, epoch_us(timestamp) FROM rec) GROUP BY 1),
two AS (SELECT run_id, unnest(range(lo, hi + {HOUR_US}, {HOUR_US})) AS slot FROM two_span)
SELECT run_id, {SLOT_TS}, {', '.join(r6(c) for c in HOST_NUMBERS + RECORD_NUMBERS)}, sys_state
FROM two LEFT JOIN host_slot USING (run_id, slot) LEFT JOIN rec_slot USING (run_id, slot)""")
def align_two_sources(spark, sf_dir):
    """All events as host samples or log records: the device source is absent, the others are aligned all the same."""
    host, rec = routed_two(events(spark, sf_dir))
    sources = [rollup.host_samples(host), rollup.training_rollup(rec, "line_no")]
    out = align.align(sources, HOUR, BLOCK_SLOTS, align.time_span([host, rec]))
    return rounded(out.select("run_id", "timestamp", *HOST_NUMBERS, *RECORD_NUMBERS, "sys_state"))


OUTER_WINDOW = "PARTITION BY run_id ORDER BY timestamp, line_no NULLS FIRST"


@query("outer_fuse", f"""WITH {SQL_ROUTED_TWO}, host10 AS (
  SELECT run_id, make_timestamp(us - us % 600000000) AS timestamp, max(cpu_percent) AS cpu_percent FROM host GROUP BY 1, 2),
joined AS (SELECT run_id, timestamp, cpu_percent, line_no, loss FROM host10 FULL JOIN rec USING (run_id, timestamp))
SELECT run_id, timestamp, line_no,
  coalesce(last_value(cpu_percent IGNORE NULLS) OVER ({OUTER_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(cpu_percent IGNORE NULLS) OVER ({OUTER_WINDOW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS cpu_percent,
  coalesce(last_value(loss IGNORE NULLS) OVER ({OUTER_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(loss IGNORE NULLS) OVER ({OUTER_WINDOW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS loss
FROM joined""")
def outer_fuse(spark, sf_dir):
    host, rec = routed_two(events(spark, sf_dir))
    host10 = host.groupBy(
        "run_id", timeops.from_micros(timeops.floor_us(timeops.micros("timestamp"), 600_000_000)).alias("timestamp")
    ).agg(F.max("cpu_percent").alias("cpu_percent"))
    fused = align.outer_fuse(host10, rec.select("run_id", "timestamp", "line_no", "loss"))
    return fill.fill_rows(fused, ["cpu_percent", "loss"], ["timestamp", "line_no"]).select(
        "run_id", "timestamp", "line_no", "cpu_percent", "loss"
    )


# --- fills ----------------------------------------------------------------------

@query("ffill", f"""WITH {SQL_ALIGNED}
SELECT run_id, {SLOT_TS}, round(last_value(train_loss IGNORE NULLS) OVER {W_BACK}, 6) AS train_loss,
       last_value(sys_state IGNORE NULLS) OVER {W_BACK} AS sys_state FROM aligned""")
def ffill(spark, sf_dir):
    out = fill.forward_fill(aligned(spark, sf_dir), ["train_loss", "sys_state"], HOUR, BLOCK_SLOTS)
    return rounded(out.select("run_id", "timestamp", "train_loss", "sys_state"))


@query("bfill", f"""WITH {SQL_ALIGNED}
SELECT run_id, {SLOT_TS}, round(first_value(train_loss IGNORE NULLS) OVER {W_AHEAD}, 6) AS train_loss,
       first_value(sys_state IGNORE NULLS) OVER {W_AHEAD} AS sys_state FROM aligned""")
def bfill(spark, sf_dir):
    out = fill.backward_fill(aligned(spark, sf_dir), ["train_loss", "sys_state"], HOUR, BLOCK_SLOTS)
    return rounded(out.select("run_id", "timestamp", "train_loss", "sys_state"))


def sql_fill_query(event_fill: str) -> str:
    return f"""WITH {SQL_ALIGNED}, {sql_filled(event_fill)}
SELECT run_id, {SLOT_TS}, {', '.join(r6(c) for c in NUMBERS + EVENT_COLUMNS)}, sys_state FROM filled"""


@query("fill_missing", sql_fill_query("zero"))
def fill_missing(spark, sf_dir):
    return rounded(filled(spark, sf_dir).drop("run_start"))


@query("fill_missing_carry", sql_fill_query("carry"))
def fill_missing_carry(spark, sf_dir):
    """Events carried like numbers, from the aligned grid instead of known slots."""
    return rounded(fill.fill_missing(aligned(spark, sf_dir), HOUR, "carry", BLOCK_SLOTS))


@query("interpolate_linear", f"""WITH {SQL_ALIGNED}, near AS (
  SELECT run_id, slot, train_loss AS x,
    last_value(train_loss IGNORE NULLS) OVER {W_BACK} AS v0,
    last_value(CASE WHEN train_loss IS NOT NULL THEN slot END IGNORE NULLS) OVER {W_BACK} AS t0,
    first_value(train_loss IGNORE NULLS) OVER {W_AHEAD} AS v1,
    first_value(CASE WHEN train_loss IS NOT NULL THEN slot END IGNORE NULLS) OVER {W_AHEAD} AS t1
  FROM aligned)
SELECT run_id, {SLOT_TS}, round(coalesce(x, CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * ((slot - t0) / (t1 - t0)) END, v0, v1), 6) AS train_loss
FROM near""")
def interpolate_linear(spark, sf_dir):
    out = fill.interpolate_linear(aligned(spark, sf_dir), ["train_loss"], HOUR, BLOCK_SLOTS)
    return rounded(out.select("run_id", "timestamp", "train_loss"))


# --- derived features -------------------------------------------------------------

BY_SLOT = "(PARTITION BY run_id ORDER BY slot)"
CHANGE = f"""CASE WHEN lag(train_loss) OVER {BY_SLOT} IS NULL THEN 0
  WHEN lag(train_loss) OVER {BY_SLOT} = 0 AND train_loss > 0 THEN 'Infinity'::DOUBLE
  WHEN lag(train_loss) OVER {BY_SLOT} = 0 THEN 0
  ELSE train_loss / lag(train_loss) OVER {BY_SLOT} - 1 END"""
MOVING = "avg(train_loss) OVER (PARTITION BY run_id ORDER BY slot ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
STEP_RATE = f"coalesce((train_step - lag(train_step) OVER {BY_SLOT}) / 3600.0, 0)"
LEVEL = """CASE WHEN sys_cpu_percent > 0 AND sys_cpu_percent <= 25 THEN 'low'
  WHEN sys_cpu_percent > 25 AND sys_cpu_percent <= 50 THEN 'medium'
  WHEN sys_cpu_percent > 50 AND sys_cpu_percent <= 75 THEN 'high'
  WHEN sys_cpu_percent > 75 AND sys_cpu_percent <= 100 THEN 'critical' END"""
RATIO = "CASE WHEN gpu_memory_total = 0 THEN 0 ELSE gpu_memory_used / gpu_memory_total END"
DERIVED_SQL = f"""derived AS (SELECT *, {STEP_RATE} AS train_step_rate, {CHANGE} AS train_loss_change_rate,
  {MOVING} AS train_loss_moving_avg, {RATIO} AS gpu_memory_utilization_ratio, {LEVEL} AS sys_cpu_load_level,
  event_error + event_warning AS total_anomaly_events, hour(make_timestamp(slot)) AS hour,
  minute(make_timestamp(slot)) AS minute, (slot - lo) / 1000000.0 AS elapsed_seconds FROM filled)"""
SQL_DERIVED = f"WITH {SQL_ALIGNED}, {sql_filled()}, {DERIVED_SQL}"


@query("step_rate", f"{SQL_DERIVED} SELECT run_id, {SLOT_TS}, {r6('train_step_rate')} FROM derived")
def step_rate(spark, sf_dir):
    out = derived(spark, sf_dir, loss=None)
    return rounded(out.select("run_id", "timestamp", "train_step_rate"))


@query("loss_change_rate", f"{SQL_DERIVED} SELECT run_id, {SLOT_TS}, {r6('train_loss_change_rate')} FROM derived")
def loss_change_rate(spark, sf_dir):
    out = derived(spark, sf_dir, step=None)
    return out.select("run_id", "timestamp", F.when(
        F.abs("train_loss_change_rate") == float("inf"), F.col("train_loss_change_rate")
    ).otherwise(F.round("train_loss_change_rate", 6)).alias("train_loss_change_rate"))


@query("loss_moving_avg", f"{SQL_DERIVED} SELECT run_id, {SLOT_TS}, {r6('train_loss_moving_avg')} FROM derived")
def loss_moving_avg(spark, sf_dir):
    out = derived(spark, sf_dir, step=None)
    return rounded(out.select("run_id", "timestamp", "train_loss_moving_avg"))


@query("elapsed_seconds", f"""WITH {EV}
SELECT run_id, event_id, round((us - min(us) OVER (PARTITION BY run_id)) / 1000000.0, 6) AS elapsed_seconds FROM ev""")
def elapsed_seconds(spark, sf_dir):
    out = features.elapsed_seconds(events(spark, sf_dir))
    return rounded(out.select("run_id", "event_id", "elapsed_seconds"))


@query("event_total", f"{SQL_DERIVED} SELECT run_id, {SLOT_TS}, {r6('total_anomaly_events')} FROM derived")
def event_total(spark, sf_dir):
    series = filled(spark, sf_dir)
    total = features.event_total(series).alias("total_anomaly_events")
    return rounded(series.select("run_id", "timestamp", total))


@query("calendar_features", "SELECT event_id, hour(ts) AS hour, minute(ts) AS minute FROM events")
def calendar_features(spark, sf_dir):
    parts = timeops.date_features("timestamp")
    return events(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in parts.items()])


@query("cpu_level", f"WITH {EV}, s AS (SELECT event_id, p AS sys_cpu_percent FROM ev) SELECT event_id, {LEVEL} AS level FROM s")
def cpu_level(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", measures.cpu_level(F.col("p")).alias("level"))


@query("memory_ratio", f"""WITH {EV}, {sql_devices()}
SELECT run_id, gpu_id, timestamp, memory_used, round(CASE WHEN memory_total = 0 THEN 0 ELSE memory_used / memory_total END, 6) AS ratio FROM dev""")
def memory_ratio(spark, sf_dir):
    ratio = measures.ratio(F.col("memory_used"), F.col("memory_total")).alias("ratio")
    return rounded(devices(events(spark, sf_dir)).select("run_id", "gpu_id", "timestamp", "memory_used", ratio))


@query("throughput", f"""WITH {EV}
SELECT event_id, round(CASE WHEN k > 0 THEN m / k ELSE 0 END, 6) AS throughput FROM ev""")
def throughput(spark, sf_dir):
    return rounded(events(spark, sf_dir).select(
        "event_id", measures.throughput(F.col("m"), F.col("k")).alias("throughput")
    ))


@query("unit_convert", f"""WITH {EV}
SELECT event_id, CAST(floor(m * 65536 / 1048576) AS BIGINT) AS mb, CAST(floor(m / 1000) AS BIGINT) AS watts,
  round(CASE WHEN k > 0 THEN p / k * 100 ELSE 0 END, 6) AS percent FROM ev""")
def unit_convert(spark, sf_dir):
    return rounded(events(spark, sf_dir).select(
        "event_id", measures.bytes_to_mb(F.col("m") * 65536).alias("mb"),
        measures.milliwatts_to_watts(F.col("m")).alias("watts"),
        measures.percent_of(F.col("p"), F.col("k")).alias("percent"),
    ))


@query("rolling_features", f"""WITH {SQL_ALIGNED}, {sql_filled()}
SELECT run_id, {SLOT_TS}, round(avg(train_loss) OVER w, 6) AS train_loss_moving_average,
  round(CASE WHEN count(*) OVER w > 1 THEN stddev_samp(train_loss) OVER w END, 4) AS train_loss_standard_deviation,
  round(CASE WHEN first_value(train_loss) OVER w = 0 THEN 0 ELSE train_loss / first_value(train_loss) OVER w - 1 END, 6) AS train_loss_rate_of_change
FROM filled WINDOW w AS (PARTITION BY run_id ORDER BY slot RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW)""")
def rolling_features(spark, sf_dir):
    """The last six hours; on this grid the default of five minutes is a single row."""
    series = filled(spark, sf_dir).select("run_id", "timestamp", "train_loss")
    out = features.rolling_features(series, ["train_loss"], HOUR, 6 * HOUR, BLOCK_SLOTS)
    finite = F.when(F.abs("train_loss_rate_of_change") == float("inf"), 0.0).otherwise(F.col("train_loss_rate_of_change"))
    return out.select(
        "run_id", "timestamp", F.round("train_loss_moving_average", 6).alias("train_loss_moving_average"),
        F.round("train_loss_standard_deviation", 4).alias("train_loss_standard_deviation"),
        F.round(finite, 6).alias("train_loss_rate_of_change"),
    )


@query("rolling_features_long", f"""WITH {SQL_ALIGNED}, {sql_filled()}
SELECT run_id, {SLOT_TS}, round(avg(sys_cpu_percent) OVER w, 6) AS sys_cpu_percent_moving_average,
  round(CASE WHEN count(*) OVER w > 1 THEN stddev_samp(sys_cpu_percent) OVER w END, 4) AS sys_cpu_percent_standard_deviation,
  round(CASE WHEN first_value(train_step) OVER w = 0 THEN 0 ELSE train_step / first_value(train_step) OVER w - 1 END, 6) AS train_step_rate_of_change
FROM filled WINDOW w AS (PARTITION BY run_id ORDER BY slot RANGE BETWEEN 432000000000 PRECEDING AND CURRENT ROW)""")
def rolling_features_long(spark, sf_dir):
    """The last five days, over blocks of two: from running sums."""
    series = filled(spark, sf_dir).select("run_id", "timestamp", "sys_cpu_percent", "train_step")
    out = features.rolling_features(series, ["sys_cpu_percent", "train_step"], HOUR, 120 * HOUR, BLOCK_SLOTS)
    change = F.col("train_step_rate_of_change")
    return out.select(
        "run_id", "timestamp", F.round("sys_cpu_percent_moving_average", 6).alias("sys_cpu_percent_moving_average"),
        F.round("sys_cpu_percent_standard_deviation", 4).alias("sys_cpu_percent_standard_deviation"),
        F.round(F.when(F.abs(change) == float("inf"), 0.0).otherwise(change), 6).alias("train_step_rate_of_change"),
    )


@query("counter_rate", f"""WITH {EV}, c AS (
  SELECT run_id, user_id, event_id, us, CAST(event_id % 1000 AS BIGINT) AS bytes,
    lag(event_id % 1000) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS pb,
    lag(us) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS pu FROM ev)
SELECT event_id, bytes, round(CASE WHEN pb IS NULL OR us <= pu THEN 0 WHEN bytes < pb THEN NULL
  ELSE (bytes - pb) / ((us - pu) / 1000000.0) END, 6) AS bytes_rate FROM c""")
def counter_rate(spark, sf_dir):
    """Users are the sampled hosts; the counter wraps every thousand events."""
    samples = counters(spark, sf_dir)
    out = features.counter_rates(samples, ["bytes"], ["run_id", "host_id"], ["timestamp", "event_id"])
    return rounded(out.select("event_id", "bytes", "bytes_rate"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "run_id", F.col("user_id").alias("host_id"), "timestamp", "event_id",
        (F.col("event_id") % 1000).alias("bytes"),
    )


# --- series and matrix reports -------------------------------------------------------

@query("series_summary", f"""WITH {SQL_ALIGNED}, {sql_filled()}
SELECT run_id, count(*) AS total_records, 22 AS total_features, make_timestamp(min(slot)) AS start_ts,
       make_timestamp(max(slot)) AS end_ts FROM filled GROUP BY 1""")
def series_summary(spark, sf_dir):
    return quality.series_summary(filled(spark, sf_dir).drop("run_start"))


def sql_quality() -> str:
    long = " UNION ALL ".join(
        f"SELECT run_id, slot, '{c}' AS feature, {c} IS NULL AS gone, "
        + (f"CAST({c} AS DOUBLE)" if c in EVENT_COLUMNS else "CAST(NULL AS DOUBLE)") + " AS e FROM aligned"
        for c in [*NUMBERS, *EVENT_COLUMNS, "sys_state"]
    )
    return f"""WITH {SQL_ALIGNED}, long AS ({long})
SELECT run_id, feature, count(*) AS total_records, make_timestamp(min(slot)) AS start_ts, make_timestamp(max(slot)) AS end_ts,
  (max(slot) - min(slot)) / 1000000.0 AS duration_seconds, count(*) FILTER (gone) AS missing,
  round((1 - count(*) FILTER (gone) / count(*)) * 100, 6) AS completeness, round(sum(e), 6) AS events
FROM long GROUP BY 1, 2"""


@query("quality_report", sql_quality())
def quality_report(spark, sf_dir):
    return rounded(quality.quality_report(aligned(spark, sf_dir)))


@query("describe_series", f"""WITH {EV}, long AS (
  SELECT run_id, 'value' AS feature, value AS x FROM ev UNION ALL SELECT run_id, 'k', CAST(k AS DOUBLE) FROM ev)
SELECT run_id, feature, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
  round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75,
  max(x) AS max FROM long GROUP BY 1, 2""")
def describe_series(spark, sf_dir):
    return rounded(quality.describe_series(events(spark, sf_dir), ["value", "k"]))


MATRIX_COLUMNS = [
    *DEVICE_COLUMNS, "gpu_memory_utilization_ratio", *HOST_NUMBERS,
    "train_step", "train_loss", "train_learning_rate", "train_throughput", "train_step_time",
    "train_step_rate", "train_loss_change_rate", "train_loss_moving_avg",
    "eval_loss", "eval_accuracy", *EVENT_COLUMNS, "total_anomaly_events", "elapsed_seconds",
]
CLEAN = ", ".join(
    f"CASE WHEN isfinite({c}) THEN {c} ELSE 0 END AS {c}" if c == "train_loss_change_rate" else c
    for c in MATRIX_COLUMNS
)
SQL_MATRIX = f"""{SQL_DERIVED}, clean AS (
  SELECT run_id, {SLOT_TS}, slot, {CLEAN}, CASE WHEN event_error > 0 OR event_warning > 0 THEN 1 ELSE 0 END AS is_anomaly
  FROM derived)"""


def event_matrix(spark: SparkSession, sf_dir: str, **choices: object) -> DataFrame:
    dev, host, rec = routed(events(spark, sf_dir))
    return labelled_matrix(dev, host, rec, granularity=HOUR, block_slots=BLOCK_SLOTS, device_ids=4, **choices)


@query("feature_matrix", f"""{SQL_MATRIX}
SELECT run_id, timestamp, {', '.join(r6(c) for c in MATRIX_COLUMNS)}, is_anomaly FROM clean""")
def feature_matrix(spark, sf_dir):
    return rounded(event_matrix(spark, sf_dir))


def sql_stats() -> str:
    return f"{SQL_MATRIX}, long AS (" + " UNION ALL ".join(
        f"SELECT run_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM clean" for c in MATRIX_COLUMNS
    ) + """) SELECT run_id, feature, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std,
  round(min(x), 4) AS min, round(max(x), 4) AS max, count(*) FILTER (x IS NULL) AS missing FROM long GROUP BY 1, 2"""


@query("matrix_stats", sql_stats())
def matrix_stats(spark, sf_dir):
    return rounded(matrix.matrix_stats(event_matrix(spark, sf_dir)), 4)


@query("matrix_metadata", f"""{SQL_MATRIX}
SELECT run_id, count(*) AS total_records, {len(MATRIX_COLUMNS)} AS total_features,
  count(*) FILTER (is_anomaly = 1) AS anomaly_count, count(*) FILTER (is_anomaly = 0) AS normal_count,
  round(avg(is_anomaly), 6) AS anomaly_ratio, min(timestamp) AS start_ts, max(timestamp) AS end_ts,
  (max(slot) - min(slot)) / 1000000.0 AS duration_seconds FROM clean GROUP BY 1""")
def matrix_metadata(spark, sf_dir):
    """From the matrix as it was saved."""
    from tidefuse.session import scratch_path

    path = scratch_path(spark, "matrix")
    matrix.save_matrix(event_matrix(spark, sf_dir), path)
    return rounded(spark.read.parquet(f"{path}/metadata"))


@query("clean_nonfinite", f"""WITH {EV}
SELECT event_id, CASE WHEN k % 7 = 0 OR k % 7 = 1 OR k % 7 = 2 OR k % 7 = 3 THEN 0 ELSE value END AS x,
  CASE WHEN k % 7 = 4 THEN '' ELSE event_type END AS word FROM ev""")
def clean_nonfinite(spark, sf_dir):
    k = F.col("k") % 7
    dirty = events(spark, sf_dir).select(
        "event_id",
        F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf"))
        .when(k == 3, None).otherwise(F.col("value")).alias("x"),
        F.when(k != 4, F.col("event_type")).alias("word"),
    )
    return matrix.clean_values(dirty)


@query("narrow_types_profile", """SELECT * FROM (
  SELECT 'event_id' AS feature, CAST(min(event_id) AS DOUBLE) AS min, CAST(max(event_id) AS DOUBLE) AS max,
    CASE WHEN max(event_id) < 255 THEN 'uint8' WHEN max(event_id) < 65535 THEN 'uint16' WHEN max(event_id) < 4294967295 THEN 'uint32' ELSE 'int64' END AS narrow_type FROM events
  UNION ALL SELECT 'delta', min(user_id - 75), max(user_id - 75),
    CASE WHEN min(user_id - 75) > -128 AND max(user_id - 75) < 127 THEN 'int8' WHEN min(user_id - 75) > -32768 AND max(user_id - 75) < 32767 THEN 'int16' ELSE 'int32' END FROM events
  UNION ALL SELECT 'value', min(value), max(value), 'float32' FROM events)""")
def narrow_types_profile(spark, sf_dir):
    ev = events(spark, sf_dir)
    return quality.narrow_types_profile(
        ev.select("event_id", (F.col("user_id") - 75).alias("delta"), "value")
    )


@query("cardinality_profile", """WITH c AS (SELECT count(*) AS n, count(DISTINCT event_type) AS a, count(DISTINCT props) AS b, count(DISTINCT CAST(event_id AS VARCHAR)) AS d FROM events)
SELECT 'event_type' AS feature, a AS n_distinct, round(a / n, 6) AS share, a / n < 0.5 AS is_category FROM c
UNION ALL SELECT 'props', b, round(b / n, 6), b / n < 0.5 FROM c
UNION ALL SELECT 'key', d, round(d / n, 6), d / n < 0.5 FROM c""")
def cardinality_profile(spark, sf_dir):
    from workload.base import table

    ev = table(spark, sf_dir, "events").withColumn("key", F.col("event_id").cast("string"))
    return rounded(quality.cardinality_profile(ev, ["event_type", "props", "key"]))


@query("cardinality_sketch", """WITH e AS (SELECT *, CAST(event_id AS VARCHAR) AS key, CAST(event_id // 2 AS VARCHAR) AS half FROM events),
c AS (SELECT count(*) AS n, count(DISTINCT event_type) AS a, count(DISTINCT key) AS d, count(DISTINCT half) AS h FROM e)
SELECT 'event_type' AS feature, a / n < 0.5 AS is_category FROM c UNION ALL SELECT 'key', d / n < 0.5 FROM c
UNION ALL SELECT 'half', h / n < 0.5 FROM c""")
def cardinality_sketch(spark, sf_dir):
    """From sketches per day, united; the column whose share is at the limit is counted exactly."""
    from workload.base import table

    ev = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("batch_id"), "event_type", F.col("event_id").cast("string").alias("key"),
        F.floor(F.col("event_id") / 2).cast("string").alias("half"))
    columns = ["event_type", "key", "half"]
    return quality.settled_profile(ev, quality.distinct_sketches(ev, columns), columns).select("feature", "is_category")
