"""Fault windows, labels, alerts and augmentation on events.

Faults are the error events: each starts with its event and lasts as many
minutes as its property says, which gives overlaps and zero durations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefuse.functions import measures
from tidefuse.functions.timeops import floor_us, from_micros, micros
from tidefuse.operators import alerts, fill, labels, rollup
from tidefuse.operators import faults as fault_ops
from workload.base import (
    BLOCK_SLOTS, EV, HOUR, SQL_ALIGNED, W_BACK, events, query, r6, rounded, sql_filled,
)
from workload.fusion import CLEAN, DERIVED_SQL, MATRIX_COLUMNS, SLOT_TS, aligned, event_matrix, filled

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01, start of all runs
NEVER = 9_000_000_000_000_000_000


def run_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 86_400_000_000
    return events(spark, sf_dir).groupBy("run_id").agg(
        from_micros(floor_us(micros(F.min("timestamp")), day)).alias("run_start")
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat shape: name, type, delay after the run's start, duration."""
    ev = events(spark, sf_dir)
    kinds = F.element_at(F.array(*map(F.lit, ("nan_loss", "oom", "io_bottleneck", "process_termination"))),
                         (F.col("k") % 4 + 1).cast("int"))
    return ev.where(F.col("event_type") == "error").select(
        "run_id", F.concat(F.lit("fault_"), F.col("event_id").cast("string")).alias("fault_name"),
        kinds.alias("type"), ((micros("timestamp") - EPOCH_US) / 1_000_000.0).alias("delay"),
        (F.col("k") * 60).cast("double").alias("duration"),
    )


SQL_WINDOWS = f"""{EV}, starts AS (SELECT run_id, epoch_us(date_trunc('day', min(timestamp))) AS st FROM ev GROUP BY 1),
fault AS (SELECT run_id, 'fault_' || event_id AS fault_name, event_id,
    CASE k % 4 WHEN 0 THEN 'nan_loss' WHEN 1 THEN 'oom' WHEN 2 THEN 'io_bottleneck' ELSE 'process_termination' END AS fault_type,
    us - {EPOCH_US} AS delay_us, k * 60000000 AS length_us FROM ev WHERE event_type = 'error'),
win AS (SELECT CASE WHEN event_id % 397 <> 2 THEN run_id END AS run_id, fault_name, fault_type,
    CASE WHEN event_id % 397 <> 1 THEN st + delay_us END AS lo, CASE WHEN event_id % 397 = 0 THEN {NEVER}
    ELSE st + delay_us + CASE WHEN length_us > 0 THEN length_us ELSE 10000000 END END AS hi FROM fault JOIN starts USING (run_id))"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all faults; a few have no end, no start or no run."""
    normal = fault_ops.normalize(flat=schedule(spark, sf_dir))
    found = fault_ops.time_windows(normal, run_starts(spark, sf_dir))
    odd = F.substring("fault_name", 7, 20).cast("long") % 397
    return found.withColumns({
        "end_ts": F.when(odd != 0, F.col("end_ts")), "start_ts": F.when(odd != 1, F.col("start_ts")),
        "run_id": F.when(odd != 2, F.col("run_id"))})


@query("label_fault_windows", f"""WITH {SQL_WINDOWS}
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM win WHERE win.run_id = ev.run_id AND us BETWEEN lo AND hi) THEN 1 ELSE 0 END AS is_anomaly
FROM ev""")
def label_fault_windows(spark, sf_dir):
    return labels.label_windows(events(spark, sf_dir), windows(spark, sf_dir)).select("event_id", "is_anomaly")


@query("label_margins", f"""WITH {SQL_WINDOWS}
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM win WHERE win.run_id = ev.run_id AND us BETWEEN lo - 5000000 AND hi + 10000000) THEN 1 ELSE 0 END AS is_anomaly
FROM ev""")
def label_margins(spark, sf_dir):
    widened = fault_ops.widen(windows(spark, sf_dir))
    return labels.label_windows(events(spark, sf_dir), widened).select("event_id", "is_anomaly")


@query("label_periods", f"""WITH {EV}, period AS (
  SELECT 'run_' || (o_orderkey % 8) AS run_id, epoch_us(o_orderdate) + (o_custkey % 24) * 3600000000 AS lo, o_orderdate FROM orders),
moved AS (SELECT run_id, (lo - epoch_us(o_orderdate)) + {EPOCH_US} + (epoch_us(o_orderdate) // 86400000000 % 30) * 86400000000 AS lo FROM period)
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM moved WHERE moved.run_id = ev.run_id AND us BETWEEN lo AND lo + 90000000) THEN 1 ELSE 0 END AS is_anomaly
FROM ev""")
def label_periods(spark, sf_dir):
    """Absolute anomaly periods: ninety seconds per order, moved into the month of the events."""
    from workload.base import table

    day = F.floor(micros("o_orderdate") / 86_400_000_000).cast("long") % 30
    start = F.lit(EPOCH_US) + day * 86_400_000_000 + (F.col("o_custkey") % 24) * 3_600_000_000
    periods = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), (F.col("o_orderkey") % 8).cast("string")).alias("run_id"),
        from_micros(start).alias("start_ts"), from_micros(start + 90_000_000).alias("end_ts"),
    )
    return labels.label_windows(events(spark, sf_dir), periods).select("event_id", "is_anomaly")


def step_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    k = F.col("k")
    return ev.where((F.col("event_type") == "error") & (k % 10 == 0)).select(
        "run_id", F.when((k == 90) & (F.col("event_id") > 5000), "non_convergence").otherwise("nan_loss").alias("fault_type"),
        F.col("event_id").alias("injection_step"), F.when(k != 0, k).cast("double").alias("duration"),
    )


SQL_STEPS = f"""{EV}, sw AS (SELECT run_id, event_id AS s,
  CASE WHEN k = 90 AND event_id > 5000 THEN 9223372036854775807 ELSE event_id + CASE WHEN k = 0 THEN 5 ELSE k END END AS e
  FROM ev WHERE event_type = 'error' AND k % 10 = 0)"""


@query("label_step_windows", f"""WITH {SQL_STEPS}
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM sw WHERE sw.run_id = ev.run_id AND event_id >= s AND event_id < e) THEN 1 ELSE 0 END AS is_anomaly
FROM ev""")
def label_step_windows(spark, sf_dir):
    stepped = fault_ops.step_windows(fault_ops.normalize(step_based=step_schedule(spark, sf_dir)))
    return labels.label_steps(events(spark, sf_dir), stepped, "event_id").select("event_id", "is_anomaly")


@query("fault_coverage", f"""WITH {SQL_WINDOWS}
SELECT coalesce(win.run_id, '') AS run_id, substr(fault_name, 1, 9) AS fault_id, count(event_id) AS points FROM win
LEFT JOIN ev ON ev.run_id = win.run_id AND us BETWEEN lo AND hi GROUP BY 1, 2""")
def fault_coverage(spark, sf_dir):
    """Faults whose names begin alike share an id, so their windows add up."""
    named = windows(spark, sf_dir).withColumn("fault_id", F.substring("fault_name", 1, 9))
    return labels.fault_coverage(events(spark, sf_dir), named)


@query("label_events", f"""WITH {SQL_WINDOWS}, {SQL_ALIGNED.removeprefix(EV + ',')}, {sql_filled()}
SELECT run_id, make_timestamp(slot) AS timestamp, CASE WHEN event_error > 0 OR event_warning > 0 OR EXISTS (
  SELECT 1 FROM win WHERE win.run_id = filled.run_id AND slot BETWEEN win.lo AND win.hi) THEN 1 ELSE 0 END AS is_anomaly
FROM filled""")
def label_events(spark, sf_dir):
    """Union of window and event labels on the filled series."""
    out = labels.label_points(filled(spark, sf_dir), windows(spark, sf_dir))
    return out.select("run_id", "timestamp", "is_anomaly")


@query("labelled_matrix", f"""WITH {SQL_WINDOWS}, {SQL_ALIGNED.removeprefix(EV + ',')}, {sql_filled()}, {DERIVED_SQL}, clean AS (
  SELECT run_id, {SLOT_TS}, {CLEAN}, CASE WHEN event_error > 0 OR event_warning > 0 OR EXISTS (SELECT 1 FROM win
    WHERE win.run_id = derived.run_id AND slot BETWEEN win.lo - 5000000 AND win.hi + 10000000) THEN 1 ELSE 0 END AS is_anomaly,
  avg(gpu_power_draw) OVER w AS gpu_power_draw_moving_average,
  CASE WHEN count(*) OVER w > 1 THEN stddev_samp(gpu_power_draw) OVER w ELSE 0 END AS gpu_power_draw_standard_deviation
  FROM derived WINDOW w AS (PARTITION BY run_id ORDER BY slot RANGE BETWEEN 10800000000 PRECEDING AND CURRENT ROW))
SELECT run_id, timestamp, {', '.join(r6(c) for c in MATRIX_COLUMNS)}, round(gpu_power_draw_moving_average, 4) AS gpu_power_draw_moving_average,
  round(gpu_power_draw_standard_deviation, 4) AS gpu_power_draw_standard_deviation, is_anomaly FROM clean""")
def labelled_matrix(spark, sf_dir):
    """The whole way with fault windows, their margins and rolling features."""
    out = event_matrix(spark, sf_dir, windows=windows(spark, sf_dir), margins=(5.0, 10.0), rolling=["gpu_power_draw"], window=3 * HOUR)
    rolled = ["gpu_power_draw_moving_average", "gpu_power_draw_standard_deviation"]
    return rounded(out.drop("gpu_power_draw_rate_of_change").withColumns({c: F.round(c, 4) for c in rolled}))


@query("fault_normalize", f"""WITH {EV}, f AS (SELECT * FROM ev WHERE event_type = 'error')
SELECT run_id, 'fault_' || event_id AS fault_name,
  CASE k % 4 WHEN 0 THEN 'nan_loss' WHEN 1 THEN 'oom' WHEN 2 THEN 'io_bottleneck' ELSE 'process_termination' END AS fault_type,
  'time' AS basis, round((us - {EPOCH_US}) / 1000000.0, 6) AS delay, CAST(NULL AS BIGINT) AS injection_step,
  CAST(k * 60 AS DOUBLE) AS duration FROM f
UNION ALL SELECT run_id, CASE WHEN k = 90 AND event_id > 5000 THEN 'non_convergence' ELSE 'nan_loss' END,
  CASE WHEN k = 90 AND event_id > 5000 THEN 'non_convergence' ELSE 'nan_loss' END, 'step', NULL, event_id,
  CASE WHEN k <> 0 THEN CAST(k AS DOUBLE) END FROM f WHERE k % 10 = 0
UNION ALL SELECT CASE WHEN event_type = 'click' THEN run_id END, 'io_bottleneck', 'io_bottleneck', 'time', CAST(k AS DOUBLE), NULL,
  CASE WHEN event_type = 'click' THEN 60.0 END FROM ev WHERE event_type IN ('click', 'purchase')
UNION ALL SELECT run_id, event_type, 'oom', 'time', CAST(k + 1 AS DOUBLE), NULL, 30.0 FROM ev WHERE event_type IN ('view', 'signup')""")
def fault_normalize(spark, sf_dir):
    """All events as faults of four shapes; purchases name neither a run nor a duration."""
    ev = events(spark, sf_dir)
    named = F.col("event_type") == "click"
    timed = ev.where(F.col("event_type").isin("click", "purchase")).select(
        F.when(named, F.col("run_id")).alias("run_id"), F.lit("io_bottleneck").alias("fault_type"),
        F.col("k").cast("double").alias("injection_time"), F.when(named, 60.0).alias("duration"),
    )
    listed = ev.where(F.col("event_type").isin("view", "signup")).select(
        "run_id", F.col("event_type").alias("fault_name"), F.lit("oom").alias("fault_type"),
        (F.col("k") + 1).cast("double").alias("delay"), F.lit(30.0).alias("duration"),
    )
    normal = fault_ops.normalize(schedule(spark, sf_dir), step_schedule(spark, sf_dir), timed, listed)
    return rounded(normal.drop("params"))


@query("faults_by_type", f"""WITH {SQL_WINDOWS}
SELECT run_id, fault_name, fault_type, round(delay_us / 1000000.0, 6) AS delay FROM fault WHERE fault_type = 'io_bottleneck'""")
def faults_by_type(spark, sf_dir):
    normal = fault_ops.normalize(flat=schedule(spark, sf_dir))
    return rounded(fault_ops.faults_of_type(normal, "io_bottleneck").select("run_id", "fault_name", "fault_type", "delay"))


# --- alerts -------------------------------------------------------------------

RULES = (
    alerts.HeldThreshold("sys_high_cpu_usage", "sys_cpu_percent", 5, 2 * HOUR),
    alerts.HeldThreshold("gpu_low_utilization", "gpu_utilization_gpu", 40, 3.5 * HOUR, above=False),
    alerts.HeldThreshold("gpu_high_temperature", "gpu_temperature", 60, HOUR),
)


def sql_held(rule: alerts.HeldThreshold) -> str:
    sign = ">" if rule.above else "<"
    need = int(rule.seconds * 1_000_000)
    wait = -(-need // 3_600_000_000) * 3_600_000_000
    return f"""SELECT run_id, '{rule.name}' AS rule, make_timestamp(min(slot)) AS start_ts, make_timestamp(max(slot)) AS end_ts,
  make_timestamp(min(slot) + {wait}) AS alert_ts, count(*) AS samples FROM (
    SELECT run_id, slot, slot // 3600000000 - row_number() OVER (PARTITION BY run_id ORDER BY slot) AS island
    FROM aligned WHERE {rule.column} {sign} {rule.bound}) GROUP BY run_id, island HAVING max(slot) - min(slot) >= {need}"""


@query("sustained_threshold", f"WITH {SQL_ALIGNED} " + " UNION ALL ".join(map(sql_held, RULES)))
def sustained_threshold(spark, sf_dir):
    return alerts.sustained_thresholds(aligned(spark, sf_dir), RULES, HOUR, BLOCK_SLOTS)


BEFORE = "OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
UPTO = "OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("no_improvement", f"""WITH {EV}, s AS (SELECT run_id, event_id, CASE WHEN k % 11 = 0 THEN NULL ELSE value END AS loss FROM ev),
b AS (SELECT *, min(loss) {BEFORE} AS prior, min(loss) {UPTO} AS best_loss FROM s),
c AS (SELECT *, max(CASE WHEN loss IS NOT NULL AND (prior IS NULL OR loss < prior) THEN event_id END) {UPTO} AS best_step FROM b)
SELECT run_id, event_id AS step, best_loss, best_step, event_id - best_step AS steps_since_best,
  CASE WHEN event_id - best_step >= 500 THEN 1 ELSE 0 END AS stalled FROM c""")
def no_improvement(spark, sf_dir):
    steps = events(spark, sf_dir).select(
        "run_id", F.col("event_id").alias("step"), F.when(F.col("k") % 11 != 0, F.col("value")).alias("loss")
    )
    return alerts.no_improvement(steps, patience=500, block_steps=1000).drop("loss")


@query("loss_anomaly", f"""WITH {EV}
SELECT event_id, CASE WHEN k % 20 < 2 THEN 'nan_loss' WHEN value > 100 THEN 'high_loss' END AS anomaly FROM ev""")
def loss_anomaly(spark, sf_dir):
    loss = F.when(F.col("k") % 20 == 0, float("nan")).when(F.col("k") % 20 == 1, float("inf")).otherwise(F.col("value"))
    return events(spark, sf_dir).select("event_id", measures.loss_anomaly(loss).alias("anomaly"))


# --- augmentation ---------------------------------------------------------------

@query("augment_nan", f"""WITH {EV}
SELECT event_id, k % 100 < 50 AS hit, CASE WHEN k % 100 >= 50 THEN value WHEN user_id % 2 = 0 THEN 'NaN'::DOUBLE ELSE 1e10 END AS loss FROM ev""")
def augment_nan(spark, sf_dir):
    """Draws come from columns here, so that SQL can repeat them; ``draw`` hashes ids."""
    hit, kind = F.col("k") % 100 / 100.0, F.col("user_id") % 2 / 2.0
    return events(spark, sf_dir).select(
        "event_id", (hit < 0.5).alias("hit"), fault_ops.augment_nan(F.col("value"), hit, kind).alias("loss")
    )


@query("augment_spike", f"""WITH {EV}
SELECT event_id, CASE WHEN k % 100 < 70 THEN m * 1000 ELSE m END AS gradient FROM ev""")
def augment_spike(spark, sf_dir):
    hit = (F.col("k") % 100) / 100.0
    return events(spark, sf_dir).select("event_id", fault_ops.augment_spike(F.col("m"), hit).alias("gradient"))


@query("augment_scale", f"""WITH {SQL_STEPS}
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM sw WHERE sw.run_id = ev.run_id AND event_id >= s AND event_id < e)
  THEN m * 1000 ELSE m END AS learning_rate FROM ev""")
def augment_scale(spark, sf_dir):
    stepped = fault_ops.step_windows(fault_ops.normalize(step_based=step_schedule(spark, sf_dir)))
    flagged = labels.label_steps(events(spark, sf_dir), stepped, "event_id", "active")
    scaled = fault_ops.augment_scale(F.col("m"), F.col("active") == 1)
    return flagged.select("event_id", scaled.alias("learning_rate"))


@query("augment_draw")
def augment_draw(spark, sf_dir):
    """Hash draws: hits and their rate per run. The hash is Spark's own, so there is no SQL."""
    draws = events(spark, sf_dir).select("run_id", fault_ops.draw(7, F.col("event_id")).alias("u"))
    return draws.groupBy("run_id").agg(F.count_if(F.col("u") < 0.5).alias("hits"), F.count("*").alias("n"))
