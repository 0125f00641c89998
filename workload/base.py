"""Query registry and the telemetry roles that the driver tables play.

Every query has a Spark function and, where possible, DuckDB SQL that computes
the same result from the same tables in a different way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefuse.functions.timeops import floor_us, from_micros, micros

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

HOUR = 3600.0
HOUR_US = 3_600_000_000
TEN_MINUTES_US = 600_000_000
# Small enough that the month of test data spans many blocks.
BLOCK_SLOTS = 48


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def keep(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines' summation orders give one value."""
    return df.selectExpr(*[
        f"round(`{c}`, {digits}) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes
    ])


# --- events as telemetry -----------------------------------------------------

EV = """ev AS (
  SELECT event_id, ts AS timestamp, epoch_us(ts) AS us, 'run_' || (user_id % 8) AS run_id,
         user_id, event_type, value, floor(value * 10) AS m, floor(value) AS p,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("timestamp"),
        F.concat(F.lit("run_"), (F.col("user_id") % 8).cast("string")).alias("run_id"),
        "user_id", "event_type", "value",
        F.floor(F.col("value") * 10).cast("double").alias("m"),
        F.floor("value").cast("double").alias("p"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def ten_minutes(ts: str = "timestamp") -> Column:
    return from_micros(floor_us(micros(ts), TEN_MINUTES_US))


TEN = f"make_timestamp(us - us % {TEN_MINUTES_US})"


def devices(ev: DataFrame) -> DataFrame:
    total = F.when(F.col("k") == 0, 0).otherwise(32_768).cast("long")
    used = F.floor(F.col("value") * 80).cast("long")
    return ev.select(
        "run_id", ten_minutes().alias("timestamp"), (F.col("user_id") % 4).cast("int").alias("gpu_id"),
        F.least(F.col("p"), F.lit(100.0)).alias("utilization_gpu"),
        F.col("k").cast("double").alias("utilization_memory"),
        total.alias("memory_total"), used.alias("memory_used"), (total - used).alias("memory_free"),
        F.floor(F.col("k") / 2).cast("double").alias("memory_percent"),
        (F.col("k") + 30).cast("double").alias("temperature"), F.col("m").alias("power_draw"),
    )


def sql_devices(source: str = "ev", name: str = "dev") -> str:
    total = "CASE WHEN k = 0 THEN 0 ELSE 32768 END"
    used = "CAST(floor(value * 80) AS BIGINT)"
    return f"""{name} AS (
  SELECT run_id, {TEN} AS timestamp, user_id % 4 AS gpu_id, least(p, 100.0) AS utilization_gpu,
         CAST(k AS DOUBLE) AS utilization_memory, CAST({total} AS BIGINT) AS memory_total,
         {used} AS memory_used, CAST({total} AS BIGINT) - {used} AS memory_free,
         CAST(k // 2 AS DOUBLE) AS memory_percent, CAST(k + 30 AS DOUBLE) AS temperature,
         m AS power_draw
  FROM {source})"""


def hosts(ev: DataFrame) -> DataFrame:
    return ev.select(
        "run_id", "timestamp", F.col("p").alias("cpu_percent"),
        F.col("k").cast("double").alias("memory_percent"),
        ((F.col("k") + F.col("user_id")) % 100).cast("double").alias("disk_percent"),
        F.when(F.col("k") % 4 != 0, F.concat(F.lit("s"), (F.col("k") % 5).cast("string"))).alias("state"),
    )


def sql_hosts(source: str = "ev", name: str = "host") -> str:
    return f"""{name} AS (
  SELECT run_id, timestamp, us, p AS cpu_percent, CAST(k AS DOUBLE) AS memory_percent,
         CAST((k + user_id) % 100 AS DOUBLE) AS disk_percent,
         CASE WHEN k % 4 <> 0 THEN 's' || (k % 5) END AS state
  FROM {source})"""


def records(ev: DataFrame) -> DataFrame:
    k = F.col("k")
    return ev.select(
        "run_id", ten_minutes().alias("timestamp"), F.col("event_id").alias("line_no"),
        F.when(k % 3 == 0, F.lit("training_step")).when(k % 3 == 1, F.lit("evaluation"))
        .alias("metric_type"),
        F.col("event_id").alias("step"),
        F.when(k % 10 != 9, F.col("m")).alias("loss"),
        F.when(k % 10 != 8, k.cast("double")).alias("learning_rate"),
        F.col("p").alias("throughput"), (k * 2).cast("double").alias("step_time"),
        F.when(k % 10 != 7, F.col("m")).alias("eval_loss"), k.cast("double").alias("eval_accuracy"),
        F.when(F.col("event_type") == "error", 1).alias("event_error"),
        F.when(k >= 97, 1).alias("event_warning"),
    )


def sql_records(source: str = "ev", name: str = "rec") -> str:
    return f"""{name} AS (
  SELECT run_id, {TEN} AS timestamp, event_id AS line_no,
         CASE k % 3 WHEN 0 THEN 'training_step' WHEN 1 THEN 'evaluation' END AS metric_type,
         event_id AS step, CASE WHEN k % 10 <> 9 THEN m END AS loss,
         CASE WHEN k % 10 <> 8 THEN CAST(k AS DOUBLE) END AS learning_rate,
         p AS throughput, CAST(k * 2 AS DOUBLE) AS step_time,
         CASE WHEN k % 10 <> 7 THEN m END AS eval_loss, CAST(k AS DOUBLE) AS eval_accuracy,
         CASE WHEN event_type = 'error' THEN 1 END AS event_error,
         CASE WHEN k >= 97 THEN 1 END AS event_warning
  FROM {source})"""


def routed(ev: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each event goes to one source by its type; together they use the whole table."""
    kind = F.col("event_type")
    return (
        devices(ev.where(kind.isin("view", "click"))),
        hosts(ev.where(kind == "purchase")),
        records(ev.where(kind.isin("signup", "error"))),
    )


def routed_two(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each event goes to the host or to the log; there are no devices."""
    log = F.col("event_type").isin("signup", "error")
    return hosts(ev.where(~log)), records(ev.where(log))


SQL_ROUTED_TWO = ",\n".join([
    EV,
    "ev_host AS (SELECT * FROM ev WHERE event_type NOT IN ('signup', 'error'))",
    "ev_rec AS (SELECT * FROM ev WHERE event_type IN ('signup', 'error'))",
    sql_hosts("ev_host"), sql_records("ev_rec"),
])
SQL_ROUTED = ",\n".join([
    EV,
    "ev_dev AS (SELECT * FROM ev WHERE event_type IN ('view', 'click'))",
    "ev_host AS (SELECT * FROM ev WHERE event_type = 'purchase')",
    "ev_rec AS (SELECT * FROM ev WHERE event_type IN ('signup', 'error'))",
    sql_devices("ev_dev"), sql_hosts("ev_host"), sql_records("ev_rec"),
])

DEVICE_COLUMNS = [
    "gpu_utilization_gpu", "gpu_utilization_memory", "gpu_memory_percent", "gpu_temperature",
    "gpu_memory_total", "gpu_memory_used", "gpu_memory_free", "gpu_power_draw", "gpu_gpu_count",
]
HOST_NUMBERS = ["sys_cpu_percent", "sys_memory_percent", "sys_disk_percent"]
RECORD_NUMBERS = [
    "train_step", "train_loss", "train_learning_rate", "train_throughput", "train_step_time",
    "eval_loss", "eval_accuracy",
]
EVENT_COLUMNS = ["event_error", "event_warning"]


def sql_device_rollup(source: str = "dev", name: str = "dev_roll") -> str:
    means = ", ".join(f"avg({c}) AS gpu_{c}" for c in
                      ("utilization_gpu", "utilization_memory", "memory_percent", "temperature"))
    sums = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS gpu_{c}" for c in
                     ("memory_total", "memory_used", "memory_free"))
    return f"""{name} AS (
  SELECT run_id, timestamp, {means}, {sums}, coalesce(sum(power_draw), 0) AS gpu_power_draw,
         count(DISTINCT gpu_id) AS gpu_gpu_count
  FROM {source} GROUP BY run_id, timestamp)"""


def sql_record_rollup(source: str = "rec", name: str = "rec_roll") -> str:
    step, evaluation = "metric_type = 'training_step'", "metric_type = 'evaluation'"
    return f"""{name} AS (
  SELECT run_id, timestamp,
    max(step) FILTER ({step}) AS train_step,
    arg_max(loss, line_no) FILTER ({step} AND loss IS NOT NULL) AS train_loss,
    arg_max(learning_rate, line_no) FILTER ({step} AND learning_rate IS NOT NULL) AS train_learning_rate,
    avg(throughput) FILTER ({step}) AS train_throughput,
    avg(step_time) FILTER ({step}) AS train_step_time,
    arg_max(eval_loss, line_no) FILTER ({evaluation} AND eval_loss IS NOT NULL) AS eval_loss,
    arg_max(eval_accuracy, line_no) FILTER ({evaluation} AND eval_accuracy IS NOT NULL) AS eval_accuracy,
    max(event_error) AS event_error, max(event_warning) AS event_warning
  FROM {source} GROUP BY run_id, timestamp)"""


def sql_round(us: str, g: int = HOUR_US) -> str:
    return (f"(CASE WHEN 2 * (({us}) % {g}) > {g} OR (2 * (({us}) % {g}) = {g} AND (({us}) // {g}) % 2 = 1) "
            f"THEN (({us}) // {g} + 1) * {g} ELSE (({us}) // {g}) * {g} END)")


def sql_ceil(us: str, g: int = HOUR_US) -> str:
    return f"((({us}) + {g} - 1) // {g} * {g})"


def sql_slots(source: str, name: str, numbers: list[str], texts: tuple[str, ...] = ()) -> str:
    cells = [f"avg({c}) AS {c}" for c in numbers]
    cells += [f"arg_max({c}, timestamp) FILTER ({c} IS NOT NULL) AS {c}" for c in texts]
    return f"""{name} AS (
  SELECT run_id, {sql_round('epoch_us(timestamp)')} AS slot, {', '.join(cells)}
  FROM {source} GROUP BY 1, 2)"""


SQL_HOST_ROLLUP = ("host_roll AS (SELECT run_id, timestamp, cpu_percent AS sys_cpu_percent,"
                   " memory_percent AS sys_memory_percent, disk_percent AS sys_disk_percent, state AS sys_state FROM host)")
SQL_ALIGNED = ",\n".join([
    SQL_ROUTED,
    sql_device_rollup(), sql_record_rollup(),
    SQL_HOST_ROLLUP,
    f"""span AS (
  SELECT run_id, min(epoch_us(timestamp)) // {HOUR_US} * {HOUR_US} AS lo, {sql_ceil('max(epoch_us(timestamp))')} AS hi
  FROM (SELECT run_id, timestamp FROM dev UNION ALL SELECT run_id, timestamp FROM host
        UNION ALL SELECT run_id, timestamp FROM rec) GROUP BY run_id)""",
    f"grid AS (SELECT run_id, lo, unnest(range(lo, hi + {HOUR_US}, {HOUR_US})) AS slot FROM span)",
    sql_slots("dev_roll", "dev_slot", DEVICE_COLUMNS),
    sql_slots("host_roll", "host_slot", HOST_NUMBERS, ("sys_state",)),
    sql_slots("rec_roll", "rec_slot", RECORD_NUMBERS + EVENT_COLUMNS),
    """aligned AS (
  SELECT * FROM grid LEFT JOIN dev_slot USING (run_id, slot) LEFT JOIN host_slot USING (run_id, slot)
  LEFT JOIN rec_slot USING (run_id, slot))""",
])

W_BACK = "(PARTITION BY run_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
W_AHEAD = "(PARTITION BY run_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def sql_fill(column: str, zero: bool = True) -> str:
    parts = [f"last_value({column} IGNORE NULLS) OVER {W_BACK}",
             f"first_value({column} IGNORE NULLS) OVER {W_AHEAD}"]
    return f"coalesce({', '.join(parts + (['0'] if zero else []))}) AS {column}"


def sql_filled(event_fill: str = "zero", name: str = "filled") -> str:
    numbers = DEVICE_COLUMNS + HOST_NUMBERS + RECORD_NUMBERS
    cells = [sql_fill(c) for c in numbers] + [sql_fill("sys_state", zero=False)]
    cells += [sql_fill(c) if event_fill == "carry" else f"coalesce({c}, 0) AS {c}" for c in EVENT_COLUMNS]
    return f"{name} AS (SELECT run_id, slot, lo, {', '.join(cells)} FROM aligned)"


def r6(column: str, alias: str | None = None) -> str:
    return f"round({column}, 6) AS {alias or column}"
