"""Roll-ups that bring each source to one row per run and timestamp."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefuse.functions import measures

KEYS = ("run_id", "timestamp")

# How device columns combine over the devices of a timestamp.
DEVICE_MEANS = ("utilization_gpu", "utilization_memory", "memory_percent", "temperature")
DEVICE_SUMS = ("memory_total", "memory_used", "memory_free", "power_draw")
EVAL_MAP = "eval_metrics"
WORD = 64
STEP_COLUMNS = ("step", "loss", "learning_rate", "throughput", "step_time")


def add_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = KEYS) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def device_rollup(samples: DataFrame, device_ids: int | None = None) -> DataFrame:
    """Mean, sum and number of devices per timestamp, columns prefixed ``gpu_``.

    Counting distinct devices costs a second shuffle of all samples. Where ids
    are known to be 0 to ``device_ids - 1``, they are counted as bits in the same
    pass; an id outside then is an error, never a wrong count. Measures that the samples
    lack are left out; samples without device ids are passed through as they are.
    """
    if "gpu_id" not in samples.columns:
        return add_prefix(samples, "gpu_")
    means = [F.avg(c).alias(c) for c in DEVICE_MEANS if c in samples.columns]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DEVICE_SUMS if c in samples.columns]
    if device_ids is None:
        count = F.count_distinct("gpu_id")
    else:
        samples = samples.withColumn("gpu_id", F.expr(
            f"CASE WHEN gpu_id IS NULL OR gpu_id BETWEEN 0 AND {device_ids - 1} THEN gpu_id"
            f" ELSE raise_error('device id not below {device_ids}') END"))
        count = F.expr(" + ".join(
            f"coalesce(bit_count(bit_or(CASE WHEN gpu_id BETWEEN {low} AND {low + WORD - 1}"
            f" THEN shiftleft(1L, CAST(gpu_id - {low} AS INT)) END)), 0)"
            for low in range(0, device_ids, WORD)
        )).cast("long")
    rolled = samples.groupBy(*KEYS).agg(*means, *sums, count.alias("gpu_count"))
    return add_prefix(rolled, "gpu_")


def host_samples(samples: DataFrame) -> DataFrame:
    return add_prefix(samples, "sys_")


def last_known(column: str, order: str) -> str:
    """Aggregate for the last non-null value in file order."""
    return f"max_by(`{column}`, CASE WHEN `{column}` IS NOT NULL THEN `{order}` END)"


def training_rollup(records: DataFrame, order: str) -> DataFrame:
    """One row per timestamp from step, evaluation and event records.

    Conditional aggregates in one pass replace three roll-ups and their joins.
    ``order`` is the column giving the records' order in the log. A map of evaluation
    values (``eval_metrics``) has the last known value of each name.
    """
    if EVAL_MAP in records.columns:
        scalars = training_rollup(records.drop(EVAL_MAP), order)
        maps = last_per_name(records.where(F.col("metric_type") == "evaluation"), EVAL_MAP, order)
        same = F.col("_run").eqNullSafe(F.col("run_id")) & F.col("_time").eqNullSafe(F.col("timestamp"))
        maps = maps.select(F.col("run_id").alias("_run"), F.col("timestamp").alias("_time"), EVAL_MAP)
        return scalars.join(maps, same, "left").drop("_run", "_time")
    kinds = {c: "training_step" for c in STEP_COLUMNS}
    kinds |= {c: "evaluation" for c in records.columns if c.startswith("eval_")}
    tagged = records.selectExpr(*[
        f"CASE WHEN metric_type = '{kinds[c]}' THEN `{c}` END AS `{c}`" if c in kinds else f"`{c}`"
        for c in records.columns
    ])
    parts = [
        "max(step) AS train_step", f"{last_known('loss', order)} AS train_loss",
        f"{last_known('learning_rate', order)} AS train_learning_rate",
        "avg(throughput) AS train_throughput", "avg(step_time) AS train_step_time",
    ]
    for c in records.columns:
        if c.startswith("eval_"):
            parts.append(f"{last_known(c, order)} AS `{c}`")
        elif c.startswith("event_"):
            parts.append(f"max(`{c}`) AS `{c}`")
    return tagged.groupBy(*KEYS).agg(*map(F.expr, parts))


def last_per_name(records: DataFrame, column: str, order: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Maps merged per key: each name with its last non-null value in file order.

    Names are aggregated apart, map-side too, before a key's few names are put together again.
    """
    pairs = records.select(*keys, F.col(order).alias("_order"), F.explode(column).alias("_name", "_value"))
    known = pairs.where(F.col("_value").isNotNull()).groupBy(*keys, "_name").agg(
        F.max_by("_value", "_order").alias("_value"))
    entries = F.sort_array(F.collect_list(F.struct("_name", "_value")))
    return known.groupBy(*keys).agg(F.map_from_entries(entries).alias(column))


def split_by_metric_type(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step records and evaluation records."""
    kind = F.col("metric_type")
    return records.where(kind == "training_step"), records.where(kind == "evaluation")


def status_counts(processes: DataFrame) -> DataFrame:
    """Processes per snapshot: all, running, sleeping."""
    return processes.groupBy(*KEYS).agg(
        F.count("*").alias("process_count"),
        F.count_if(F.col("status") == "running").alias("process_running"),
        F.count_if(F.col("status") == "sleeping").alias("process_sleeping"),
    )


def device_usage(samples: DataFrame, busy: float = 50.0) -> DataFrame:
    """Usage per run: maximum and mean utilisation, peak memory, well used or not."""
    return samples.groupBy("run_id").agg(
        F.max("gpu_util").alias("max_gpu_util"),
        F.avg("gpu_util").alias("avg_gpu_util"),
        F.max("gpu_memory_used").alias("max_gpu_memory"),
        (F.max("gpu_util") > busy).alias("well_used"),
    )


def step_times(steps: DataFrame) -> DataFrame:
    """Number of steps, mean and total step time per run."""
    return steps.groupBy("run_id").agg(
        F.count("step_time").alias("steps"),
        F.coalesce(F.avg("step_time"), F.lit(0.0)).alias("avg_step_time"),
        F.coalesce(F.sum("step_time"), F.lit(0.0)).alias("total_time"),
    )


def accuracy(df: DataFrame, logits: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    hit = (measures.first_maximum(F.col(logits)) == F.col(label)).cast("double")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))
