"""Alert rules on a series: thresholds that hold, losses that stop improving."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefuse.functions.timeops import from_micros, us_of
from tidefuse.operators.align import SLOT, run_key
from tidefuse.operators.blocks import BLOCK, DEFAULT_BLOCK_SLOTS, scan, step_block
from tidefuse.operators.fill import slot_series


@dataclass(frozen=True)
class HeldThreshold:
    """A bound that must be crossed for ``seconds`` without a break."""

    name: str
    column: str
    bound: float
    seconds: float
    above: bool = True

    def crossed(self) -> Column:
        value = F.col(self.column)
        hit = value > self.bound if self.above else value < self.bound
        return F.coalesce(hit & ~F.isnan(value.cast("double")), F.lit(False))


# Default device and host rules.
DEFAULT_RULES = (
    HeldThreshold("gpu_high_temperature", "gpu_temperature", 85, 10),
    HeldThreshold("gpu_high_memory_usage", "gpu_memory_percent", 95, 5),
    HeldThreshold("gpu_low_utilization", "gpu_utilization_gpu", 5, 30, above=False),
    HeldThreshold("sys_high_cpu_usage", "sys_cpu_percent", 90, 10),
    HeldThreshold("sys_high_memory_usage", "sys_memory_percent", 95, 5),
    HeldThreshold("sys_high_disk_usage", "sys_disk_percent", 95, 1),
)


def sustained_thresholds(
    series: DataFrame,
    rules: Sequence[HeldThreshold],
    granularity: float,
    block_slots: int = DEFAULT_BLOCK_SLOTS,
) -> DataFrame:
    """Stretches in which a rule held long enough, with the time its alert fires.

    ``series`` is an aligned grid that is not filled: an empty slot breaks a
    stretch. A stretch is named by the last slot before it that broke the rule.
    """
    columns = list(dict.fromkeys(r.column for r in rules))
    tested = slot_series(series.select("run_id", "timestamp", *columns), granularity, block_slots)
    tested = tested.withColumns({f"_on{i}": r.crossed() for i, r in enumerate(rules)}).drop(*columns)
    scanned = scan(
        tested, ["run_id"], [SLOT],
        last={f"_break{i}": F.when(~F.col(f"_on{i}"), F.col(SLOT)) for i in range(len(rules))},
    )
    held = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(us_of(r.seconds)).cast("long").alias("need"),
            F.col(f"_on{i}").alias("on"), F.col(f"_break{i}").alias("since"),
        )
        for i, r in enumerate(rules)
    ])
    hits = scanned.select("run_id", SLOT, F.inline(held)).where("on")
    span = F.max(SLOT) - F.min(SLOT)
    g = us_of(granularity)
    wait = F.col("need") + F.pmod(-F.col("need"), F.lit(g))
    return (
        hits.groupBy("run_id", "rule", "need", "since")
        .agg(F.min(SLOT).alias("_a"), F.max(SLOT).alias("_b"), span.alias("_len"),
             F.count("*").alias("samples"))
        .where(F.col("_len") >= F.col("need"))
        .select(
            "run_id", "rule", from_micros(F.col("_a")).alias("start_ts"),
            from_micros(F.col("_b")).alias("end_ts"),
            from_micros(F.col("_a") + wait).alias("alert_ts"), "samples",
        )
    )


def no_improvement(
    steps: DataFrame, patience: int = 100, step: str = "step", loss: str = "loss",
    block_steps: int = 10_000,
) -> DataFrame:
    """Steps since the running minimum of the loss last fell, and whether it is too long.

    ``steps`` has one row per run and step. A loss that is NaN or missing never improves.
    """
    best = F.when(
        F.col(loss).isNotNull() & ~F.isnan(F.col(loss)),
        F.struct(F.col(loss).alias("loss"), F.col(step).alias("step")),
    )
    blocked = steps.withColumns(
        {"run_id": run_key(), BLOCK: step_block(F.col(step), block_steps)}
    )
    since = F.col(step) - F.col("_best.step")
    return scan(blocked, ["run_id"], [step], low={"_best": best}).select(
        *steps.columns,
        F.col("_best.loss").alias("best_loss"),
        F.col("_best.step").alias("best_step"),
        since.alias("steps_since_best"),
        F.coalesce(since >= patience, F.lit(False)).cast("int").alias("stalled"),
    )
