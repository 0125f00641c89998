"""Fault schedules: one table from four shapes, windows, and data augmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefuse.functions.timeops import from_micros, micros, us_of

# Window of a fault without duration, steps of one without a length.
INSTANT_SECONDS = 10.0
DEFAULT_STEPS = 5
OPEN_ENDED = ("non_convergence",)

SCHEDULE = {
    "run_id": "string", "fault_name": "string", "fault_type": "string", "basis": "string",
    "delay": "double", "injection_step": "long", "duration": "double",
    "params": "map<string,string>",
}


def normalize(
    flat: DataFrame | None = None,
    step_based: DataFrame | None = None,
    time_based: DataFrame | None = None,
    plan_list: DataFrame | None = None,
) -> DataFrame:
    """One schedule table. ``injection_time`` and ``delay`` mean the same."""
    parts = []
    for basis, source in (("time", flat), ("step", step_based), ("time", time_based), ("time", plan_list)):
        if source is None:
            continue
        have = set(source.columns)
        delays = [F.col(c) for c in ("injection_time", "delay") if c in have]
        kind = F.col("fault_type") if "fault_type" in have else F.col("type")
        values = {
            "run_id": F.col("run_id") if "run_id" in have else F.lit(None),
            "fault_name": F.col("fault_name") if "fault_name" in have else kind,
            "fault_type": kind,
            "basis": F.lit(basis),
            "delay": F.coalesce(*delays, F.lit(0.0)) if basis == "time" else F.lit(None),
            "injection_step": F.col("injection_step") if "injection_step" in have else F.lit(None),
            "duration": F.col("duration") if "duration" in have else F.lit(None),
            "params": F.col("params") if "params" in have else F.lit(None),
        }
        parts.append(source.select(*[values[c].cast(t).alias(c) for c, t in SCHEDULE.items()]))
    if not parts:
        raise ValueError("no schedule given")
    return reduce(DataFrame.unionByName, parts)


def faults_of_type(schedule: DataFrame, fault_type: str) -> DataFrame:
    return schedule.where(F.col("fault_type") == fault_type)


def time_windows(schedule: DataFrame, run_starts: DataFrame) -> DataFrame:
    """Closed windows [start_ts, end_ts] of time-based faults, per run start.

    A fault without a run applies to every run. ``unstarted`` tells the faults
    whose run has no start.
    """
    us = F.lit(1_000_000)
    length = F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.lit(INSTANT_SECONDS))
    begin = micros("run_start") + F.round(F.col("delay") * us).cast("long")
    return (
        every_run(schedule.where(F.col("basis") == "time"), run_starts)
        .join(run_starts, "run_id")
        .withColumn("_begin", begin)
        .select(
            "run_id", "fault_name", "fault_type",
            from_micros(F.col("_begin")).alias("start_ts"),
            from_micros(F.col("_begin") + F.round(length * us).cast("long")).alias("end_ts"),
        )
    )


def every_run(schedule: DataFrame, runs: DataFrame) -> DataFrame:
    """The schedule with each fault that names no run repeated for every run."""
    common = schedule.where("run_id IS NULL").drop("run_id")
    # The product is the meaning: one schedule for all runs.
    repeated = runs.select("run_id").distinct().crossJoin(common).select(*schedule.columns)
    return schedule.where("run_id IS NOT NULL").unionByName(repeated)


def unstarted(schedule: DataFrame, run_starts: DataFrame) -> DataFrame:
    """Time-based faults that name a run without a start; they have no window."""
    named = schedule.where((F.col("basis") == "time") & F.col("run_id").isNotNull())
    return named.join(run_starts.where("run_start IS NOT NULL"), "run_id", "left_anti")


def step_windows(schedule: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Half-open windows [start_step, end_step); no end for open-ended faults.

    Faults without a run apply to every run of ``runs``; without ``runs`` they are an error.
    """
    if runs is None:
        named = F.when(F.col("run_id").isNotNull() | (F.col("basis") != "step"), F.col("run_id"))
        schedule = schedule.withColumn("run_id", F.coalesce(named, F.when(F.col("basis") == "step", F.raise_error(
            F.lit("a fault without a run needs the runs it applies to")))))
    else:
        schedule = every_run(schedule, runs)
    start = F.col("injection_step")
    length = F.coalesce(F.col("duration"), F.lit(DEFAULT_STEPS)).cast("long")
    end = F.when(~F.col("fault_type").isin(*OPEN_ENDED), start + length)
    return schedule.where(F.col("basis") == "step").select(
        "run_id", "fault_name", "fault_type", start.alias("start_step"), end.alias("end_step")
    )


def widen(windows: DataFrame, before: float = 5.0, after: float = 10.0) -> DataFrame:
    """Label margins around fault windows."""
    return windows.withColumns({
        "start_ts": from_micros(micros("start_ts") - us_of(before)),
        "end_ts": from_micros(micros("end_ts") + us_of(after)),
    })


# --- augmentation: what the faults do to measured columns -------------------

DRAWS = 1_000_000


def draw(seed: int, *ids: Column) -> Column:
    """Uniform number in [0, 1) that depends on ids and seed only."""
    return F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(DRAWS)) / F.lit(float(DRAWS))


def augment_nan(value: Column, hit: Column, kind: Column, probability: float = 0.5) -> Column:
    """With a probability replace a value: one half NaN, one half 1e10."""
    broken = F.when(kind < 0.5, F.lit(float("nan"))).otherwise(F.lit(1e10))
    return F.when(hit < probability, broken).otherwise(value)


def augment_spike(value: Column, hit: Column, factor: float = 1000.0,
                  probability: float = 0.7) -> Column:
    return F.when(hit < probability, value * factor).otherwise(value)


def augment_scale(value: Column, active: Column, multiplier: float = 1000.0,
                  too_high: bool = True) -> Column:
    """Learning rate too high or too low while a fault is active."""
    scaled = value * multiplier if too_high else value / multiplier
    return F.when(active, scaled).otherwise(value)
