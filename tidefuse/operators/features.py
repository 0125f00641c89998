"""Derived columns of a filled series."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefuse.functions import measures
from tidefuse.functions.timeops import SECOND, block_start, date_features, micros, us_of
from tidefuse.operators.align import RUN_START, run_key
from tidefuse.operators.blocks import BLOCK, DEFAULT_BLOCK_SLOTS, range_blocks, scan, with_halo
from tidefuse.operators.fill import fuse, is_event
from tidefuse.session import require_utc

MOVING_ROWS = 10


def event_total(df: DataFrame) -> Column:
    """Sum of all event columns of a row, missing as 0."""
    events = [F.coalesce(F.col(c), F.lit(0)) for c in df.columns if is_event(c)]
    return sum(events[1:], events[0]) if events else F.lit(0)


def _looking_back(df: DataFrame, seconds: float, granularity: float, block_slots: int) -> DataFrame:
    require_utc(df.sparkSession)
    us = micros("timestamp")
    keyed = df.withColumn("run_id", run_key()).withColumn("_us", us)
    return with_halo(keyed, F.col("_us"), us_of(granularity) * block_slots, us_of(seconds))


def add_lagged(
    df: DataFrame, granularity: float, block_slots: int = DEFAULT_BLOCK_SLOTS,
    step: str | None = "train_step", loss: str | None = "train_loss",
) -> DataFrame:
    """Step rate, loss change rate and moving mean of the loss on a full grid."""
    halo = _looking_back(df, granularity * (MOVING_ROWS - 1), granularity, block_slots)
    by_block = Window.partitionBy("run_id", BLOCK).orderBy("_us")
    new: dict[str, Column] = {}
    if step:
        diff = (F.col(step) - F.lag(step).over(by_block)).cast("double")
        new["train_step_rate"] = F.coalesce(diff / F.lit(float(granularity)), F.lit(0.0))
    if loss:
        before = F.lag(loss).over(by_block)
        new["train_loss_change_rate"] = measures.change_rate(F.col(loss), before)
        frame = by_block.rowsBetween(1 - MOVING_ROWS, 0)
        new["train_loss_moving_avg"] = F.avg(loss).over(frame)
    return halo.withColumns(new).where("_own").drop("_own", BLOCK, "_us")


def lags_while_unfolding(
    granularity: float, step: str | None = "train_step", loss: str | None = "train_loss", rows: int = MOVING_ROWS,
) -> Callable[[DataFrame], Mapping[str, Column]]:
    """``add_lagged`` for ``fuse``: the same columns from known slots and the few known values before them."""
    g = us_of(granularity)

    def columns(unfolded: DataFrame) -> dict[str, Column]:
        new: dict[str, Column] = {}
        first_row = F.col("_us") == F.col("_start")

        def before(c: str) -> Column:
            return F.when(first_row, None).otherwise(F.when(F.col("_pos") == 0, F.col(f"_before_{c}")).otherwise(F.col(c)))

        if step and step in unfolded.columns:
            diff = (F.col(step) - before(step)).cast("double")
            new["train_step_rate"] = F.coalesce(diff / F.lit(float(granularity)), F.lit(0.0))
        if loss and loss in unfolded.columns:
            new["train_loss_change_rate"] = measures.change_rate(F.col(loss), before(loss))
            # A known value holds from its slot to the next known one: newest first, each adds itself for the
            # slots of the frame that are not yet covered, the value before all known ones adds the rest.
            new["train_loss_moving_avg"] = F.when(
                F.col("_pos") >= rows - 1, F.col(loss).cast("double")).otherwise(F.expr(f"""aggregate(
                  `_recent_{loss}`, struct(CAST(0 AS DOUBLE) AS sum, _us + {g}L AS open),
                  (a, e) -> struct(
                    CASE WHEN a.open > greatest(e.at, _start, _us - {(rows - 1) * g}L) THEN a.sum + e.value
                      * ((a.open - greatest(e.at, _start, _us - {(rows - 1) * g}L)) / {g}L) ELSE a.sum END AS sum,
                    least(a.open, greatest(e.at, _start, _us - {(rows - 1) * g}L)) AS open),
                  a -> CASE WHEN a.open > greatest(_start, _us - {(rows - 1) * g}L) THEN a.sum + `_first_{loss}`
                      * ((a.open - greatest(_start, _us - {(rows - 1) * g}L)) / {g}L) ELSE a.sum END)
                  / ((_us + {g}L - greatest(_start, _us - {(rows - 1) * g}L)) / {g}L)"""))
        return new

    return columns


def fuse_derived(
    sources: Sequence[DataFrame], granularity: float, event_fill: str = "zero",
    block_slots: int = DEFAULT_BLOCK_SLOTS, span: DataFrame | None = None,
    step: str | None = "train_step", loss: str | None = "train_loss",
) -> DataFrame:
    """``fuse`` with the columns of ``add_lagged``, without a pass over the full grid."""
    lagged = list(dict.fromkeys(c for c in (step, loss) if c))
    return fuse(sources, granularity, event_fill, block_slots, span, lagged, [loss] if loss else [], MOVING_ROWS,
                lags_while_unfolding(granularity, step, loss))


def rolling_features(
    df: DataFrame, columns: Sequence[str], granularity: float, seconds: float = 300.0,
    block_slots: int = DEFAULT_BLOCK_SLOTS,
) -> DataFrame:
    """Mean, sample deviation and rate of change over the last ``seconds``, on a full grid.

    A frame up to a block's length is a window over the block and a copy of the rows before
    it; a longer one is the difference of two running sums, so no row is copied.
    """
    if us_of(seconds) > us_of(granularity) * block_slots:
        return _rolling_by_sums(df, columns, granularity, seconds, block_slots)
    halo = _looking_back(df, seconds, granularity, block_slots)
    frame = (
        Window.partitionBy("run_id", BLOCK).orderBy("_us")
        .rangeBetween(-us_of(seconds), Window.currentRow)
    )
    new: dict[str, Column] = {}
    for c in columns:
        first = F.first(c).over(frame)
        new[f"{c}_moving_average"] = F.avg(c).over(frame)
        new[f"{c}_standard_deviation"] = F.stddev_samp(c).over(frame)
        new[f"{c}_rate_of_change"] = measures.change_rate(F.col(c), first)
    return halo.withColumns(new).where("_own").drop("_own", BLOCK, "_us")


def _rolling_by_sums(df: DataFrame, columns: Sequence[str], granularity: float, seconds: float,
                     block_slots: int) -> DataFrame:
    """``rolling_features`` from running counts, sums and squares about the run's mean.

    Values that are no finite numbers are counted apart, as they would spoil every later sum; a
    frame that holds one has neither mean nor deviation (NaN).
    """
    require_utc(df.sparkSession)
    g = us_of(granularity)
    back = us_of(seconds) // g * g
    finite = {c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
              & (F.abs(F.col(c).cast("double")) != float("inf")) for c in columns}
    keyed = df.withColumn("run_id", run_key()).withColumn("_us", micros("timestamp"))
    centres = keyed.groupBy(F.col("run_id").alias("_run")).agg(F.min("_us").alias("_begin"), *[
        F.coalesce(F.avg(F.when(finite[c], F.col(c).cast("double"))), F.lit(0.0)).alias(f"_mid_{c}") for c in columns])
    rows = keyed.join(centres, F.col("run_id") == F.col("_run")).drop("_run").withColumn(
        BLOCK, block_start(F.col("_us"), g * block_slots))
    own: dict[str, Column] = {}
    for c in columns:
        x = F.when(finite[c], F.col(c).cast("double") - F.col(f"_mid_{c}"))
        own |= {f"_n_{c}": finite[c].cast("long"), f"_s_{c}": F.coalesce(x, F.lit(0.0)),
                f"_q_{c}": F.coalesce(x * x, F.lit(0.0)), f"_b_{c}": (F.col(c).isNotNull() & ~finite[c]).cast("long")}
    rows = rows.withColumns(own)
    summed = scan(rows, ["run_id"], ["_us"], total={f"_t{name}": F.col(name) for name in own})
    # What was before the frame's first row, and that row's value, found by its slot.
    begins = summed.select(
        F.col("run_id").alias("_run"), F.col("_us").alias("_at"),
        *[(F.col(f"_t{name}") - F.col(name)).alias(f"_p{name}") for name in own],
        *[F.col(c).alias(f"_v_{c}") for c in columns])
    at = F.greatest(F.col("_us") - back, F.col("_begin"))
    joined = summed.join(begins, (F.col("run_id") == F.col("_run")) & (at == F.col("_at")), "left")
    new: dict[str, Column] = {}
    for c in columns:
        n, s, q, bad = (F.col(f"_t_{k}_{c}") - F.coalesce(F.col(f"_p_{k}_{c}"), F.lit(0)) for k in "nsqb")
        spoiled = F.when(bad > 0, float("nan"))
        new[f"{c}_moving_average"] = F.coalesce(spoiled, F.when(n > 0, F.col(f"_mid_{c}") + s / n))
        new[f"{c}_standard_deviation"] = F.when(n + bad > 1, F.coalesce(
            spoiled, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))))
        new[f"{c}_rate_of_change"] = measures.change_rate(F.col(c), F.col(f"_v_{c}"))
    return joined.select(*df.columns, *[v.alias(k) for k, v in new.items()])


def elapsed_seconds(df: DataFrame) -> DataFrame:
    """Seconds since the first row of the run.

    ``fuse`` hands the start on as a column. Without it, one start row per run
    is joined back; the optimizer broadcasts it when it is small and splits a
    dominant run when it is not.
    """
    if RUN_START in df.columns:
        started = df
    else:
        starts = df.groupBy("run_id").agg(F.min("timestamp").alias(RUN_START))
        started = df.join(starts, "run_id", "left")
    seconds = (micros("timestamp") - micros(RUN_START)) / F.lit(float(SECOND))
    return started.withColumn("elapsed_seconds", seconds).drop(RUN_START)


def add_row_features(df: DataFrame) -> DataFrame:
    """Features that need no other row."""
    new: dict[str, Column] = {}
    if {"gpu_memory_used", "gpu_memory_total"} <= set(df.columns):
        new["gpu_memory_utilization_ratio"] = measures.ratio(
            F.col("gpu_memory_used"), F.col("gpu_memory_total")
        )
    if "sys_cpu_percent" in df.columns:
        new["sys_cpu_load_level"] = measures.cpu_level(F.col("sys_cpu_percent"))
    if any(is_event(c) for c in df.columns):
        new["total_anomaly_events"] = event_total(df)
    return df.withColumns(new | date_features("timestamp"))


def add_derived(
    df: DataFrame, granularity: float, block_slots: int = DEFAULT_BLOCK_SLOTS
) -> DataFrame:
    """All derived features whose inputs are present; those of ``fuse_derived`` are not made again."""
    made = {"train_step_rate", "train_loss_change_rate"} & set(df.columns)
    step = "train_step" if "train_step" in df.columns and not made else None
    loss = "train_loss" if "train_loss" in df.columns and not made else None
    lagged = add_lagged(df, granularity, block_slots, step, loss) if step or loss else df
    return elapsed_seconds(add_row_features(lagged))


def counter_rates(
    samples: DataFrame, counters: Sequence[str], keys: Sequence[str] = ("run_id", "host_id"),
    order: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """Counters to rates per second of real elapsed time, suffix ``_rate``.

    The first sample and samples without elapsed time give 0; a counter that
    went backwards was reset and gives null.
    """
    require_utc(samples.sparkSession)
    blocked = range_blocks(samples, keys, order)
    return rates_from_blocks(blocked, counters, keys, order)


def rates_from_blocks(blocked: DataFrame, counters: Sequence[str], keys: Sequence[str],
                      order: Sequence[str]) -> DataFrame:
    shown = [c for c in blocked.columns if c != BLOCK]
    sample = F.struct(micros("timestamp").alias("us"), *[F.col(c) for c in counters])
    scanned = scan(blocked, keys, order, previous={"_before": sample})
    seconds = (micros("timestamp") - F.col("_before.us")) / F.lit(float(SECOND))

    def rate(c: str) -> Column:
        diff = (F.col(c) - F.col(f"_before.{c}")).cast("double")
        return (
            F.when(F.col("_before").isNull() | (seconds <= 0), F.lit(0.0))
            .when(diff < 0, None)
            .otherwise(F.try_divide(diff, seconds))
            .alias(f"{c}_rate")
        )

    return scanned.select(*shown, *[rate(c) for c in counters])
