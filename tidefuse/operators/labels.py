"""Labels from fault windows and events.

Windows are cut at bucket borders and merged inside each bucket. The pieces of
a bucket do not overlap, so an equi-join on (run, bucket) with a range residual
finds at most one piece per point and never multiplies rows. The optimizer
broadcasts the pieces when they are small and splits hot buckets when not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefuse.functions.timeops import block_start, floor_us, micros, us_of
from tidefuse.operators.align import run_key
from tidefuse.operators.blocks import BLOCK, scan
from tidefuse.operators.fill import is_event

BUCKET_SECONDS = 3600.0
BUCKET_STEPS = 10_000


def _pieces(windows: DataFrame, width: int) -> DataFrame:
    """Disjoint closed pieces [_lo, _hi] per run and bucket."""
    cut = (
        windows.where(F.col("_lo") <= F.col("_hi"))
        .withColumn("_bucket", F.explode(F.sequence(
            floor_us(F.col("_lo"), width), floor_us(F.col("_hi"), width), F.lit(width))))
        .groupBy("run_id", "_bucket", F.greatest("_lo", "_bucket").alias("_lo"))
        .agg(F.max(F.least(F.col("_hi"), F.col("_bucket") + (width - 1))).alias("_hi"))
    )
    in_order = Window.partitionBy("run_id", "_bucket").orderBy("_lo")
    reached = F.max("_hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached.isNull() | (F.col("_lo") > reached), 1).otherwise(0)
    return (
        cut.withColumn("_fresh", fresh)
        .withColumn("_island", F.sum("_fresh").over(in_order))
        .groupBy("run_id", "_bucket", "_island")
        .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        .drop("_island")
    )


def _reach(points: DataFrame, position: Column) -> DataFrame:
    """First and last position of each run; the empty run holds the points without one."""
    return points.groupBy(run_key()).agg(
        F.min(position).cast("long").alias("_first"), F.max(position).cast("long").alias("_last"))


def _clipped(windows: DataFrame, reach: DataFrame) -> DataFrame:
    """Windows (_lo, _hi) cut to their run's points; only an end may be open.

    A window without a start labels nothing, nor does one whose run has no points.
    """
    named = windows.withColumn("run_id", run_key()).where(F.col("_lo").isNotNull())
    return named.join(reach, "run_id").withColumns({
        "_lo": F.greatest("_lo", "_first"), "_hi": F.least("_hi", "_last")}).drop("_first", "_last")


def _flag(points: DataFrame, position: Column, windows: DataFrame, width: int, name: str,
          reach: DataFrame | None = None) -> DataFrame:
    # Windows are clipped first: an open or far end unfolds no further than the run's points.
    reach = _reach(points, position) if reach is None else reach
    pieces = _pieces(_clipped(windows, reach), width).withColumnRenamed("run_id", "_run")
    placed = points.withColumn("_pos", position.cast("long")).withColumn(
        "_at", floor_us(F.col("_pos"), width)
    )
    match = (
        (run_key() == F.col("_run")) & (F.col("_at") == F.col("_bucket"))
        & (F.col("_pos") >= F.col("_lo")) & (F.col("_pos") <= F.col("_hi"))
    )
    return placed.join(pieces, match, "left").select(
        *points.columns, F.col("_lo").isNotNull().cast("int").alias(name)
    )


def label_windows(
    points: DataFrame, windows: DataFrame, name: str = "is_anomaly",
    bucket_seconds: float = BUCKET_SECONDS, span: DataFrame | None = None,
) -> DataFrame:
    """1 where the timestamp lies in a window of its run, both ends included.

    Works for fault windows and for any absolute anomaly periods with run_id,
    start_ts and end_ts. ``span`` (run_id, min_ts, max_ts) saves a second read of
    the points where the runs' times are known. Points and windows without a run
    are those of the empty run.
    """
    spans = windows.select("run_id", micros("start_ts").alias("_lo"), micros("end_ts").alias("_hi"))
    reach = None if span is None else span.select(
        run_key(), micros("min_ts").alias("_first"), micros("max_ts").alias("_last"))
    return _flag(points, micros("timestamp"), spans, us_of(bucket_seconds), name, reach)


def label_steps(
    points: DataFrame, windows: DataFrame, step: str = "train_step", name: str = "is_anomaly",
    bucket_steps: int = BUCKET_STEPS,
) -> DataFrame:
    """1 where the step lies in [start_step, end_step) of a window of its run."""
    closed = windows.where(F.col("end_step").isNotNull()).select(
        "run_id", F.col("start_step").alias("_lo"), (F.col("end_step") - 1).alias("_hi")
    )
    opened = (
        windows.where(F.col("end_step").isNull())
        .groupBy(run_key().alias("_run"))
        .agg(F.min("start_step").alias("_from"))
    )
    flagged = _flag(points, F.col(step), closed, bucket_steps, "_in")
    past = F.coalesce(F.col(step) >= F.col("_from"), F.lit(False)).cast("int")
    return (
        flagged.join(opened, run_key() == F.col("_run"), "left")
        .select(*points.columns, F.greatest(F.col("_in"), past).alias(name))
    )


def event_flag(df: DataFrame) -> Column:
    """1 where any event column is positive."""
    hits = [F.coalesce((F.col(c) > 0).cast("int"), F.lit(0)) for c in df.columns if is_event(c)]
    if not hits:
        return F.lit(0)
    return F.greatest(*hits) if len(hits) > 1 else hits[0]


def label_points(df: DataFrame, windows: DataFrame | None = None, span: DataFrame | None = None) -> DataFrame:
    """``is_anomaly`` from fault windows, if any, and events."""
    if windows is None:
        return df.withColumn("is_anomaly", event_flag(df))
    flagged = label_windows(df, windows, "_in_window", span=span)
    return flagged.withColumn(
        "is_anomaly", F.greatest(F.col("_in_window"), event_flag(df))
    ).drop("_in_window")


def fault_coverage(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Points inside the windows of each ``fault_id``, 0 included; windows of one id add up.

    Counts are differences of one running count at the two ends of a window, so
    the work is linear however many windows overlap. A window without an end goes
    to the last point of its run; one without a start, or in a run without points,
    counts none.
    """
    counted = points.groupBy(run_key(), micros("timestamp").alias("_us")).agg(
        F.count("*").alias("_n")
    ).select("run_id", "_us", F.lit(0).alias("_end"), "_n")
    spans = windows.select("run_id", F.col("fault_id").cast("string").alias("fault_id"),
                           micros("start_ts").alias("_lo"), micros("end_ts").alias("_hi"))
    # An end before the start, also by clipping, is no window.
    reach = counted.groupBy("run_id").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    held = _clipped(spans, reach).where("_lo <= _hi")
    ends = held.select("run_id", "fault_id", F.inline(F.array(
        F.struct((F.col("_lo") - 1).alias("_us"), F.lit(1).alias("_end")),
        F.struct(F.col("_hi").alias("_us"), F.lit(2).alias("_end")))))
    # The running count sees each end once, however many windows share it: an hour bounds a block.
    marks = ends.select("run_id", "_us", "_end").distinct().withColumn("_n", F.lit(0).cast("long"))
    blocked = counted.unionByName(marks).withColumn(BLOCK, block_start(F.col("_us"), us_of(BUCKET_SECONDS)))
    running = scan(blocked, ["run_id"], ["_us", "_end"], total={"_sum": F.col("_n")}).where("_end > 0")
    found = ends.join(running.drop("_n"), ["run_id", "_us", "_end"])
    signed = F.when(F.col("_end") == 2, F.col("_sum")).otherwise(-F.col("_sum"))
    none = spans.select(run_key(), "fault_id", F.lit(0).cast("long").alias("_signed"))
    return found.select("run_id", "fault_id", signed.alias("_signed")).unionByName(none).groupBy(
        "run_id", "fault_id").agg(F.sum("_signed").alias("points"))
