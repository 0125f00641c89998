"""Sources onto one regular time grid per run.

All sources meet in one aggregation by (run, slot): a union with one column set
replaces a left join per source. The grid itself is not shuffled. Only one
marker row per block goes through the aggregation; inside its block, each known
row is then stretched over the empty slots up to its successor.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefuse.functions.timeops import (
    block_start, ceil_us, floor_us, from_micros, micros, round_us, us_of,
)
from tidefuse.operators.blocks import BLOCK, DEFAULT_BLOCK_SLOTS
from tidefuse.session import require_utc

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
SLOT = "_slot"
RUN_START = "run_start"
_END = "_end"


def is_numeric(kind: str) -> bool:
    return kind.startswith(NUMERIC)


def metric_types(df: DataFrame, skip: Sequence[str] = ()) -> dict[str, str]:
    hidden = {"run_id", "timestamp", BLOCK, SLOT, RUN_START, _END, *skip}
    return {c: t for c, t in df.dtypes if c not in hidden}


def run_key(column: str = "run_id") -> Column:
    """Samples without a run belong to the run with the empty name."""
    return F.coalesce(F.col(column), F.lit("")).alias("run_id")


def time_span(sources: Sequence[DataFrame]) -> DataFrame:
    """First and last timestamp per run over all sources; works on raw samples."""
    times = [s.select(run_key(), "timestamp") for s in sources]
    return (
        reduce(DataFrame.unionAll, times)
        .groupBy("run_id")
        .agg(F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"))
    )


def _blocks_of(span: DataFrame, granularity: float, block_slots: int) -> DataFrame:
    """One row per run and block of its grid: bounds of the slots in the block."""
    g = us_of(granularity)
    width = g * block_slots
    bounds = span.where(F.col("min_ts").isNotNull()).select(
        "run_id",
        floor_us(micros("min_ts"), g).alias("_lo"),
        ceil_us(micros("max_ts"), g).alias("_hi"),
    )
    starts = F.sequence(
        floor_us(F.col("_lo"), width), floor_us(F.col("_hi"), width), F.lit(width)
    )
    return bounds.select("run_id", "_lo", "_hi", F.explode(starts).alias(BLOCK)).select(
        "run_id", BLOCK,
        F.greatest(BLOCK, "_lo").alias(SLOT),
        F.least(F.col(BLOCK) + width, F.col("_hi") + g).alias(_END),
        F.col("_lo").alias("_start"),
    )


def time_grid(
    span: DataFrame, granularity: float, block_slots: int = DEFAULT_BLOCK_SLOTS
) -> DataFrame:
    """All slots from floor(first) to ceil(last) per run.

    Blocks are spread over the cluster before they unfold, so one long run does
    not unfold in one task and no array exceeds a block.
    """
    require_utc(span.sparkSession)
    g = us_of(granularity)
    blocks = _blocks_of(span, granularity, block_slots).repartition("run_id", BLOCK)
    slots = F.explode(F.sequence(F.col(SLOT), F.col(_END) - g, F.lit(g)))
    return blocks.select("run_id", slots.alias("_us")).select(
        "run_id", from_micros(F.col("_us")).alias("timestamp")
    )


def slot_dedupe(
    source: DataFrame, granularity: float, order: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """Round to slots; per slot the mean of numbers and the last of anything else."""
    require_utc(source.sparkSession)
    types = metric_types(source, skip=[c for c in order if c != "timestamp"])
    slotted = source.withColumn(SLOT, round_us(micros("timestamp"), us_of(granularity)))
    rolled = slotted.groupBy(run_key(), SLOT).agg(*_slot_aggregates(types, order))
    return rolled.select("run_id", from_micros(F.col(SLOT)).alias("timestamp"), *types)


def _slot_aggregates(types: dict[str, str], order: Sequence[str]) -> list[Column]:
    position = f"struct({', '.join(order)})" if len(order) > 1 else order[0]
    return [
        F.expr(
            f"avg(`{c}`) AS `{c}`" if is_numeric(t)
            else f"max_by(`{c}`, CASE WHEN `{c}` IS NOT NULL THEN {position} END) AS `{c}`"
        )
        for c, t in types.items()
    ]


def combine(
    sources: Sequence[DataFrame],
    granularity: float,
    block_slots: int = DEFAULT_BLOCK_SLOTS,
    span: DataFrame | None = None,
) -> DataFrame:
    """Known slots of all sources plus one marker per block, unique by (run, slot).

    Sources hold run_id, timestamp and differently named metrics; an absent
    source is simply not given. ``span`` can be given from raw samples, which
    saves a second pass over rolled-up ones.
    """
    if not sources:
        raise ValueError("no source given")
    require_utc(sources[0].sparkSession)
    g = us_of(granularity)
    width = g * block_slots
    types: dict[str, str] = {}
    for source in sources:
        new = metric_types(source)
        twice = sorted(set(types) & set(new))
        if twice:
            raise ValueError(f"columns in more than one source: {twice}")
        types |= new
    slotted = [
        s.where(F.col("timestamp").isNotNull()).select(
            run_key(),
            F.coalesce(round_us(micros("timestamp"), g), F.lit(0)).alias(SLOT),
            "timestamp",
            *metric_types(s),
        )
        for s in sources
    ]
    span = time_span(sources) if span is None else span
    markers = _blocks_of(span.select(run_key(), "min_ts", "max_ts"), granularity, block_slots)
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [*slotted, markers.drop(BLOCK)],
    )
    blocks = F.coalesce(block_start(F.col(SLOT), width), F.lit(0)).alias(BLOCK)
    return rows.groupBy("run_id", blocks, SLOT).agg(
        *_slot_aggregates(types, ["timestamp"]),
        F.max(_END).alias(_END),
        F.max("_start").alias("_start"),
    )


def stretch(
    combined: DataFrame, granularity: float, copied: Sequence[str] = (), zeroed: Sequence[str] = (),
    metrics: Sequence[str] | None = None,
    derived: Callable[[DataFrame], Mapping[str, Column]] | None = None,
) -> DataFrame:
    """Unfold known slots over the empty slots after them.

    Empty slots copy the columns in ``copied``, are 0 in those in ``zeroed``, and
    null in the others. Other columns than ``metrics`` are seen by ``derived`` alone:
    it gives further columns of the unfolded rows, which have their known slot's
    values, the slot (``_us``) and its distance from the known one (``_pos``).
    """
    g = us_of(granularity)
    held = list(metric_types(combined, skip=["_start"]))
    metrics = held if metrics is None else list(metrics)
    named = [f"`{c}`" for c in held]
    known = combined.selectExpr(
        "run_id", BLOCK, SLOT, *named,
        f"lead({SLOT}) OVER (PARTITION BY run_id, {BLOCK} ORDER BY {SLOT}) AS _next",
        f"max({_END}) OVER (PARTITION BY run_id, {BLOCK}) AS _stop",
        f"max(_start) OVER (PARTITION BY run_id, {BLOCK}) AS _start",
    )
    unfolded = known.selectExpr(
        "run_id", BLOCK, "_start", *named,
        f"posexplode(sequence({SLOT}, coalesce(_next, _stop) - {g}L, {g}L)) AS (_pos, _us)",
    )

    def cell(c: str) -> str:
        if c in copied:
            return f"`{c}`"
        empty = " ELSE 0" if c in zeroed else ""
        return f"CASE WHEN _pos = 0 THEN `{c}`{empty} END AS `{c}`"

    more = derived(unfolded) if derived else {}
    return unfolded.select(
        "run_id",
        from_micros(F.col("_us")).alias("timestamp"),
        from_micros(F.col("_start")).alias(RUN_START),
        *[F.expr(cell(c)) for c in metrics],
        *[c.alias(name) for name, c in more.items()],
    )


def align(
    sources: Sequence[DataFrame],
    granularity: float,
    block_slots: int = DEFAULT_BLOCK_SLOTS,
    span: DataFrame | None = None,
) -> DataFrame:
    """Every slot of every run with the metrics of all sources, null where unknown."""
    return stretch(combine(sources, granularity, block_slots, span), granularity).drop(RUN_START)


def outer_fuse(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on run and exact timestamp; duplicates multiply."""
    return left.join(right, ["run_id", "timestamp"], "full")
