"""Filling gaps in a series: forward, backward, zero, linear."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefuse.functions.timeops import block_start, micros, us_of
from tidefuse.operators.align import (
    SLOT, RUN_START, combine, is_numeric, metric_types, run_key, stretch,
)
from tidefuse.operators.blocks import BLOCK, DEFAULT_BLOCK_SLOTS, range_blocks, scan
from tidefuse.session import require_utc


def slot_series(df: DataFrame, granularity: float, block_slots: int) -> DataFrame:
    """A series that is unique by run and slot, with its block and slot number."""
    require_utc(df.sparkSession)
    us = micros("timestamp")
    return df.withColumn("run_id", run_key()).withColumns(
        {SLOT: us, BLOCK: block_start(us, us_of(granularity) * block_slots)}
    )


def is_event(name: str) -> bool:
    return name.startswith("event_")


def fill_series(df: DataFrame, order: Sequence[str], event_fill: str = "zero",
                skip: Sequence[str] = (), lagged: Sequence[str] = (), recent: Sequence[str] = (),
                depth: int = 10) -> DataFrame:
    """Fill a series that has a block column; see ``fill_missing``.

    Where nothing is known yet, the next known value is the first of the series.
    From the same pass, ``lagged`` numbers also get the filled value of the row before
    (``_before_x``; the first row has its own), and ``recent`` ones the last ``depth`` known
    values (``_recent_x``, see ``scan``) and what stands before any known one (``_first_x``).
    """
    if event_fill not in ("zero", "carry"):
        raise ValueError("event_fill is 'zero' or 'carry'")
    types = metric_types(df, skip=[*order, *skip])
    zeroed = [c for c in types if is_event(c) and event_fill == "zero"]
    carried = [c for c in types if c not in zeroed]
    scanned = scan(
        df, ["run_id"], order,
        last={f"_last_{c}": f"`{c}`" for c in carried},
        first={f"_first_{c}": f"`{c}`" for c in carried},
        previous={f"_prior_{c}": f"`{c}`" for c in lagged},
        recent={f"_recent_{c}": f"CAST(`{c}` AS DOUBLE)" for c in recent}, depth=depth,
        keep_block=True,
    )
    filled = []
    for c in df.columns:
        if c in zeroed:
            filled.append(f"coalesce(`{c}`, 0) AS `{c}`")
        elif c in carried:
            rest = ", 0" if is_numeric(types[c]) else ""
            filled.append(f"coalesce(`_last_{c}`, `_first_{c}`{rest}) AS `{c}`")
        else:
            filled.append(f"`{c}`")
    filled += [f"coalesce(`_prior_{c}`, `_first_{c}`, 0) AS `_before_{c}`" for c in lagged]
    for c in recent:
        filled += [f"`_recent_{c}`", f"CAST(coalesce(`_first_{c}`, 0) AS DOUBLE) AS `_first_{c}`"]
    return scanned.selectExpr(*filled)


def fill_missing(
    df: DataFrame,
    granularity: float,
    event_fill: str = "zero",
    block_slots: int = DEFAULT_BLOCK_SLOTS,
) -> DataFrame:
    """Fill an aligned series: numbers forward, backward, then 0; others without the 0.

    Events are 0 where absent. ``event_fill="carry"`` treats them like any
    number instead, so that one event marks its whole run.
    """
    blocked = slot_series(df, granularity, block_slots)
    return fill_series(blocked, [SLOT], event_fill).select(*df.columns)


def fuse(
    sources: Sequence[DataFrame],
    granularity: float,
    event_fill: str = "zero",
    block_slots: int = DEFAULT_BLOCK_SLOTS,
    span: DataFrame | None = None,
    lagged: Sequence[str] = (),
    recent: Sequence[str] = (),
    depth: int = 10,
    derived: Callable[[DataFrame], Mapping[str, Column]] | None = None,
) -> DataFrame:
    """Aligned and filled series with ``run_start``.

    Equal to ``fill_missing(align(...))``, but gaps are filled on known slots
    only and empty slots are unfolded last. ``derived`` adds columns while slots
    unfold, from what ``fill_series`` knows of the ``lagged`` and ``recent`` ones; the full
    grid is not shuffled for them.
    """
    known = combine(sources, granularity, block_slots, span)
    names = metric_types(known, skip=["_start"])
    filled = fill_series(known, [SLOT], event_fill, ["_start"], [c for c in lagged if c in names],
                         [c for c in recent if c in names], depth)
    copied = [c for c in names if not is_event(c) or event_fill == "carry"]
    return stretch(filled, granularity, copied, zeroed=[c for c in names if c not in copied], metrics=names,
                   derived=derived)


def forward_fill(df: DataFrame, columns: Sequence[str], granularity: float,
                 block_slots: int = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    blocked = slot_series(df, granularity, block_slots)
    return scan(blocked, ["run_id"], [SLOT], last={c: F.col(c) for c in columns}).select(*df.columns)


def backward_fill(df: DataFrame, columns: Sequence[str], granularity: float,
                  block_slots: int = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    blocked = slot_series(df, granularity, block_slots)
    return scan(blocked, ["run_id"], [SLOT], following={c: F.col(c) for c in columns}).select(*df.columns)


def interpolate_linear(df: DataFrame, columns: Sequence[str], granularity: float,
                       block_slots: int = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """Straight line between the known neighbours; the nearest known value at the ends."""
    blocked = slot_series(df, granularity, block_slots)
    here = F.col(SLOT)

    def point(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(here.alias("t"), F.col(c).cast("double").alias("v")))

    scanned = scan(
        blocked, ["run_id"], [SLOT],
        last={f"_a_{c}": point(c) for c in columns},
        following={f"_b_{c}": point(c) for c in columns},
    )

    def line(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        share = F.try_divide((here - a["t"]).cast("double"), (b["t"] - a["t"]).cast("double"))
        return F.coalesce(
            F.col(c).cast("double"), a["v"] + (b["v"] - a["v"]) * share, a["v"], b["v"]
        ).alias(c)

    return scanned.select(*[line(c) if c in columns else F.col(c) for c in df.columns])


def fill_rows(df: DataFrame, columns: Sequence[str], order: Sequence[str],
              keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Fill rows of any density forward, then backward, in the given order."""
    blocked = range_blocks(df, keys, order)
    scanned = scan(
        blocked, keys, order,
        last={f"_last_{c}": F.col(c) for c in columns},
        first={f"_first_{c}": F.col(c) for c in columns},
    )
    return scanned.select(*[
        F.coalesce(f"_last_{c}", f"_first_{c}").alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])
