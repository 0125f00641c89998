"""Time as epoch microseconds: exact integer arithmetic for slots and blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000


def us_of(seconds: float) -> int:
    return int(round(seconds * SECOND))


def micros(ts: Column | str) -> Column:
    """Epoch microseconds of a timestamp (with or without zone; session zone UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_us(us: Column, width: int) -> Column:
    return us - F.pmod(us, F.lit(width))


def ceil_us(us: Column, width: int) -> Column:
    return us + F.pmod(-us, F.lit(width))


def round_us(us: Column, width: int) -> Column:
    """Round to a multiple of ``width``, ties to the even multiple."""
    rest = F.pmod(us, F.lit(width))
    low = us - rest
    odd = F.pmod(low, F.lit(2 * width)) != 0
    up = (2 * rest > width) | ((2 * rest == width) & odd)
    return F.when(up, low + width).otherwise(low)


def block_start(us: Column, width: int) -> Column:
    """First microsecond of the fixed-width block holding ``us``; never null."""
    return F.coalesce(floor_us(us, width), F.lit(0).cast("long"))


def date_features(ts: Column | str) -> dict[str, Column]:
    """Calendar columns of a timestamp."""
    return {"hour": F.hour(ts), "minute": F.minute(ts)}
