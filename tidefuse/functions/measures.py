"""Scalar column functions on measured values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
MEGABYTE = 1024 * 1024

# Upper bounds and names of the CPU load levels.
CPU_LEVELS = ((25, "low"), (50, "medium"), (75, "high"), (100, "critical"))

# Fixed value: the word a device query prints for a reading it cannot give.
NOT_SUPPORTED = "[Not Supported]"


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0 or either side is missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100).otherwise(F.lit(0.0))


def cpu_level(percent: Column) -> Column:
    """Right-closed levels over (0, 100]; anything outside is null."""
    level = F.when((percent <= 0) | F.isnan(percent), F.lit(None).cast("string"))
    for bound, name in CPU_LEVELS:
        level = level.when(percent <= bound, F.lit(name))
    return level


def finite(value: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == INF), None).otherwise(value)


def loss_anomaly(loss: Column, explosion: float = 100.0) -> Column:
    """``nan_loss`` for NaN or infinite, ``high_loss`` above the bound, else null."""
    return (
        F.when(F.isnan(loss) | (F.abs(loss) == INF), F.lit("nan_loss"))
        .when(loss > explosion, F.lit("high_loss"))
    )


def throughput(batch_size: Column, seconds: Column) -> Column:
    """Samples per second; 0 for a duration that is not positive."""
    return F.when(seconds > 0, batch_size.cast("double") / seconds).otherwise(F.lit(0.0))


def bytes_to_mb(value: Column) -> Column:
    return F.floor(value / MEGABYTE).cast("long")


def milliwatts_to_watts(value: Column) -> Column:
    return F.floor(value / 1000).cast("long")


def change_rate(value: Column, previous: Column) -> Column:
    """value / previous - 1. 0/0 and a missing side give 0, x/0 gives an infinity."""
    blown = F.when(value > 0, F.lit(INF)).when(value < 0, F.lit(-INF)).otherwise(F.lit(0.0))
    return (
        F.when(value.isNull() | previous.isNull(), F.lit(0.0))
        .when(previous == 0, blown)
        .otherwise(F.try_divide(value, previous) - 1)
    )


def supported_number(text: Column, kind: str) -> Column:
    """Number in a device query field; the not-supported word reads as 0."""
    return F.when(text == NOT_SUPPORTED, F.lit(0).cast(kind)).otherwise(text.try_cast(kind))


def largest_core(values: Column) -> Column:
    """Busiest core of a per-core list, 0 for an empty or missing list."""
    return F.coalesce(F.array_max(values), F.lit(0.0))


def first_maximum(values: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


# --- declared types -------------------------------------------------------

# Type words of a stored schema, with the fill for missing data.
TYPE_DEFAULTS = {"int": "0", "float": "0.0", "str": "", "bool": "false"}
TYPE_NAMES = {
    "int": "long",
    "float": "double",
    "str": "string",
    "bool": "boolean",
    "datetime": "timestamp_ntz",
}


def type_default(word: str) -> Column:
    text = TYPE_DEFAULTS.get(word)
    return F.lit(text).cast(TYPE_NAMES.get(word, "string"))


def coerce(value: Column, word: str, source_type: str) -> Column:
    """Bring a value to a declared type; what cannot be read becomes the default.

    Integers cut the fraction off. A number is true unless 0, a text is true
    unless empty. Text stays as it is and times are parsed or null.
    """
    if word == "int":
        if source_type in ("tinyint", "smallint", "int", "bigint"):
            return F.coalesce(value.cast("long"), F.lit(0).cast("long"))
        number = value.try_cast("double")
        whole = F.when(~F.isnan(number), number.try_cast("long"))
        exact = value.try_cast("long") if source_type == "string" else whole
        return F.coalesce(exact, whole, F.lit(0).cast("long"))
    if word == "float":
        number = value.try_cast("double")
        return F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0))
    if word == "bool":
        if source_type == "string":
            return F.coalesce(F.length(value) > 0, F.lit(True))
        return F.coalesce(value.cast("double") != 0, F.lit(True))
    if word == "datetime":
        return value.try_cast("timestamp_ntz")
    return value
