"""Counter rates on a stream: the last sample of each series is Spark's keyed state."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidefuse.functions.timeops import SECOND, micros, us_of
from tidefuse.operators.align import run_key

# Tasks carry the state function with them, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

#: Groups that the series are dealt to. Python is called per group, and a call costs as much as thousands of rows.
#: A checkpoint is read with the number it was started with.
SERIES_GROUPS = 1024
_US, _TIME, _GROUP, _SERIES, _TIMER = "_us", "_time", "_group", "_series", "_timer"
#: Times of keys with all their digits.
KEY_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def absent(column: str) -> str:
    """The column that tells where a column of integers is null: pandas would turn such a column to floats."""
    return f"_no_{column}"


def rates_of(rows: pd.DataFrame, before: pd.DataFrame, counters: Sequence[str]) -> pd.DataFrame:
    """Rates of samples in order, series by series; ``before`` has the last sample before them by series."""
    first = rows[_SERIES] != rows[_SERIES].shift()

    def preceding(values: pd.Series, held: pd.Series) -> pd.Series:
        return values.shift().mask(first, rows[_SERIES].map(held))

    earlier = preceding(rows[_US].astype("float64"), before[_US])
    seconds = (rows[_US] - earlier) / SECOND
    out = rows.copy()
    for c in counters:
        # Floats carry counters up to 2 ** 53; the differences are those of such counters.
        diff = rows[f"_{c}"] - preceding(rows[f"_{c}"], before[f"_{c}"])
        rate = (diff / seconds).where(diff >= 0)
        out[f"{c}_rate"] = rate.mask(earlier.isna() | (seconds <= 0), 0.0)
    return out


def counter_rates_stream(
    stream: DataFrame, counters: Sequence[str], keys: Sequence[str] = ("run_id", "host_id"),
    order: Sequence[str] = ("timestamp",), late: str = "1 hour", expire: float = 86_400.0,
    groups: int = SERIES_GROUPS,
) -> DataFrame:
    """``counter_rates`` of a stream: its columns and a rate per counter.

    Spark keeps one sample per series as state, with the stream's own checkpoint. Samples older than
    the last one seen of their series are ignored, as are those later than ``late``. A series
    without a sample for ``expire`` seconds of event time is forgotten: the timer of its group drops
    it from the state, and a later sample is its first. A missing run is the empty one. Series are
    dealt to ``groups`` by a hash of their keys; state and calls are those of a group, so there are no more
    calls however many series there are. Rows of one group and micro-batch are put in order in one task;
    the size of micro-batches bounds them.
    """
    shown = stream.schema.fields
    names = stream.columns
    whole = [f.name for f in shown if isinstance(f.dataType, T.IntegralType)]
    out = T.StructType([*shown, *[T.StructField(f"{c}_rate", T.DoubleType()) for c in counters],
                        *[T.StructField(absent(c), T.BooleanType()) for c in whole]])
    held_types = {_SERIES: T.StringType(), _US: T.LongType(), _TIMER: T.LongType(), **{f"_{c}": T.DoubleType() for c in counters}}
    state = T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in held_types.items()])
    lifetime = us_of(expire) // 1000
    by = [x for o in order if o != "timestamp" for x in ((absent(o), o) if o in whole else (o,))]

    def hold(held: GroupState, series: pd.DataFrame, now: int) -> None:
        if not len(series):
            held.remove()
            return
        held.update(tuple(series[n].tolist() for n in held_types))
        # A timer must lie ahead of the watermark.
        held.setTimeoutTimestamp(max(int(series[_TIMER].min()), now + 1))

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.getCurrentWatermarkMs()
        before = pd.DataFrame(dict(zip(held_types, held.get if held.exists else [[] for _ in held_types])))
        before = before.astype({n: "object" if n == _SERIES else "float64" if n.startswith("_") and n[1:] in counters else "int64"
                                for n in held_types}).set_index(_SERIES, drop=False)
        if held.hasTimedOut:
            hold(held, before[before[_TIMER] >= now], now)
            return
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows[~(rows[_US] < rows[_SERIES].map(before[_US]))]
        rows = rows.assign(_code=pd.factorize(rows[_SERIES])[0]).sort_values(["_code", _US, *by], kind="stable", ignore_index=True)
        for c in counters:
            value = rows[c].astype("float64")
            rows[f"_{c}"] = value.mask(rows[absent(c)]) if c in whole else value
        last = rows.drop_duplicates(_SERIES, keep="last")
        last = last.assign(**{_TIMER: (last[_US] // 1000 + lifetime).clip(lower=now + 1)})
        silent = before[(before[_TIMER] >= now) & ~before[_SERIES].isin(last[_SERIES])]
        hold(held, pd.concat([part[list(held_types)] for part in (silent, last) if len(part)], ignore_index=True)
             if len(silent) + len(last) else silent, now)
        if len(rows):
            yield rates_of(rows, before, counters)[[f.name for f in out.fields]]

    timed = stream.withColumns({_TIME: F.col("timestamp").cast("timestamp"), _US: micros("timestamp")})
    if "run_id" in names:
        timed = timed.withColumn("run_id", run_key())
    timed = timed.withColumns({_SERIES: F.to_json(F.struct(*keys), KEY_TEXT), _GROUP: F.pmod(F.xxhash64(*keys), F.lit(groups))})
    timed = timed.withColumns({absent(c): F.col(c).isNull() for c in whole})
    timed = timed.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(stream.schema[c].dataType)) for c in whole})
    found = (
        timed.where(F.col(_US).isNotNull()).withWatermark(_TIME, late)
        .groupBy(_GROUP)
        .applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)
    )
    return found.select(*[F.when(~F.col(absent(n)), F.col(n)).alias(n) if n in whole else F.col(n) for n in names],
                        *[f"{c}_rate" for c in counters])


def stream_counter_rates(
    stream: DataFrame,
    counters: Sequence[str],
    path: str,
    keys: Sequence[str] = ("run_id", "host_id"),
    order: Sequence[str] = ("timestamp",),
    trigger: Mapping[str, object] | None = None,
    late: str = "1 hour",
    expire: float = 86_400.0,
) -> StreamingQuery:
    """Write ``counter_rates_stream`` below ``path``; started again, it goes on where it ended."""
    rates = counter_rates_stream(stream, counters, keys, order, late, expire)
    return (
        rates.writeStream.format("parquet").outputMode("append")
        .option("path", f"{path}/rates").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rates")
