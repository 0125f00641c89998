"""Reports and profiles of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefuse.functions.timeops import SECOND, micros
from tidefuse.operators.align import is_numeric
from tidefuse.operators.fill import is_event

KEYS = ("run_id", "timestamp")


def quality_report(series: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per column: missing values, completeness in percent, and sum if it is an event."""
    columns = [c for c in series.columns if c not in KEYS]
    aggs = [F.count("*").alias("total_records"),
            F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}|missing") for c in columns]
    aggs += [F.sum(c).cast("double").alias(f"{c}|events") for c in columns if is_event(c)]
    wide = series.groupBy(*keys).agg(*aggs)
    none = F.lit(None).cast("double")
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.col(f"`{c}|missing`").alias("missing"),
            ((1 - F.col(f"`{c}|missing`") / F.col("total_records")) * 100).alias("completeness"),
            (F.col(f"`{c}|events`") if is_event(c) else none).alias("events"),
        )
        for c in columns
    ])
    seconds = (micros("end_ts") - micros("start_ts")) / F.lit(float(SECOND))
    return wide.select(
        *keys, "total_records", "start_ts", "end_ts", seconds.alias("duration_seconds"), F.inline(rows)
    )


def series_summary(series: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Rows, features and time range per run."""
    features = [c for c in series.columns if c not in KEYS]
    return series.groupBy(*keys).agg(
        F.count("*").alias("total_records"), F.lit(len(features)).alias("total_features"),
        F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"),
    )


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])
    return df.select(*keys, F.inline(cells))


#: Bits of the digits of the radix selection, the highest first; a value's image has 64.
DIGITS = (22, 21, 21)


def exact_quantiles(
    long: DataFrame, keys: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Interpolated quantiles of ``value`` per key, exact at any size, by radix selection.

    A value's bits, as an integer in the order of values, are three digits. For each
    digit the values that begin like a wanted rank's digits so far are counted by their next
    digit, for all keys at once; the running counts tell the digit of the rank. A group
    has as many counts as a digit has values at most, however many rows; no values are gathered.
    """
    keys = list(keys)
    flip = F.lit((1 << 63) - 1)
    known = long.where(F.col("value").isNotNull()).withColumn("_x", F.col("value") + F.lit(0.0))
    bits = F.expr("CAST(java_method('java.lang.Double', 'doubleToLongBits', _x) AS BIGINT)")
    known = known.select(*keys, bits.alias("_bits")).select(
        *keys, F.when(F.col("_bits") < 0, F.col("_bits").bitwiseXOR(flip)).otherwise(F.col("_bits")).alias("_bits"))
    wanted = None
    left = 64
    for width in DIGITS:
        left -= width
        digit = F.shiftright("_bits", left)
        if wanted is None:
            rows = known.select(*keys, F.lit(0).cast("long").alias("_head"), F.lit(0).alias("_ranks"), digit.alias("_digit"))
        else:
            # A row for each beginning that a wanted rank has: at most two per probability and key.
            heads = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_head").alias("_h"), "_ranks")
            same = F.shiftright("_bits", left + width) == F.col("_h")
            for i, k in enumerate(keys):
                same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
            rows = known.join(heads, same).select(
                *keys, F.col("_h").alias("_head"), "_ranks", digit.bitwiseAND((1 << width) - 1).alias("_digit"))
        counts = rows.groupBy(*keys, "_head", "_ranks", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        group = Window.partitionBy(*keys, "_head")
        upto = F.sum("_n").over(group.orderBy("_digit"))
        if wanted is None:
            at = [(F.sum("_n").over(group) - 1) * F.lit(float(p)) for p in probabilities]
            ranks = F.array(*[
                F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), end(x).alias("rank"), (x - F.floor(x)).alias("share"))
                for i, x in enumerate(at) for side, end in enumerate((F.floor, F.ceil))])
            counts = counts.withColumn("_ranks", ranks)
        below = counts.withColumn("_upto", upto).withColumn("_below", F.col("_upto") - F.col("_n"))
        hit = F.filter("_ranks", lambda r: (r["rank"] < F.col("_upto")) & (r["rank"] >= F.col("_below")))
        # From here on a rank counts among the values that begin alike.
        moved = F.transform(hit, lambda r: F.struct(
            r["i"].alias("i"), r["side"].alias("side"), (r["rank"] - F.col("_below")).alias("rank"), r["share"].alias("share")))
        head = F.shiftleft("_head", width) + F.col("_digit") if wanted is not None else F.col("_digit")
        wanted = below.select(*keys, head.alias("_head"), moved.alias("_ranks")).where(F.size("_ranks") > 0)
    back = F.when(F.col("_head") < 0, F.col("_head").bitwiseXOR(flip)).otherwise(F.col("_head"))
    values = wanted.select("*", F.explode("_ranks").alias("_rank")).withColumn("_b", back).withColumn(
        "_value", F.expr("CAST(java_method('java.lang.Double', 'longBitsToDouble', _b) AS DOUBLE)"))

    def quantile(i: int) -> Column:
        low, high = (F.max(F.when((F.col("_rank.i") == i) & (F.col("_rank.side") == s), F.col("_value"))) for s in (0, 1))
        share = F.max(F.when(F.col("_rank.i") == i, F.col("_rank.share")))
        # Equal neighbours need no difference, which infinite ones do not have.
        return F.when(low == high, low).otherwise(low + (high - low) * share).alias(f"q{i}")

    return values.groupBy(*keys).agg(*[quantile(i) for i in range(len(probabilities))])


def describe_series(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column."""
    long = to_long(df, keys, columns)
    by = [*keys, "feature"]
    moments = long.groupBy(*by).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, by, (0.25, 0.5, 0.75)).select(
        *by, F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )
    return moments.join(quartiles, by, "left")


# Integer types with strict upper bounds, tried in this order.
UNSIGNED = ((255, "uint8"), (65535, "uint16"), (4294967295, "uint32"))
SIGNED = ((128, 127, "int8"), (32768, 32767, "int16"), (2147483648, 2147483647, "int32"))
FLOAT_BOUND = 3.4028234663852886e38


def narrow_types_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Smallest type per numeric column from its extremes, in one pass."""
    types = dict(df.dtypes)
    numeric = columns or [c for c, t in df.dtypes if is_numeric(t)]
    wide = df.agg(
        *[F.min(c).alias(f"{c}|lo") for c in numeric], *[F.max(c).alias(f"{c}|hi") for c in numeric]
    )
    rows = []
    for c in numeric:
        lo, hi = F.col(f"`{c}|lo`"), F.col(f"`{c}|hi`")
        if types[c] in ("float", "double"):
            fits = (lo > -FLOAT_BOUND) & (hi < FLOAT_BOUND)
            kind = F.when(fits, F.lit("float32")).otherwise(F.lit("float64"))
        else:
            kind = F.when(lo.isNull(), F.lit("int64"))
            for bound, name in UNSIGNED:
                kind = kind.when((lo >= 0) & (hi < F.lit(bound).cast("long")), F.lit(name))
            for low, high, name in SIGNED:
                kind = kind.when(
                    (lo < 0) & (lo > F.lit(-low).cast("long")) & (hi < F.lit(high).cast("long")),
                    F.lit(name),
                )
            kind = kind.otherwise(F.lit("int64"))
        rows.append(F.struct(
            F.lit(c).alias("feature"), lo.cast("double").alias("min"), hi.cast("double").alias("max"),
            kind.alias("narrow_type"),
        ))
    return wide.select(F.inline(F.array(*rows)))


def cardinality_profile(
    df: DataFrame, columns: Sequence[str], limit: float = 0.5, exact: bool = True
) -> DataFrame:
    """Distinct share per text column; low shares are categories.

    ``exact=False`` estimates the distinct count in one pass, which is the
    choice for very wide tables.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    wide = df.agg(F.count("*").alias("_rows"), *[distinct(F.col(c)).alias(c) for c in columns])
    share = {c: F.try_divide(F.col(c).cast("double"), F.col("_rows").cast("double")) for c in columns}
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_distinct"), share[c].alias("share"),
                 (share[c] < limit).alias("is_category"))
        for c in columns
    ])
    return wide.select(F.inline(rows))


#: Logarithm of a sketch's size; its relative error is 1.04 / sqrt(2 ** LG_K).
LG_K = 12


def distinct_sketches(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Rows, and a sketch of the distinct values of each column, per key; sketches of batches can be united."""
    sketch = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LG_K)).alias(c) for c in columns]
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *sketch)


def sketched_profile(sketches: DataFrame, columns: Sequence[str], limit: float = 0.5) -> DataFrame:
    """``cardinality_profile`` from the sketches of any number of batches; no row is read again.

    ``is_sure`` tells whether the share lies farther from the limit than five times the sketch's error.
    """
    wide = sketches.agg(F.sum("n_rows").alias("_rows"), *[
        F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])
    cells = []
    for c in columns:
        share = F.try_divide(F.col(c).cast("double"), F.col("_rows").cast("double"))
        error = share * F.lit(5 * 1.04 / 2 ** (LG_K / 2))
        cells.append(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_distinct"), share.alias("share"),
                              (share < limit).alias("is_category"), (F.abs(share - limit) > error).alias("is_sure")))
    return wide.select(F.inline(F.array(*cells)))


def settled_profile(df: DataFrame, sketches: DataFrame, columns: Sequence[str], limit: float = 0.5) -> DataFrame:
    """``sketched_profile``, with the columns near the limit counted exactly over ``df``."""
    rough = sketched_profile(sketches, columns, limit)
    near = [r["feature"] for r in rough.where(~F.col("is_sure")).select("feature").collect()]  # names of columns
    sure = rough.where(F.col("is_sure")).drop("is_sure")
    return sure.unionByName(cardinality_profile(df, near, limit)) if near else sure
