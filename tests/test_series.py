"""Alignment, fills and features on small series with known answers."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import at, rows
from tidefuse.functions import measures, timeops
from tidefuse.operators import align, blocks, features, fill, quality, rollup
from tidefuse.plans.fusion import labelled_matrix


def series(spark, cells, columns="x double"):
    return spark.createDataFrame(cells, f"run_id string, timestamp timestamp_ntz, {columns}")


def test_round_half_even(spark):
    df = spark.createDataFrame([(s,) for s in (5, 15, 25, 14, 16)], "us long")
    got = [r[0] for r in df.select(timeops.round_us(F.col("us"), 10)).collect()]
    assert got == [0, 20, 20, 10, 20]


def test_ceil_keeps_multiples(spark):
    df = spark.createDataFrame([(20,), (21,)], "us long")
    assert [r[0] for r in df.select(timeops.ceil_us(F.col("us"), 10)).collect()] == [20, 30]


def test_cpu_levels_at_the_bounds(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (25.1,), (100.0,), (100.1,), (None,), (math.nan,)], "x double")
    assert [r[0] for r in df.select(measures.cpu_level(F.col("x"))).collect()] == [
        None, "low", "medium", "critical", None, None, None]


def test_change_rate_of_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (3.0, 2.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(measures.change_rate(F.col("a"), F.col("b"))).collect()]
    assert got == [math.inf, 0.0, -math.inf, 0.5, 0.0]


def test_grid_spans_floor_to_ceil(spark):
    src = series(spark, [("a", at(0.4), 1.0), ("a", at(2.2), 3.0), ("b", at(10), 5.0)])
    got = rows(align.align([src], 1, block_slots=2), "run_id", "timestamp", "x")
    assert got == sorted([
        ("a", at(0), 1.0), ("a", at(1), None), ("a", at(2), 3.0), ("a", at(3), None), ("b", at(10), 5.0)
    ], key=repr)


def test_slot_takes_mean_and_last(spark):
    src = series(spark, [("a", at(0.1), 1.0, "p"), ("a", at(0.3), 3.0, "q"), ("a", at(0.2), 5.0, None)],
                 "x double, s string")
    assert rows(align.slot_dedupe(src, 1), "run_id", "timestamp", "x", "s") == [("a", at(0), 3.0, "q")]


def test_missing_source_and_double_column(spark):
    one = series(spark, [("a", at(0), 1.0)])
    try:
        align.align([one, one], 1)
    except ValueError as error:
        assert "more than one source" in str(error)
    else:
        raise AssertionError("a column in two sources must fail")


def test_events_are_not_carried_by_default(spark):
    src = series(spark, [("a", at(0), None, 1.0), ("a", at(3), None, 2.0), ("a", at(1), 1, None)],
                 "event_oom int, x double")
    zero = fill.fuse([src], 1, block_slots=2)
    assert [r[0] for r in zero.orderBy("timestamp").select("event_oom").collect()] == [0, 1, 0, 0]
    carried = fill.fuse([src], 1, "carry", block_slots=2)
    assert [r[0] for r in carried.orderBy("timestamp").select("event_oom").collect()] == [1, 1, 1, 1]


def test_nan_is_a_value_for_fills(spark):
    src = series(spark, [("a", at(0), math.nan), ("a", at(1), None), ("a", at(2), 4.0)])
    got = [r[0] for r in fill.fill_missing(src, 1).orderBy("timestamp").select("x").collect()]
    assert math.isnan(got[0]) and math.isnan(got[1]) and got[2] == 4.0


def test_null_run_is_kept(spark):
    src = series(spark, [(None, at(0), 1.0), ("a", at(0), 2.0)])
    assert rows(fill.fuse([src], 1), "run_id", "x") == [("", 1.0), ("a", 2.0)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=60), st.integers(2, 7))
def test_fill_and_features_equal_pandas(spark, values, block):
    frame = pd.DataFrame({"x": pd.Series(values, dtype="float64")})
    src = series(spark, [("a", at(i), None if v is None else float(v)) for i, v in enumerate(values)])
    want = frame["x"].ffill().bfill().fillna(0)
    filled = fill.fill_missing(src, 1, block_slots=block)
    out = features.add_lagged(filled, 1, max(block, 3), step="x", loss="x").orderBy("timestamp").toPandas()
    assert out["x"].tolist() == want.tolist()
    assert out["train_step_rate"].tolist() == want.diff().fillna(0).tolist()
    mean = want.rolling(10, min_periods=1).mean()
    assert max(abs(out["train_loss_moving_avg"] - mean)) < 1e-9
    change = want.pct_change().fillna(0)
    assert all(a == b or abs(a - b) < 1e-12 for a, b in zip(out["train_loss_change_rate"], change, strict=True))


def test_scan_over_range_blocks_equals_window(spark):
    """One key holds most rows, many of them at one instant."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, F.lit(None)).otherwise(F.lit("b")).alias("key"),
        F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id")).alias("t"), "id",
        F.when(F.col("id") % 13 == 0, F.col("id")).alias("v"),
    )
    blocked = blocks.range_blocks(df.repartition(4), ["key"], ["t", "id"], rows=100)
    # The busy instant is cut too, and no block is much larger than asked for.
    sizes = blocked.groupBy("key", blocks.BLOCK).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 300 and sizes[1] >= 20
    got = blocks.scan(blocked, ["key"], ["t", "id"], last={"f": F.col("v")}, following={"g": "v"},
                      total={"n": F.lit(1)}, low={"m": F.col("v")}, previous={"p": "v"})
    over = "OVER (PARTITION BY key ORDER BY t, id ROWS BETWEEN"
    want = df.selectExpr(
        "key", "t", "id", f"last(v, true) {over} UNBOUNDED PRECEDING AND CURRENT ROW) f",
        f"first(v, true) {over} CURRENT ROW AND UNBOUNDED FOLLOWING) g",
        f"count(*) {over} UNBOUNDED PRECEDING AND CURRENT ROW) n",
        f"min(v) {over} UNBOUNDED PRECEDING AND CURRENT ROW) m",
        f"last(v, true) {over} UNBOUNDED PRECEDING AND 1 PRECEDING) p",
    )
    names = ["key", "t", "id", "f", "g", "n", "m", "p"]
    assert rows(got, *names) == rows(want, *names)


def test_device_counts_agree(spark):
    names = rollup.DEVICE_MEANS + rollup.DEVICE_SUMS
    src = spark.range(4000).select(
        F.lit("r").alias("run_id"), F.timestamp_seconds(F.col("id") % 50).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("id") % 7 != 0, (F.col("id") * 37) % 130).cast("int").alias("gpu_id"),
        *[F.col("id").cast("double").alias(c) for c in names],
    )
    free, bits = rollup.device_rollup(src), rollup.device_rollup(src, 130)
    assert rows(free, *free.columns) == rows(bits, *free.columns)
    with pytest.raises(Exception, match="device id not below 100"):
        rollup.device_rollup(src, 100).collect()


def test_counter_reset_is_null(spark):
    src = spark.createDataFrame(
        [("r", 1, at(0), 100), ("r", 1, at(2), 300), ("r", 1, at(3), 10), ("r", 1, at(3), 20), ("r", 2, at(9), 5)],
        "run_id string, host_id int, timestamp timestamp_ntz, bytes long",
    )
    got = rows(features.counter_rates(src, ["bytes"], order=("timestamp", "bytes")), "host_id", "bytes", "bytes_rate")
    assert got == [(1, 10, None), (1, 100, 0.0), (1, 20, 0.0), (1, 300, 100.0), (2, 5, 0.0)]


def test_interpolation_and_ends(spark):
    src = series(spark, [("a", at(i), v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])])
    got = fill.interpolate_linear(src, ["x"], 1, block_slots=2).orderBy("timestamp").select("x").collect()
    assert [r[0] for r in got] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "int", "string", "date"])
def test_blocks_follow_the_order(spark, kind):
    """Blocks of one key never run against the order, whatever its types; missing values come first."""
    t = {"timestamp_ntz": "CAST(timestamp_seconds(id * 37 % 9000) AS timestamp_ntz)", "int": "CAST(id * 37 % 900 AS int)",
         "string": "concat('k', CAST(id * 37 % 900 AS string))", "date": "date_add(DATE'2024-01-01', CAST(id * 37 % 90 AS int))"}[kind]
    df = spark.range(2000).selectExpr("CAST(id % 3 AS int) AS key", f"CASE WHEN id % 50 > 0 THEN {t} END AS t",
                                      "CASE WHEN id % 7 > 0 THEN id END AS u")
    got = blocks.range_blocks(df, ["key"], ["t", "u"], rows=25)
    back = got.selectExpr("_blk", "lag(_blk) OVER (PARTITION BY key ORDER BY t, u) AS p").where("p > _blk")
    assert got.count() == 2000 and not back.count()
    assert got.select("_blk").distinct().count() > 10


def test_blocks_over_doubles_are_an_error(spark):
    with pytest.raises(TypeError):
        blocks.range_blocks(spark.range(2).selectExpr("1 AS key", "CAST(id AS double) AS t"), ["key"], ["t"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.one_of(st.none(), st.integers(-4, 4))), min_size=1, max_size=40),
       st.integers(1, 6))
def test_lags_while_unfolding_equal_those_of_the_grid(spark, cells, block):
    """Gaps, unknown beginnings and blocks smaller than the frame."""
    known, slot = [], 0
    for gap, value in cells:
        known.append(("a", at(slot), None if value is None else float(value), 1.0))
        slot += gap + 1
    src = series(spark, known, "train_loss double, other double")
    once = features.fuse_derived([src], 1, block_slots=block, step="train_loss", loss="train_loss")
    grid = features.add_lagged(fill.fuse([src], 1, block_slots=block), 1, 4000, "train_loss", "train_loss")
    names = ["train_loss", "train_step_rate", "train_loss_change_rate", "train_loss_moving_avg"]
    a, b = (x.orderBy("timestamp").select(*names).toPandas() for x in (once, grid))
    assert len(a) == len(b)
    for c in names:
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(a[c], b[c], strict=True)), c


def test_recent_values(spark):
    src = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1, None, 2, 3, None, 4, 5])], "run_id string, t long, v int")
    blocked = src.withColumn(blocks.BLOCK, F.floor(F.col("t") / 2))
    got = blocks.scan(blocked, ["run_id"], ["t"], recent={"r": "v"}, depth=3).orderBy("t").collect()
    assert [[x["value"] for x in r["r"]] for r in got] == [[], [1], [1], [2, 1], [3, 2, 1], [3, 2, 1], [4, 3, 2], [5, 4, 3]]


def test_exact_quantiles_of_any_numbers(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.gauss(0, 1), rng.uniform(-1e300, 1e300), 0.0, -0.0, 5e-324, float(rng.randint(-3, 3))])
              for _ in range(801)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)] * 50 + [("c", None), (None, 2.5), (None, 3.5)],
                               "run_id string, value double")
    got = {r["run_id"]: [r["q0"], r["q1"], r["q2"]] for r in quality.exact_quantiles(df, ["run_id"], (0.0, 0.3, 1.0)).collect()}
    assert got["a"] == pytest.approx([float(x) for x in np.quantile(values, [0, 0.3, 1])], rel=1e-12)
    assert got["b"] == [7.0] * 3 and got[None] == [2.5, 2.8, 3.5] and set(got) == {"a", "b", None}
    plan = quality.exact_quantiles(df, ["run_id"], (0.5,))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    odd = spark.createDataFrame([("a", v) for v in (math.nan, math.inf, -math.inf, 1.0)], "run_id string, value double")
    low, high = quality.exact_quantiles(odd, ["run_id"], (0.0, 1.0)).select("q0", "q1").first()
    assert low == -math.inf and math.isnan(high)


@pytest.mark.parametrize("seconds", [3, 20, 55])
def test_rolling_frames_of_any_length(spark, seconds):
    """Frames shorter and longer than a block equal the plain window, also about a large mean."""
    rng = random.Random(seconds)
    cells = [(r, at(k), 1e6 + rng.random() if k % 31 else float("nan") if r == "a" else 1e6, float(k % 5))
             for r in ("a", None) for k in range(130)]
    src = series(spark, cells, "x double, y double")
    names = [f"{c}_{n}" for c in "xy" for n in ("moving_average", "standard_deviation", "rate_of_change")]
    got = features.rolling_features(src, ["x", "y"], 1, seconds, block_slots=10).orderBy("run_id", "timestamp").toPandas()
    want = features.rolling_features(src, ["x", "y"], 1, seconds, block_slots=1000).orderBy("run_id", "timestamp").toPandas()
    assert len(got) == 260
    for n in names:
        assert all((math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) < 1e-6 * max(1, abs(b))
                   for a, b in zip(got[n], want[n], strict=True)), n


def test_choices_of_the_matrix(spark):
    host = series(spark, [("a", at(0), 0.0), ("a", at(4), 8.0)], "cpu_percent double")
    windows = spark.createDataFrame([("a", at(2), at(2))], "run_id string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = labelled_matrix(hosts=host, windows=windows, margins=(1.0, 0.0), method="linear", rolling=["sys_cpu_percent"],
                          window=1.0).orderBy("timestamp").collect()
    assert [r["sys_cpu_percent"] for r in got] == [0.0, 2.0, 4.0, 6.0, 8.0]
    assert [r["sys_cpu_percent_moving_average"] for r in got] == [0.0, 1.0, 3.0, 5.0, 7.0]
    assert [r["is_anomaly"] for r in got] == [0, 1, 1, 0, 0]
    with pytest.raises(ValueError, match="method"):
        labelled_matrix(hosts=host, method="cubic")
