"""Labels, alerts and schedules at their edges."""

from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import at, rows
from tidefuse.operators import alerts, faults, labels

POINT = "run_id string, timestamp timestamp_ntz"
WINDOW = "run_id string, fault_id string, start_ts timestamp_ntz, end_ts timestamp_ntz"


def test_both_ends_and_zero_duration(spark):
    flat = spark.createDataFrame(
        [("a", "f1", "nan_loss", 5.0, 3.0), ("a", "f2", "oom", 20.0, 0.0), ("a", "f3", "oom", 40.0, None)],
        "run_id string, fault_name string, type string, delay double, duration double",
    )
    starts = spark.createDataFrame([("a", at(0))], "run_id string, run_start timestamp_ntz")
    windows = faults.time_windows(faults.normalize(flat=flat), starts)
    points = spark.createDataFrame([("a", at(s)) for s in (4, 5, 8, 9, 20, 30, 31, 50, 51)] + [(None, at(5))], POINT)
    got = [(r[0].second + 60 * r[0].minute, r[1]) for r in labels.label_windows(points, windows)
           .where("run_id IS NOT NULL").orderBy("timestamp").select("timestamp", "is_anomaly").collect()]
    assert got == [(4, 0), (5, 1), (8, 1), (9, 0), (20, 1), (30, 1), (31, 0), (50, 1), (51, 0)]
    assert labels.label_windows(points, windows).count() == 10


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(0, 40)), min_size=1, max_size=12))
def test_labels_never_multiply_rows(spark, spans):
    points = spark.createDataFrame([("a", at(s)) for s in range(0, 130, 3)], POINT)
    windows = spark.createDataFrame(
        [("a", str(i), at(s), at(s + n)) for i, (s, n) in enumerate(spans)], WINDOW)
    got = labels.label_windows(points, windows, bucket_seconds=20).orderBy("timestamp").collect()
    want = [int(any(s <= t <= s + n for s, n in spans)) for t in range(0, 130, 3)]
    assert [r["is_anomaly"] for r in got] == want
    counts = dict(rows(labels.fault_coverage(points, windows), "fault_id", "points"))
    assert counts == {str(i): sum(s <= t <= s + n for t in range(0, 130, 3)) for i, (s, n) in enumerate(spans)}


def test_open_ended_steps(spark):
    steps = spark.createDataFrame(
        [("a", "nan_loss", 3, 2.0), ("a", "non_convergence", 8, 1.0), ("b", "oom", 1, None)],
        "run_id string, fault_type string, injection_step long, duration double")
    windows = faults.step_windows(faults.normalize(step_based=steps))
    points = spark.createDataFrame([(r, s) for r in "ab" for s in range(1, 11)], "run_id string, train_step long")
    got = labels.label_steps(points, windows, bucket_steps=4)
    hit = rows(got.where("is_anomaly = 1"), "run_id", "train_step")
    assert hit == [("a", 10), ("a", 3), ("a", 4), ("a", 8), ("a", 9)] + [("b", s) for s in range(1, 6)]


def test_schedule_names_for_the_same_time(spark):
    a = spark.createDataFrame([("io", 60.0, 5.0)], "fault_type string, injection_time double, duration double")
    b = spark.createDataFrame([("io", 60.0, 5.0)], "fault_type string, delay double, duration double")
    assert rows(faults.normalize(time_based=a), "delay") == rows(faults.normalize(time_based=b), "delay") == [(60.0,)]


def test_threshold_needs_its_duration_and_no_gap(spark):
    cells = [90.0] * 4 + [None] + [90.0] * 3 + [10.0] + [91.0] * 6
    src = spark.createDataFrame([("a", at(i), v) for i, v in enumerate(cells)], POINT + ", sys_cpu_percent double")
    rule = alerts.HeldThreshold("busy", "sys_cpu_percent", 80, 3)
    got = rows(alerts.sustained_thresholds(src, [rule], 1, block_slots=4), "start_ts", "end_ts", "alert_ts", "samples")
    assert got == [(at(0), at(3), at(3), 4), (at(9), at(14), at(12), 6)]


def test_patience_ignores_nan(spark):
    src = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 4.0, float("nan"), 4.0, 6.0, 3.0])],
                                "run_id string, step long, loss double")
    got = alerts.no_improvement(src, patience=3, block_steps=2).orderBy("step").collect()
    assert [r["steps_since_best"] for r in got] == [0, 0, 1, 2, 3, 0]
    assert [r["stalled"] for r in got] == [0, 0, 0, 0, 1, 0]


def test_draws_are_even_and_repeatable(spark):
    u = spark.range(20000).select(faults.draw(1, F.col("id")).alias("u"))
    low = u.where("u < 0.5").count()
    assert 9500 < low < 10500 and low == u.where("u < 0.5").count()


def test_windows_of_one_fault_add_up(spark):
    points = spark.createDataFrame([("r", at(i)) for i in range(30)], "run_id string, timestamp timestamp_ntz")
    windows = spark.createDataFrame(
        [("r", "oom", at(0), at(4)), ("r", "oom", at(10), at(14))],
        "run_id string, fault_id string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    assert rows(labels.fault_coverage(points, windows), "fault_id", "points") == [("oom", 10)]


def test_open_and_far_windows(spark):
    points = spark.createDataFrame([("r", at(i)) for i in range(4)], "run_id string, timestamp timestamp_ntz")
    windows = spark.createDataFrame(
        [("r", at(2), None), ("r", at(3), datetime(9999, 1, 1))],
        "run_id string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    flagged = rows(labels.label_windows(points, windows), "timestamp", "is_anomaly")
    assert [f for _, f in flagged] == [0, 0, 1, 1]


def test_fault_without_a_run_applies_to_every_run(spark):
    schedule = faults.normalize(flat=spark.createDataFrame([("oom", 5.0)], "type string, injection_time double"))
    starts = spark.createDataFrame([("a", at(0)), ("b", at(9))], "run_id string, run_start timestamp_ntz")
    found = rows(faults.time_windows(schedule, starts), "run_id", "start_ts")
    assert found == [("a", at(5)), ("b", at(14))]


def test_window_without_a_start_labels_nothing(spark):
    schedule = faults.normalize(flat=spark.createDataFrame(
        [("a", "oom", 1.0, 1.0), ("b", "oom", 1.0, 1.0)], "run_id string, type string, delay double, duration double"))
    starts = spark.createDataFrame([("a", at(0)), ("b", None)], "run_id string, run_start timestamp_ntz")
    points = spark.createDataFrame([(r, at(i)) for r in "ab" for i in range(4)], POINT)
    flagged = labels.label_windows(points, faults.time_windows(schedule, starts))
    assert rows(flagged.where("is_anomaly = 1"), "run_id", "timestamp") == [("a", at(1)), ("a", at(2))]
    steps = spark.createDataFrame([("a", None, 5)], "run_id string, start_step long, end_step long")
    numbered = spark.createDataFrame([("a", i) for i in range(4)], "run_id string, train_step long")
    assert labels.label_steps(numbered, steps).where("is_anomaly = 1").count() == 0


def test_coverage_of_open_startless_and_foreign_windows(spark):
    points = spark.createDataFrame([("a", at(i)) for i in range(10)] + [(None, at(i)) for i in range(4)], POINT)
    windows = spark.createDataFrame([
        ("a", "open", at(2), None), ("a", "no start", None, at(2)), ("a", "far", at(5), datetime(9999, 1, 1)),
        ("a", "past", at(50), at(60)), ("a", "backwards", at(5), at(3)), ("b", "no points", at(0), at(9)),
        (None, "empty run", at(1), at(2)), ("a", "twice", at(0), at(1)), ("a", "twice", at(0), at(1)),
    ], WINDOW)
    assert dict(rows(labels.fault_coverage(points, windows), "fault_id", "points")) == {
        "open": 8, "no start": 0, "far": 5, "past": 0, "backwards": 0, "no points": 0, "empty run": 2, "twice": 4}


def test_points_and_windows_without_a_run_meet(spark):
    points = spark.createDataFrame([(None, at(i)) for i in range(5)] + [("", at(9)), ("a", at(2))], POINT)
    windows = spark.createDataFrame([(None, "f", at(0), at(2)), ("", "g", at(9), None)], WINDOW)
    hit = rows(labels.label_windows(points, windows).where("is_anomaly = 1"), "run_id", "timestamp")
    assert hit == sorted([(None, at(0)), (None, at(1)), (None, at(2)), ("", at(9))], key=repr)
    steps = spark.createDataFrame([(None, i) for i in range(4)], "run_id string, train_step long")
    stepped = spark.createDataFrame([(None, 1, 2), (None, 3, None)], "run_id string, start_step long, end_step long")
    assert rows(labels.label_steps(steps, stepped).where("is_anomaly = 1"), "train_step") == [(1,), (3,)]


def test_known_span_gives_the_same_labels(spark):
    points = spark.createDataFrame([(r, at(i)) for r in "ab" for i in range(8)], POINT)
    windows = spark.createDataFrame([("a", "f", at(3), None), ("b", "g", at(-5), at(1))], WINDOW)
    span = points.groupBy("run_id").agg(F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"))
    names = ["run_id", "timestamp", "is_anomaly"]
    assert rows(labels.label_windows(points, windows, span=span), *names) == rows(labels.label_windows(points, windows), *names)


def test_step_fault_without_a_run_needs_runs(spark):
    schedule = faults.normalize(step_based=spark.createDataFrame(
        [(None, "oom", 2), ("a", "oom", 1)], "run_id string, fault_type string, injection_step long"))
    with pytest.raises(Exception, match="needs the runs"):
        faults.step_windows(schedule).collect()
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    assert rows(faults.step_windows(schedule, runs), "run_id", "start_step") == [("a", 1), ("a", 2), ("b", 2)]
