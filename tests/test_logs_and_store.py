"""Log formats, device lines, stored datasets, plans and streams on fixtures."""

from __future__ import annotations

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from helpers import at, rows
from tidefuse.functions import logparse, texts
from tidefuse.operators import quality, rollup
from tidefuse.plans import experiments
from tidefuse.session import require_utc, scratch_path
from tidefuse.sources import files, logs, registry, rotate, samples, store
from tidefuse.streaming import counters, growing, tail
from workload import storage

LINES = [
    "2024-01-01 00:00:10 - INFO - Step 10 | Loss: 0.693147 | LR: 2.00e-05 | Throughput: 16.50 samples/s | Step Time: 0.970s",
    "2024-01-01 00:00:20 - INFO - eval_loss: 0.693147 | eval_accuracy: 0.500000",
    "2024-01-01 00:00:30 - ERROR - [ANOMALY DETECTED] NaN/Inf Loss at step 30: nan",
    "2024-01-01 00:00:31 - WARNING - [ANOMALY DETECTED] High Loss at step 31: 250.5",
    "2024-01-01 00:00:40 - ERROR - CUDA out of memory",
    "2024-01-01 00:00:41 - INFO - waiting room",
    "2024-01-01 00:00:50 - ERROR - Loss: nan, Accuracy: 0.000, LR: 1.90e-05",
    "line without a timestamp",
    "   ",
    "训练开始",
    "Step 11 | Loss: 1-2 | LR: 1 | Throughput: 2 samples/s | Step Time: 3s",
]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("log")
    (folder / "train.log").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    one_run = logs.read_lines(spark, str(folder)).withColumn("run", F.lit("a"))
    return logparse.log_records(one_run, ["run"]).orderBy(*logs.LINE_ORDER).collect()


def test_log_file(parsed):
    assert len(parsed) == 10
    step, evaluation, nan, high, oom, room, *_ = parsed
    assert (step.step, step.loss, step.learning_rate, step.throughput, step.step_time) == (10, 0.693147, 2e-5, 16.5, 0.97)
    assert evaluation.metric_type == "evaluation" and evaluation.eval_accuracy == 0.5
    assert (nan.event_nan_loss, nan.anomaly_step, nan.anomaly_value) == (1, 30, "NaN")
    assert (high.anomaly_type, high.anomaly_value, high.event_warning) == ("high_loss", "250.5", 1)
    assert oom.event_oom == 1 and room.event_oom is None
    assert parsed[7].timestamp == parsed[6].timestamp == at(50)
    assert parsed[8].phase == "train_begin"
    assert parsed[9].step == 11 and parsed[9].loss is None and parsed[9].step_time == 3.0


def test_loose_oom_also_hits_room(spark):
    df = spark.createDataFrame([("waiting room",)], "line string")
    assert logparse.parse_lines(df, loose_oom=True).first().event_oom == 1


def test_simple_format_keeps_nan(spark):
    got = logparse.parse_simple_lines(spark.createDataFrame([(LINES[6],), ("no dash nan",)], "line string")).collect()
    assert math.isnan(got[0].loss) and got[0].event_type == "error" and got[0].timestamp == at(50)
    assert got[1].timestamp is None and got[1].event_type == "anomaly"


def test_device_lines(spark):
    lines = ["0, A, 5, [Not Supported], 0, 10, 90, 40, 12.5", "1, B, 5", "x, C, 5, 6, 1, 1, 1, 1, 1"]
    got = samples.device_query_rows(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert len(got) == 1 and got[0].utilization_memory == 0 and got[0].memory_percent == 0.0


def test_csv_with_missing_column_group(spark, tmp_path):
    (tmp_path / "h.csv").write_text("timestamp,memory_percent,cpu_percent\n2024-01-01 00:00:01,7,3.5\n")
    df = samples.scan_csv(spark, str(tmp_path), samples.HOST)
    assert dict(df.dtypes)["timestamp"] == "timestamp_ntz" and df.first().cpu_percent == 3.5


def test_completeness(spark, tmp_path):
    for run, names in (("a", files.REQUIRED_FILES), ("b", files.REQUIRED_FILES[:1])):
        (tmp_path / run).mkdir()
        for name in names:
            (tmp_path / run / name).write_text("x")
    got = rows(files.run_completeness(files.list_files(spark, str(tmp_path))), "run_id", "missing", "complete")
    assert got == [("a", "", True), ("b", "system_metrics.csv,training_metrics.csv", False)]


def test_store_keeps_batch_names_and_prunes(spark):
    root = scratch_path(spark, "t")
    df = spark.createDataFrame(
        [(b, at(i * 100 + j), j % 2) for i, b in enumerate(("007", "8", "9")) for j in range(5)],
        "batch_id string, timestamp timestamp_ntz, is_anomaly int")
    store.append(df, root, chunk_rows=2)
    store.append(df.where("batch_id = '8'"), root, batch_ids=["8"])
    assert store.read(spark, root).count() == 15
    got = store.query(spark, root, start=at(100), end=at(103))
    assert rows(got, "batch_id", "timestamp") == [("8", at(100 + j)) for j in range(4)]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    store.drop_batches(spark, root, ["007"])
    assert rows(store.read_index(spark, root), "batch_id", "record_count") == [("8", 5), ("9", 5)]
    assert store.drop_dataset(spark, root)


def test_catalog(spark):
    root = scratch_path(spark, "catalog")
    folder = store.create_dataset(spark, root, "tse", store.MATRIX_SCHEMA, "all runs", ["anomaly"])
    store.create_dataset(spark, root, "other", {"x": "int"})
    raw = spark.createDataFrame([("b", "2024-01-01 00:00:05", "7.9", "inf")],
                                "batch_id string, timestamp string, train_step string, train_loss string")
    store.append(store.prepare(raw, store.MATRIX_SCHEMA), folder)
    row = store.read(spark, folder).first()
    assert (row.timestamp, row.train_step, row.train_loss, row.is_anomaly) == (at(5), 7, 0.0, 0)
    entries = {r["name"]: r for r in store.catalog(spark, root).collect()}
    assert entries["tse"]["schema"]["train_loss"] == "float" and entries["tse"]["tags"] == ["anomaly"]
    assert store.drop_entry(spark, root, "tse")
    assert [r["name"] for r in store.catalog(spark, root).collect()] == ["other"]


def test_unknown_filter_and_format(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        store.select_rows(df, filters={"b": 1})
    with pytest.raises(ValueError):
        store.export(df, "/tmp/never", "pickle")
    with pytest.raises(ValueError):
        registry.check_columns(df, ["label"])


def test_coercion(spark):
    df = spark.createDataFrame([("1.9", 2.7, 0), ("-3", float("nan"), 5), ("x", float("inf"), None)],
                               "t string, d double, i int")
    got = store.coerce_types(df, {"t": "int", "d": "int", "i": "bool"}).collect()
    assert [tuple(r) for r in got] == [(1, 2, False), (-3, 0, True), (0, 0, True)]


def test_chunks_cover_every_word(spark):
    text = " ".join(str(i) for i in range(1000))
    df = spark.createDataFrame([(1, text), (2, "  "), (3, "one")], "id int, text string")
    got = texts.overlapping_chunks(df, "text", 384, 128).orderBy("id", "chunk_no").collect()
    assert [(r.id, r.first_word, r.n_words) for r in got] == [
        (1, 0, 384), (1, 256, 384), (1, 512, 384), (1, 768, 232), (3, 0, 1)]


def test_cap_above_split_size(spark):
    df = spark.range(100).select(F.lit("train").alias("split"), "id").union(
        spark.range(5).select(F.lit("x"), "id"))
    assert registry.cap_splits(df, {"train": 30, "absent": 2}, "split", "id").count() == 35
    assert registry.cap_splits(df, {"train": 300}, "split", "id").count() == 105


def test_plan_document(spark, tmp_path):
    combos = [
        {"experiment_id": f"{m}_{d}_{f}", "model_config": {"model_type": "bert", "model_name": m},
         "dataset_config": {"dataset_type": d}, "fault_config": {"enabled": True, "fault_type": f}, "status": "pending"}
        for m in ("m1", "m2") for d in ("d1", "d2") for f in ("f1", "f2")
    ]
    (tmp_path / "plan.json").write_text(json.dumps({"plan_name": "p", "experiment_combinations": combos}, indent=1))
    plan = experiments.read_plan(spark, str(tmp_path))
    models = spark.createDataFrame([("m1", "bert"), ("m2", "bert")], "model_name string, model_type string")
    made = experiments.combine(models, ["d1", "d2"], ["f1", "f2"])
    assert rows(plan, "experiment_id", "status") == rows(made, "experiment_id", "status")
    report = experiments.report(plan).first()
    assert (report.total_experiments, report.pending, report.success_rate, report.average_duration) == (8, 8, 0.0, 0.0)


def test_plan_documents_hold_every_combination(spark, monkeypatch):
    read, unfold = [], experiments.plan_rows
    monkeypatch.setattr(experiments, "plan_rows", lambda plans: read.append(plans) or unfold(plans))
    found = storage.plan_rows(spark, "/root/testdata/sf0.001")
    sizes = read[0].select(F.size("experiment_combinations").alias("n")).groupBy("n").count().collect()
    assert [r.n for r in sizes] == [len(storage.DATASETS)]
    assert found.count() == sizes[0]["count"] * len(storage.DATASETS)


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LINES), encoding="utf-8")
    out = scratch_path(spark, "s")
    tail.append_to(tail.tail_records(spark, str(tmp_path)), f"{out}/d", f"{out}/c", {"availableNow": True}).awaitTermination()
    batch = logparse.parse_lines(spark.read.text(str(tmp_path)).withColumnRenamed("value", "line"))
    names = list(logparse.RECORD_COLUMNS)
    assert rows(spark.read.parquet(f"{out}/d"), *names) == rows(batch, *names)
    # Two steps, one evaluation, three alarms and one phase.
    assert tail.alerts(batch).count() == 7


def test_zone_is_checked(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError):
            require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_times_are_carried_over_splits_and_files(spark, tmp_path):
    """Small splits: times come from an earlier split or file, without a job before the action."""
    timed = [f"2024-01-01 00:00:{s:02d} - INFO - Epoch {s}" for s in range(3)]
    for k, stamp in enumerate(timed):
        (tmp_path / f"part{k}.log").write_text("\n".join(["no time yet"] * 40 + [stamp] + [f"trace {i}" for i in range(400)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = logs.read_lines(spark, str(tmp_path)).withColumn("run", F.lit("r"))
        assert lines.select("file", "_split").distinct().count() > 6
        done = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        records = logparse.log_records(lines, ["run"])
        plan = records._jdf.queryExecution().executedPlan().toString()
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == list(done)
        got = records.orderBy(*logs.LINE_ORDER).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "rangepartitioning" not in plan
    want = [None] * 40 + [at(0)] * 441 + [at(1)] * 441 + [at(2)] * 401
    assert [r.timestamp for r in got] == want


def test_every_evaluation_value_reaches_the_rollup(spark):
    lines = [(1, "2024-01-01 00:00:01 eval_loss: 0.5 | eval_auc: 0.7"), (2, "2024-01-01 00:00:01 eval_auc: 0.8 | eval_bleu: 3"),
             (3, "2024-01-01 00:00:01 eval_auc: x-y"), (4, "2024-01-01 00:00:01 eval_auc: 1-2"), (5, "2024-01-01 00:00:02 room")]
    parsed = logparse.parse_lines(spark.createDataFrame(lines, "line_no long, line string")).withColumn("run_id", F.lit("r"))
    assert parsed.where("line_no = 2").first()["eval_metrics"] == {"auc": 0.8, "bleu": 3.0}
    got = {r["timestamp"]: r for r in rollup.training_rollup(parsed.drop("raw_line"), "line_no").collect()}
    assert got[at(1)]["eval_metrics"] == {"loss": 0.5, "auc": 0.8, "bleu": 3.0} and got[at(1)]["eval_loss"] == 0.5
    assert got[at(2)]["eval_metrics"] is None


def test_devices_without_some_columns(spark):
    some = spark.createDataFrame([("r", at(0), 0, 5.0), ("r", at(0), 1, 7.0)],
                                 "run_id string, timestamp timestamp_ntz, gpu_id int, temperature double")
    assert rollup.device_rollup(some).first().asDict() == {
        "run_id": "r", "timestamp": at(0), "gpu_temperature": 6.0, "gpu_gpu_count": 2}
    bare = some.drop("gpu_id")
    assert rows(rollup.device_rollup(bare), "gpu_temperature") == [(5.0,), (7.0,)]


def test_last_result_counts_however_rows_are_stored(spark):
    plan = spark.createDataFrame([("e", "pending")], "experiment_id string, status string")
    results = [("e", False, "2024-01-01 09:00:00"), ("e", True, "2024-01-01 10:00:00"), ("e", False, None)]
    for order in (results, results[::-1]):
        found = spark.createDataFrame(order, "experiment_id string, success boolean, end_time string")
        assert experiments.update(plan, found).first()["status"] == "completed"
    with pytest.raises(ValueError, match="end_time"):
        experiments.update(plan, found.drop("end_time"))


def counter_samples(spark, cells):
    return spark.createDataFrame(cells, "run_id string, host_id int, timestamp timestamp_ntz, bytes long")


def test_keyed_state_restarts_and_expires(spark):
    """Stopped and started again between files; a series silent for longer than its lifetime starts anew."""
    inbox, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    parts = [
        [("r", 1, at(0), 100), ("r", 1, at(10), 300), ("r", 2, at(10), 50), (None, 1, at(10), 7)],
        [("r", 1, at(20), 400), ("r", 1, at(5), 999), ("r", 2, at(3000), 60)],  # host 1 then falls silent
        [("r", 2, at(9000), 90)],
        [("r", 1, at(9001), 1000), ("r", 2, at(9002), 95), (None, 1, at(9002), 8)],
    ]
    for cells in parts:
        counter_samples(spark, cells).repartition(2).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(counter_samples(spark, []).schema).parquet(inbox)
        counters.stream_counter_rates(
            stream, ["bytes"], out, trigger={"availableNow": True}, late="1 second", expire=7000.0).awaitTermination()
    got = rows(counters.read_rates(spark, out), "run_id", "host_id", "timestamp", "bytes_rate")
    assert got == sorted([
        ("r", 1, at(0), 0.0), ("r", 1, at(10), 20.0), ("r", 1, at(20), 10.0), ("r", 1, at(9001), 0.0),
        ("r", 2, at(10), 0.0), ("r", 2, at(3000), 10 / 2990), ("r", 2, at(9000), 30 / 6000), ("r", 2, at(9002), 2.5),
        ("", 1, at(10), 0.0), ("", 1, at(9002), 0.0),
    ], key=repr)
    assert not any("state" in name for name in os.listdir(out))


def batch(spark, rows, columns):
    return spark.createDataFrame(rows, f"batch_id string, timestamp timestamp_ntz, {columns}")


def test_bad_batch_leaves_the_dataset_as_it_was(spark):
    root = scratch_path(spark, "safe")
    store.append(batch(spark, [("a", at(0), 1.5, 3)], "x double, n long"), root)
    before = rows(store.read(spark, root), "batch_id", "x", "n")
    for bad in ("x string, n long", "x double, n double", "x double, n string"):
        cells = [("b", at(1), "1" if "x string" in bad else 1.0, "1" if "n string" in bad else 1.0 if "n double" in bad else 1)]
        with pytest.raises(ValueError, match="does not fit"):
            store.append(batch(spark, cells, bad), root)
    broken = batch(spark, [("b", at(1), 1.0, 1), (None, at(1), 1.0, 1)], "x double, n long")
    with pytest.raises(Exception, match="batch not named"):
        store.append(broken, root)
    assert rows(store.read(spark, root), "batch_id", "x", "n") == before
    assert rows(store.query(spark, root, start=at(0)), "batch_id") == [("a",)]
    # Narrower types are widened, new and missing columns are null elsewhere.
    store.append(batch(spark, [("c", at(2), 2, "new")], "n int, y string"), root)
    assert rows(store.read(spark, root), "batch_id", "x", "n", "y") == [("a", 1.5, 3, None), ("c", None, 2, "new")]
    assert rows(store.read_index(spark, root), "batch_id", "record_count") == [("a", 1), ("c", 1)]


def test_append_reads_its_input_once(spark):
    root, read = scratch_path(spark, "once"), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = batch(spark, [(str(k % 3), at(k), k) for k in range(30)], "n long")
    store.append(df.mapInArrow(count, df.schema), root)
    assert read.value == 30 and store.read_index(spark, root).count() == 3


def test_totals_follow_every_batch(spark):
    root = scratch_path(spark, "totals")
    store.create_dataset(spark, root, "d", {"x": "float", "is_anomaly": "int"})
    first = store.add_batches(batch(spark, [("a", at(0), "2.5", 1)], "x string, is_anomaly int"), root, "d").first()
    assert (first.batches, first.total_records, first.total_anomalies) == (1, 1, 1)
    more = batch(spark, [("a", at(3), 1.0, 0), ("a", at(4), 1.0, 0), ("b", at(9), None, 1)], "x double, is_anomaly int")
    store.add_batches(more, root, "d")
    total = store.totals(spark, root, "d").first()
    assert (total.batches, total.total_records, total.total_anomalies, total.max_timestamp) == (2, 3, 1, at(9))
    for bad, name, why in ((more.drop("timestamp"), "d", "lacks"), (more, "other", "no dataset")):
        with pytest.raises(ValueError, match=why):
            store.add_batches(bad, root, name)
    assert store.totals(spark, root, "d").first() == total


def test_files_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,cpu_percent,extra\n2024-01-01 00:00:01,3.5,x\n")
    (tmp_path / "b.csv").write_text("cpu_percent,memory_percent,timestamp\n4.5,7,2024-01-01 00:00:02\n")
    (tmp_path / "c.csv").write_text("timestamp,cpu_percent,extra\n2024-01-01 00:00:03,5.5,\"y, z\"\n")
    got = rows(samples.scan_csv(spark, str(tmp_path), samples.HOST), "timestamp", "cpu_percent", "memory_percent", "extra")
    assert got == [(at(1), 3.5, None, "x"), (at(2), 4.5, 7.0, None), (at(3), 5.5, None, "y, z")]


def test_empty_run_is_reported(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
    for name in files.REQUIRED_FILES:
        (tmp_path / "a" / name).write_text("x")
    got = files.run_completeness(files.list_files(spark, str(tmp_path)), runs=files.list_runs(spark, str(tmp_path)))
    assert rows(got, "run_id", "complete", "missing") == [("a", True, ""), ("b", False, ",".join(files.REQUIRED_FILES))]


@pytest.mark.parametrize("width", [1, 10])
def test_rotation_by_bytes(spark, tmp_path, width):
    df = spark.range(500).select("id", F.expr(f"repeat('é', CAST(id % 17 * {width} AS INT))").alias("pad"))
    path = str(tmp_path / "out")
    last = rotate.rotate(df, path, 2000, ["id"])
    found = spark.read.text(path).select("value", "file_no", F.col("_metadata.file_path").alias("f"),
                                         F.col("_metadata.file_size").alias("n")).collect()
    assert max(r.n for r in found) <= 2000 and len({r.f for r in found}) == last + 1 == max(r.file_no for r in found) + 1
    assert min(r.n for r in found if r.file_no < last) > 2000 - 2 * (60 + 34 * width)
    ids = [(r.file_no, json.loads(r.value)["id"]) for r in found]
    assert sorted(i for _, i in ids) == list(range(500)) and sorted(ids) == sorted(ids, key=lambda x: x[1])
    kept_path = str(tmp_path / "kept")
    rotate.rotate(df, kept_path, 2000, ["id"], keep=2)
    assert {r.file_no for r in spark.read.text(kept_path).collect()} == {last - 1, last}
    with pytest.raises(ValueError, match="more than a file"):
        rotate.rotate(df, str(tmp_path / "no"), 20, ["id"])
    assert rotate.rotate(df.limit(0), str(tmp_path / "none"), 20, ["id"]) == -1


def test_sketches_of_batches_are_united(spark):
    df = spark.range(20000).selectExpr("CAST(id % 4 AS string) AS batch_id", "CAST(id % 50 AS string) AS few",
                                       "CAST(id AS string) AS many", "CAST(id % 10000 AS string) AS half")
    names = ["few", "many", "half"]
    first = quality.distinct_sketches(df.where("batch_id < '2'"), names)
    both = first.unionByName(quality.distinct_sketches(df.where("batch_id >= '2'"), names))
    got = {r["feature"]: r for r in quality.sketched_profile(both, names).collect()}
    assert abs(got["few"]["n_distinct"] - 50) <= 1 and abs(got["many"]["n_distinct"] / 20000 - 1) < 0.08
    assert [got[n]["is_sure"] for n in names] == [True, True, False]
    exact = {r["feature"]: r["is_category"] for r in quality.settled_profile(df, both, names).collect()}
    assert exact == {"few": True, "many": False, "half": False}


def test_growing_files_give_each_line_once(spark, tmp_path, monkeypatch):
    folder, out = tmp_path / "logs", scratch_path(spark, "grown")
    folder.mkdir()
    steps = [
        {"a.log": "one\ntwo\nhalf", "b.log": "x" * 300 + "\n"},
        {"a.log": " line\n\nthree\n"},
        {"a.log": "", "c.log": "né\r\nlast without an end"},
        {"b.log": "y\n", "c.log": "\n"},
    ]
    for step in steps:
        for name, text in step.items():
            with open(folder / name, "a", encoding="utf-8", newline="") as f:
                f.write(text)
        stream = growing.tail_growing(spark, str(folder))
        tail.append_to(stream, f"{out}/d", f"{out}/c", {"availableNow": True}).awaitTermination()
    got = sorted((r.file.rsplit("/", 1)[1], r.offset, r.line) for r in spark.read.parquet(f"{out}/d").collect())
    assert got == [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "half line"), ("a.log", 19, "three"),
                   ("b.log", 0, "x" * 300), ("b.log", 301, "y"), ("c.log", 0, "né"), ("c.log", 5, "last without an end")]


def test_ranges_of_a_file_cut_lines_nowhere(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "LOOK_BACK", 3)
    lines = [f"{'z' * (k % 11)}{k}" for k in range(200)]
    (tmp_path / "f").write_text("\n".join(lines) + "\n")
    reader = growing.GrowingReader(str(tmp_path))
    size = (tmp_path / "f").stat().st_size
    got = [x for a in range(0, size, 7) for x in reader.read(growing.Range(str(tmp_path / "f"), a, min(a + 7, size)))]
    assert [x[2] for x in got] == lines
    with pytest.raises(ValueError, match="shrank"):
        reader.partitions({"sizes": json.dumps({"f": 5})}, {"sizes": json.dumps({"f": 4})})


def read_by_scan(df):
    """Rows of a plan without exchanges, and how many files and rows its scan read."""
    got = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return got, *(leaf.metrics().apply(name).value() for name in ("numFiles", "numOutputRows"))


def test_files_that_cannot_match_are_not_read(spark):
    root = scratch_path(spark, "zones")
    cells = [("a", at(k), k, float("nan") if k == 7 else k / 2, f"e{k * 37 % 1000:03d}", None if k < 100 else k) for k in range(1000)]
    store.append(batch(spark, cells, "n int, x double, e string, late int").repartition(5), root, chunk_rows=50, lookup=["e"])
    assert store.read(spark, root).select("_metadata.file_path").distinct().count() == 20

    def found(**filters):
        got, files_read, rows_read = read_by_scan(store.query(spark, root, filters=filters))
        return sorted(r.n for r in got), files_read, rows_read

    # Rows lie in time order, so one value of a column that grows with time lies in one file of the batch.
    assert found(n=421)[:2] == ([421], 1)
    assert found(n=[421, 422, 901])[:2] == ([421, 422, 901], 2)
    assert found(n=421.0)[:2] == ([421], 1)
    assert found(n=5000) == ([], 0, 0) and found(x=0.25)[0] == []
    assert found(late=10)[1] == 0 and found(late=150)[:2] == ([150], 1)
    assert found(x=float("nan"))[0] == [7]
    # Texts are spread over all files; Bloom filters leave out the row groups of nearly all others.
    values, files_read, rows_read = found(e="e037")
    assert values == [1] and rows_read <= 150
    span = store.without_files(store.read(spark, root), root, at(100), at(149))
    assert read_by_scan(span)[1:] == (1, 50)
    with pytest.raises(ValueError, match="no column"):
        store.query(spark, root, filters={"absent": 1})


def test_zones_only_leave_out(spark):
    root = scratch_path(spark, "zones")
    long = "y" * 100
    store.append(batch(spark, [("a", at(0), long + "1"), ("a", at(1), long + "2"), ("a", None, None)], "e string"), root, lookup=["e"])
    # Texts of this batch have no ranges, of the next no column, and the last no values.
    store.append(batch(spark, [("b", at(2), "z")], "e string"), root)
    store.append(batch(spark, [("c", at(3), 1)], "n int"), root)
    store.append(batch(spark, [("d", at(4), None)], "e string"), root, lookup=["e"])
    for wanted, batches in ((long + "2", ["a"]), ("z", ["b"]), (["z", long + "1"], ["a", "b"]), ("q", [])):
        assert sorted(r.batch_id for r in store.query(spark, root, filters={"e": wanted}).collect()) == batches
    assert [r.batch_id for r in store.query(spark, root, filters={"n": 1}).collect()] == ["c"]
    assert store.query(spark, root, filters={"e": None}).count() == 0
    # A batch written again has new files, a dropped one none, a dataset without zones is read as a whole.
    store.append(batch(spark, [("b", at(2), "w")], "e string"), root, lookup=["e"])
    assert [r.batch_id for r in store.query(spark, root, filters={"e": "w"}).collect()] == ["b"]
    store.drop_batches(spark, root, ["a"])
    assert sorted(r.batch_id for r in store.query(spark, root, start=at(0)).collect()) == ["b", "c", "d"]
    store._delete(spark, f"{root}/zones")
    assert [r.batch_id for r in store.query(spark, root, filters={"e": "w"}).collect()] == ["b"]
    store.drop_batches(spark, root, ["b"])
    assert store.query(spark, root, filters={"e": "w"}).count() == 0
    with pytest.raises(ValueError, match="lacks columns"):
        store.append(batch(spark, [("b", at(2), "w")], "e string"), root, lookup=["f"])
