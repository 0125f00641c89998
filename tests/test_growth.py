"""Work and memory that grow no faster than the input."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from helpers import at, rows
from tidefuse.operators.blocks import scan
from tidefuse.plans import experiments
from tidefuse.session import LISTING_SETTING, few_tasks, scratch_path
from tidefuse.sources import files, store
from tidefuse.streaming import counters, tail
from workload import storage, streams


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan_text_after(df) -> str:
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString()


def test_unfolded_plan_is_not_broadcast(spark, tmp_path):
    spark.range(300).selectExpr("concat('m ', id) AS model_name", "concat('t', id % 3) AS model_type").write.parquet(f"{tmp_path}/models")
    plan = experiments.combine(spark.read.parquet(f"{tmp_path}/models"), ["d1", "d2"], ["f1", "f2", "f3"])
    results = plan.selectExpr("experiment_id", "fault_type <> 'f2' AS success", "1.0D AS duration", "1L AS anomaly_count",
                              "0.5D AS final_accuracy", "'10:00' AS end_time")
    found = experiments.model_performance(experiments.update(plan, results))
    assert "Broadcast" not in plan_text(found)
    assert sorted(tuple(r) for r in found.collect()) == [(f"t{i}", 0.5, 0.0, 400) for i in range(3)]


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    """A task per folder costs more than the listing."""
    for i in range(300):
        (tmp_path / f"run {i}").mkdir()
        if i % 3:
            (tmp_path / f"run {i}" / "gpu_metrics.csv").write_text("x" * i)
    (tmp_path / "notes.txt").write_text("no run")
    before = spark.conf.get(LISTING_SETTING)
    spark.sparkContext.setJobGroup("listing", "")
    found = files.list_files(spark, str(tmp_path))
    tracker = spark.sparkContext.statusTracker()
    tasks = sum(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < tasks <= 32 and spark.conf.get(LISTING_SETTING) == before
    assert found.where("file <> 'notes.txt'").count() == 200
    assert {r.run_id for r in files.list_runs(spark, str(tmp_path)).collect()} == {f"run {i}" for i in range(300)}
    assert files.list_runs(spark, f"{tmp_path}/run 0").count() == 0


def test_inputs_of_a_scan_are_evaluated_once(spark):
    """No filter is made up of the expressions that a scan's rows come from."""
    rows = spark.range(200).selectExpr("id % 3 AS run", "id", "CAST(id / 50 AS LONG) AS _blk",
                                       "CASE WHEN id % 7 = 0 THEN get_json_object(concat('{\"k\": ', id, '}'), '$.k') END AS k")
    found = scan(rows, ["run"], ["id"], last={"k": F.col("k")})
    assert plan_text(found).count("get_json_object") <= 2  # one in each of the two passes, which share a shuffle
    expected = {i: str(max((j for j in range(i + 1) if j % 7 == 0 and j % 3 == i % 3), default="None")) for i in range(200)}
    assert {r.id: str(r.k) for r in found.collect()} == expected
    assert "ReusedExchange" in plan_text_after(found)


def test_backlog_takes_few_batches(spark, tmp_path):
    """Two files a batch, but the number of batches does not grow with the files that wait."""
    folder = tmp_path / "logs"
    folder.mkdir()
    for have, batches in ((5, 3), (200, 49)):  # 195 new files of a folder of 200, four a batch
        for i in range(have):
            if not (folder / f"{i}.log").exists():
                (folder / f"{i}.log").write_text(f"line {i}\nsame\n")
        query = tail.append_to(tail.tail_lines(spark, str(folder), files_per_batch=2), f"{tmp_path}/out/d",
                               f"{tmp_path}/out/c", {"availableNow": True})
        query.awaitTermination()
        assert len([p for p in query.recentProgress if p["numInputRows"]]) == batches
        got = [r.line for r in spark.read.parquet(f"{tmp_path}/out/d").collect()]
        assert sorted(got) == sorted([f"line {i}" for i in range(have)] + ["same"] * have)


def test_calls_and_state_do_not_grow_with_the_series(spark, tmp_path):
    """Three thousand series in two arrivals, one state row a group; integers beyond 2 ** 53 stay beside nulls."""
    big, schema = 2 ** 60 + 1, "run_id string, host_id long, timestamp timestamp_ntz, n long, bytes long"
    for part in range(2):
        cells = [("r" if i % 2 else None, i if i else None, at(100 * part + i % 7), big + i if i % 3 else None,
                  i * (part + 1) if i % 5 else None) for i in range(3000)]
        spark.createDataFrame(cells, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        counters.stream_counter_rates(stream, ["bytes"], f"{tmp_path}/out", trigger={"availableNow": True}).awaitTermination()
    got = {(r.run_id, r.host_id, r.timestamp): (r.n, r.bytes, r.bytes_rate) for r in counters.read_rates(spark, f"{tmp_path}/out").collect()}
    assert got == {("r" if i % 2 else "", i if i else None, at(100 * part + i % 7)): (
        big + i if i % 3 else None, i * (part + 1) if i % 5 else None, 0.0 if not part else i / 100 if i % 5 else None)
        for part in range(2) for i in range(3000)}
    assert spark.read.format("statestore").load(f"{tmp_path}/out/checkpoint").count() <= counters.SERIES_GROUPS


def test_files_left_out_are_one_text(spark, tmp_path, monkeypatch):
    """No literal per file, and a quote or a backslash in a path is part of the name."""
    cells = [("a", at(k), k) for k in range(60)] + [("b'c", at(k), k) for k in range(60, 90)]
    batch = spark.createDataFrame(cells, "batch_id string, timestamp timestamp_ntz, n int").coalesce(1)
    monkeypatch.setattr(store, "LISTED", 2, raising=False)
    plain, odd = f"{tmp_path}/plain", f"{tmp_path}/it's"
    for root in (plain, odd):
        store.append(batch, root, chunk_rows=10)
        assert store.read(spark, root).select("_metadata.file_path").distinct().count() == 9
        assert set(rows(store.read_index(spark, root), "batch_id", "min_timestamp", "max_timestamp", "record_count", "anomaly_count")) == {
            ("a", at(0), at(59), 60, None), ("b'c", at(60), at(89), 30, None)}
        for n in (33, 75):
            left = store.without_files(store.read(spark, root), root, filters={"n": n})
            assert left.select("_metadata.file_path").distinct().count() == 1
            assert [r.n for r in store.query(spark, root, filters={"n": n}).collect()] == [n]
    store.drop_batches(spark, plain, ["b'c"])
    literals = []
    monkeypatch.setattr(store.F, "lit", lambda value, lit=F.lit: literals.append(value) or lit(value))
    monkeypatch.setattr(Column, "isin", lambda self, *values: literals.extend(values))
    assert [r.n for r in store.query(spark, plain, filters={"n": 33}).collect()] == [33]
    assert not [v for v in literals if isinstance(v, str) and "parquet" in v]


def test_log_tail_reads_a_backlog_in_bounded_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BACKLOG_BATCHES", 4, raising=False)
    for i in range(30):
        (tmp_path / f"{i}.log").write_text(f"line {i}\n")
    out = scratch_path(spark, "tail")
    query = tail.append_to(tail.tail_lines(spark, str(tmp_path), files_per_batch=3), f"{out}/d", f"{out}/c", {"availableNow": True})
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [8, 8, 8, 6]
    assert spark.read.parquet(f"{out}/d").distinct().count() == 30


def test_files_of_a_batch_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    """A task per file in each batch costs more than reading the files; the setting holds while the stream runs."""
    for i in range(90):
        (tmp_path / f"{i}.log").write_text(f"line {i}\n")
    out, before, started = scratch_path(spark, "tail"), spark.conf.get(LISTING_SETTING), []
    monkeypatch.setattr(tail, "append_to", lambda *given, start=tail.append_to: started.append(start(*given)) or started[0])
    streams.drain(tail.tail_lines(spark, str(tmp_path), files_per_batch=45), out)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(started[0].runId) for s in tracker.getJobInfo(j).stageIds]
    assert len(stages) >= 4 and max(s.numTasks for s in stages) <= 32
    assert spark.conf.get(LISTING_SETTING) == before
    assert sorted(r.line for r in spark.read.parquet(f"{out}/data").collect()) == sorted(f"line {i}" for i in range(90))


def test_run_folders_are_made_once(spark, tmp_path):
    """A local disk starts a process per folder and file made: a run's folder is made by one task, without checksum files."""
    cells = [(i, at(i), i % 90, "view", 1.5, f'{{"k": {i}}}') for i in range(900)]
    spark.createDataFrame(cells, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .write.parquet(f"{tmp_path}/events.parquet")
    root = storage.run_folders(spark, str(tmp_path))
    folder = Path(root.removeprefix("file:"))
    assert not list(folder.rglob(".*.crc"))
    tasks, lines = {}, {}
    for f in folder.glob("run=*/file=*/*"):
        tasks.setdefault(f.parts[-3], set()).add(f.name.split("-")[1])
        lines[f.parts[-3], f.parts[-2]] = sorted(f.read_text().split())
    assert all(len(t) == 1 for t in tasks.values())
    assert lines == {(f"run={u}", f"file={name}"): sorted(f"{i},{i}" for i in range(u, 900, 90)) for u in range(90) if u % 11 != 5
                     for k, name in enumerate(files.REQUIRED_FILES) if k == 0 or (u + k) % 7}
    assert {r.run_id for r in files.list_runs(spark, root).collect()} == {f"run={u}" for u in range(90)}


def test_many_files_are_told_by_few_tasks(spark, tmp_path):
    """However little a task would take by size."""
    for i in range(300):
        (tmp_path / f"run {i}").mkdir()
        (tmp_path / f"run {i}" / "gpu_metrics.csv").write_text("x" * (i + 1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        found = files.list_files(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() <= few_tasks(spark)
        assert rows(files.file_inventory(found), "run_id", "files", "bytes") == sorted([(f"run {i}", 1, i + 1) for i in range(300)], key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
