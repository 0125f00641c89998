"""Scans, sinks, stored datasets, labelled datasets and experiment plans."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefuse.functions import texts
from tidefuse.operators import rollup
from tidefuse.plans import experiments
from tidefuse.session import listing, scratch_path
from tidefuse.sources import files, registry, rotate, samples, store
from workload.base import (
    EV, devices, events, hosts, query, r6, records, rounded, sql_devices, sql_hosts, sql_records, table,
)

TIME_FORMAT = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def csv_copy(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.options(header=True, **TIME_FORMAT).csv(path)
    return path


# --- scans of sample files -------------------------------------------------------

@query("scan_gpu", f"""WITH {EV}, {sql_devices()} SELECT * FROM dev""")
def scan_gpu(spark, sf_dir):
    return samples.scan_csv(spark, csv_copy(devices(events(spark, sf_dir)), "gpu"), samples.DEVICE)


@query("scan_system", f"""WITH {EV}, {sql_hosts()} SELECT run_id, timestamp, cpu_percent AS sys_cpu_percent,
  memory_percent AS sys_memory_percent, disk_percent AS sys_disk_percent, CASE WHEN cpu_percent < 20 THEN state END AS sys_state FROM host""")
def scan_system(spark, sf_dir):
    """Two kinds of files in one folder: of different columns, in different order."""
    host = hosts(events(spark, sf_dir))
    path = csv_copy(host.where("cpu_percent < 20"), "system")
    other = host.where("NOT cpu_percent < 20").select("disk_percent", "timestamp", "run_id", "cpu_percent", "memory_percent")
    other.write.options(header=True, **TIME_FORMAT).mode("append").csv(path)
    return rollup.host_samples(samples.scan_csv(spark, path, samples.HOST))


@query("scan_training", f"WITH {EV}, {sql_records()} SELECT * FROM rec")
def scan_training(spark, sf_dir):
    return samples.scan_csv(spark, csv_copy(records(events(spark, sf_dir)), "training"), samples.RECORD)


@query("sink_csv_roundtrip", f"WITH {EV} SELECT event_id, timestamp, run_id, value, event_type FROM ev")
def sink_csv_roundtrip(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", "timestamp", "run_id", "value", "event_type")
    path = scratch_path(spark, "csv")
    ev.write.options(header=True, **TIME_FORMAT).csv(path)
    return spark.read.schema(ev.schema).csv(path, header=True)


@query("parse_device_csv", f"""WITH {EV} SELECT event_id, user_id % 4 AS gpu_id, 'Device ' || (user_id % 3) AS name,
  CASE WHEN k % 5 = 0 THEN 0 ELSE k END AS utilization_gpu, k AS utilization_memory,
  CASE WHEN k = 1 THEN 0 ELSE 32768 END AS memory_total, CAST(floor(value * 50) AS BIGINT) AS memory_used,
  32768 - CAST(floor(value * 50) AS BIGINT) AS memory_free, k + 20 AS temperature,
  CASE WHEN k % 6 = 0 THEN 0 ELSE p + 0.5 END AS power_draw,
  CASE WHEN k = 1 THEN 0 ELSE round(floor(value * 50) / 32768 * 100, 6) END AS memory_percent
FROM ev WHERE k % 9 <> 8 AND k % 9 <> 7""")
def parse_device_csv(spark, sf_dir):
    """Lines of a device query; some too short, some with an unreadable number."""
    k, used = F.col("k"), F.floor(F.col("value") * 50)
    missing = F.lit("[Not Supported]")
    whole = F.concat_ws(
        ", ", F.col("user_id") % 4, F.concat(F.lit("Device "), (F.col("user_id") % 3).cast("string")),
        F.when(k % 5 == 0, missing).otherwise(k.cast("string")), k.cast("string"),
        F.when(k == 1, "0").otherwise("32768"), F.when(k % 9 == 7, F.lit("n/a")).otherwise(used.cast("string")),
        (32768 - used).cast("string"), (k + 20).cast("string"),
        F.when(k % 6 == 0, missing).otherwise((F.col("p") + 0.5).cast("string")),
    )
    line = F.when(k % 9 == 8, F.lit("3, Device 1, 17")).otherwise(whole)
    return rounded(samples.device_query_rows(events(spark, sf_dir).select("event_id", line.alias("line"))))


# --- run folders ------------------------------------------------------------------

#: A local disk starts a process per file that Hadoop makes, and a checksum file is one too. Other stores do not read this.
LEAN_LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def run_folders(spark: SparkSession, sf_dir: str) -> str:
    """A folder per user with up to three source files, written by Spark; some runs left an empty folder."""
    root = scratch_path(spark, "runs")
    ev = events(spark, sf_dir).withColumns({"run": F.col("user_id"), "value": F.concat_ws(",", "event_id", "k")})
    names = F.array(*map(F.lit, files.REQUIRED_FILES))
    held = F.filter(names, lambda x, i: ((i == 0) | ((F.col("user_id") + i) % 7 != 0)))
    rows = ev.where("user_id % 11 <> 5").select("run", F.explode(held).alias("file"), "value")
    # A run's files are written by one task, so that its folder is made once.
    rows.repartition("run").write.partitionBy("run", "file").options(**LEAN_LOCAL_FILES).text(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in ev.where("user_id % 11 = 5").select("run").distinct().collect():
        system.mkdirs(path(f"{root}/run={row['run']}"))
    return root


def as_run_files(spark: SparkSession, root: str) -> DataFrame:
    """Spark names part files itself; the folder around one stands for the file's name."""
    return files.list_files(spark, root).withColumns({
        "file": F.regexp_extract("path", r"/file=([^/]+)/", 1), "run_id": F.regexp_extract("path", r"/run=([^/]+)/", 1)})


@query("run_completeness", """WITH u AS (SELECT DISTINCT user_id FROM events)
SELECT CAST(user_id AS VARCHAR) AS run_id, CASE WHEN user_id % 11 = 5 THEN 'gpu_metrics.csv,system_metrics.csv,training_metrics.csv'
  ELSE concat_ws(',', CASE WHEN (user_id + 1) % 7 = 0 THEN 'system_metrics.csv' END,
  CASE WHEN (user_id + 2) % 7 = 0 THEN 'training_metrics.csv' END) END AS missing,
  user_id % 11 <> 5 AND (user_id + 1) % 7 <> 0 AND (user_id + 2) % 7 <> 0 AS complete FROM u""")
def run_completeness(spark, sf_dir):
    """Runs that left nothing but a folder are reported too."""
    root = run_folders(spark, sf_dir)
    runs = files.list_runs(spark, root).select(F.regexp_replace("run_id", "^run=", "").alias("run_id"))
    return files.run_completeness(as_run_files(spark, root), runs=runs)


@query("file_inventory", f"""WITH {EV}, lines AS (SELECT user_id, unnest([0, 1, 2]) AS i, strlen(event_id || ',' || k) + 1 AS n FROM ev),
held AS (SELECT * FROM lines WHERE user_id % 11 <> 5 AND (i = 0 OR (user_id + i) % 7 <> 0))
SELECT CAST(user_id AS VARCHAR) AS run_id, count(DISTINCT i) AS files, CAST(sum(n) AS BIGINT) AS bytes, 0 AS matrices FROM held GROUP BY 1""")
def file_inventory(spark, sf_dir):
    """Files and bytes per run; a line is its text and a line feed."""
    return files.file_inventory(as_run_files(spark, run_folders(spark, sf_dir)))


# --- stored datasets ----------------------------------------------------------------

STORED_SQL = f"""{EV}, stored AS (SELECT event_id, timestamp, run_id AS experiment_id, strftime(timestamp, 'day_%Y%m%d') AS batch_id,
  CASE k % 3 WHEN 0 THEN 'bert' WHEN 1 THEN 'gpt' ELSE 'vit' END AS model_type,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_anomaly, m AS train_loss, k AS train_step FROM ev)"""


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return events(spark, sf_dir).select(
        "event_id", "timestamp", F.col("run_id").alias("experiment_id"),
        F.date_format("timestamp", "'day_'yyyyMMdd").alias("batch_id"),
        F.when(k % 3 == 0, "bert").when(k % 3 == 1, "gpt").otherwise("vit").alias("model_type"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_anomaly"),
        F.col("m").alias("train_loss"), k.alias("train_step"),
    )


def stored(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "store")
    store.append(stored_rows(spark, sf_dir), root)
    return root


@query("store_append", f"WITH {STORED_SQL} SELECT * FROM stored")
def store_append(spark, sf_dir):
    """Three appends: a batch written incompletely, one that is refused for its types, and the whole batch."""
    root = scratch_path(spark, "store")
    rows = stored_rows(spark, sf_dir)
    store.append(rows.where((F.col("batch_id") != "day_20240102") | (F.col("train_step") > 50)), root)
    whole = rows.where(F.col("batch_id") == "day_20240102")
    try:
        store.append(whole.withColumn("train_loss", F.lit("high")), root)
    except ValueError:
        pass
    else:
        raise AssertionError("a text is no number")
    store.append(whole.withColumn("is_anomaly", F.col("is_anomaly").cast("smallint")), root, batch_ids=["day_20240102"])
    return store.read(spark, root)


@query("store_totals", f"""WITH {STORED_SQL} SELECT count(DISTINCT batch_id) AS batches, min(timestamp) AS min_timestamp,
  max(timestamp) AS max_timestamp, count(*) AS total_records, CAST(sum(is_anomaly) AS BIGINT) AS total_anomalies FROM stored""")
def store_totals(spark, sf_dir):
    """One call per arrival checks, cleans, writes, indexes and brings the catalog's totals up to date."""
    root = scratch_path(spark, "catalog")
    store.create_dataset(spark, root, "runs", {"train_loss": "float", "is_anomaly": "int"})
    rows = stored_rows(spark, sf_dir)
    store.add_batches(rows.where(F.col("batch_id") < "day_20240116"), root, "runs")
    return store.add_batches(rows.where(F.col("batch_id") >= "day_20240116"), root, "runs")


@query("scan_batch", f"WITH {STORED_SQL} SELECT event_id, timestamp, train_loss FROM stored WHERE batch_id = 'day_20240110'")
def scan_batch(spark, sf_dir):
    return store.scan_batch(spark, stored(spark, sf_dir), "day_20240110", ["event_id", "timestamp", "train_loss"])


@query("batch_index", f"""WITH {STORED_SQL} SELECT batch_id, min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp,
  count(*) AS record_count, CAST(sum(is_anomaly) AS BIGINT) AS anomaly_count FROM stored GROUP BY 1""")
def batch_index(spark, sf_dir):
    return store.read_index(spark, stored(spark, sf_dir))


@query("global_index", f"""WITH {STORED_SQL} SELECT count(DISTINCT batch_id) AS batches, min(timestamp) AS min_timestamp,
  max(timestamp) AS max_timestamp, count(*) AS total_records, CAST(sum(is_anomaly) AS BIGINT) AS total_anomalies FROM stored""")
def global_index(spark, sf_dir):
    return store.global_index(store.batch_index(stored_rows(spark, sf_dir)))


@query("store_info", f"""WITH {STORED_SQL}, per AS (SELECT batch_id, count(*) AS n FROM stored GROUP BY 1)
SELECT (SELECT count(*) FROM per) AS batches, min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp,
  count(*) AS total_records, CAST(sum(is_anomaly) AS BIGINT) AS total_anomalies,
  (SELECT CAST(sum(ceil(n / 500.0)) AS BIGINT) FROM per) AS file_count, true AS has_bytes FROM stored""")
def store_info(spark, sf_dir):
    """Rows, batches and files; a batch is cut into files of at most 500 rows. Only the bytes are Spark's own."""
    root = scratch_path(spark, "store")
    store.append(stored_rows(spark, sf_dir), root, chunk_rows=500)
    return store.store_info(spark, root).withColumn("has_bytes", F.col("bytes") > 0).drop("bytes")


@query("store_drop_batch", f"""WITH {STORED_SQL} SELECT batch_id, count(*) AS n FROM stored
WHERE batch_id NOT IN ('day_20240103', 'day_20240104') GROUP BY 1""")
def store_drop_batch(spark, sf_dir):
    root = stored(spark, sf_dir)
    store.drop_batches(spark, root, ["day_20240103", "day_20240104"])
    return store.read(spark, root).groupBy("batch_id").agg(F.count("*").alias("n"))


@query("store_export", f"WITH {STORED_SQL} SELECT event_id, timestamp, experiment_id, batch_id, model_type, is_anomaly, train_loss, train_step FROM stored")
def store_export(spark, sf_dir):
    rows = stored_rows(spark, sf_dir)
    path = store.export(rows, scratch_path(spark, "export"), "json")
    return spark.read.schema(rows.schema).json(path)


@query("sink_rotation", f"""WITH {EV} SELECT event_id, event_type, true AS bounded FROM ev""")
def sink_rotation(spark, sf_dir):
    """Rows of very different width in files of at most 200,000 bytes; read back with the size of their file."""
    path = scratch_path(spark, "rotated")
    wide = events(spark, sf_dir).select("event_id", "event_type", "timestamp", F.expr("repeat('x', CAST(k * 5 AS INT))").alias("pad"))
    rotate.rotate(wide, path, 200_000, ["timestamp", "event_id"])
    with listing(spark):
        written = spark.read.text(path)
    read = written.select("value", F.col("_metadata.file_size").alias("n"))
    fields = F.from_json("value", "event_id long, event_type string").alias("e")
    return read.select(fields, (F.col("n") <= 200_000).alias("bounded")).select("e.event_id", "e.event_type", "bounded")


START, END = datetime(2024, 1, 5, 12), datetime(2024, 1, 9, 6)
SPAN_SQL = "timestamp BETWEEN TIMESTAMP '2024-01-05 12:00:00' AND TIMESTAMP '2024-01-09 06:00:00'"


@query("query_time_range", f"WITH {STORED_SQL} SELECT event_id, timestamp, batch_id FROM stored WHERE {SPAN_SQL}")
def query_time_range(spark, sf_dir):
    return store.query(spark, stored(spark, sf_dir), START, END, columns=["event_id", "timestamp", "batch_id"])


@query("query_lookup", f"""WITH {STORED_SQL} SELECT event_id, experiment_id, timestamp, train_step FROM stored
WHERE experiment_id IN ('run_1', 'run_5') AND train_step >= 10 AND is_anomaly = 1 AND {SPAN_SQL}""")
def query_lookup(spark, sf_dir):
    """Equality and a time range on a stored dataset: ranges per file and Bloom filters leave out what cannot match."""
    root = scratch_path(spark, "lookup")
    store.append(stored_rows(spark, sf_dir), root, chunk_rows=200, lookup=["experiment_id"])
    found = store.query(spark, root, START, END, filters={"experiment_id": ["run_1", "run_5"], "is_anomaly": 1})
    return found.where("train_step >= 10").select("event_id", "experiment_id", "timestamp", "train_step")


@query("query_filters", f"""WITH {STORED_SQL} SELECT event_id, model_type, is_anomaly FROM stored
WHERE model_type IN ('bert', 'vit') AND is_anomaly = 1""")
def query_filters(spark, sf_dir):
    out = store.select_rows(
        stored_rows(spark, sf_dir), filters={"model_type": ["bert", "vit"], "is_anomaly": 1, "absent": 3},
        ignore_unknown=True,
    )
    return out.select("event_id", "model_type", "is_anomaly")


@query("query_projection", f"WITH {STORED_SQL} SELECT event_id FROM stored WHERE model_type = 'gpt'")
def query_projection(spark, sf_dir):
    """The filter column is not selected."""
    return store.select_rows(
        stored_rows(spark, sf_dir), filters={"model_type": "gpt"}, columns=["event_id", "absent"]
    )


@query("query_limit", f"WITH {STORED_SQL} SELECT event_id, timestamp FROM stored ORDER BY timestamp, event_id LIMIT 250")
def query_limit(spark, sf_dir):
    return store.select_rows(
        stored_rows(spark, sf_dir), columns=["event_id", "timestamp"], limit=250, order=["timestamp", "event_id"]
    )


@query("query_experiments", f"""WITH {STORED_SQL} SELECT event_id, model_type, dataset_type, fault_type FROM (
  SELECT *, 'imdb' AS dataset_type, CASE WHEN experiment_id < 'run_4' THEN 'baseline' ELSE 'nan_loss' END AS fault_type FROM stored)
WHERE {SPAN_SQL} AND model_type IN ('gpt', 'vit') AND fault_type = 'nan_loss' AND is_anomaly = 1""")
def query_experiments(spark, sf_dir):
    rows = stored_rows(spark, sf_dir).withColumns({
        "dataset_type": F.lit("imdb"),
        "fault_type": F.when(F.col("experiment_id") < "run_4", "baseline").otherwise("nan_loss"),
    })
    out = store.query_experiments(
        rows, START, END, model_types=["gpt", "vit"], dataset_types=["imdb"], fault_types=["nan_loss"],
        anomaly_only=True,
    )
    return out.select("event_id", "model_type", "dataset_type", "fault_type")


@query("schema_conform", f"""WITH {EV} SELECT event_id, 0 AS gpu_memory_total, 0.0::DOUBLE AS gpu_temperature, '' AS note, false AS flag,
  CAST(NULL AS TIMESTAMP) AS seen FROM ev""")
def schema_conform(spark, sf_dir):
    schema = {"event_id": "int", "gpu_memory_total": "int", "gpu_temperature": "float", "note": "str", "flag": "bool",
              "seen": "datetime"}
    return store.conform(events(spark, sf_dir).select("event_id"), schema)


@query("type_coerce", f"""WITH {EV} SELECT event_id, CASE WHEN k % 5 = 0 THEN 0 WHEN k % 5 = 1 THEN k ELSE CAST(trunc(value) AS BIGINT) END AS n,
  CASE WHEN k % 5 = 0 THEN 0 WHEN k % 5 = 1 THEN k ELSE round(value, 2) END AS x, k % 5 <> 4 AS flag,
  CASE WHEN k % 5 <> 0 THEN date_trunc('second', timestamp) END AS seen FROM ev""")
def type_coerce(spark, sf_dir):
    k = F.col("k") % 5
    text = F.when(k == 0, F.lit("n/a")).when(k == 1, F.col("k").cast("string")).otherwise(F.format_string("%.2f", "value"))
    raw = events(spark, sf_dir).select(
        "event_id", text.alias("n"), text.alias("x"), F.when(k != 4, F.lit("False")).otherwise(F.lit("")).alias("flag"),
        F.when(k != 0, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("soon")).alias("seen"),
    )
    return store.coerce_types(raw, {"n": "int", "x": "float", "flag": "bool", "seen": "datetime"})


@query("tag_lineage", f"""WITH {STORED_SQL} SELECT event_id, 'exp_1' AS experiment_id, 'bert' AS model_type, 'imdb' AS dataset_type,
  'baseline' AS fault_type FROM stored""")
def tag_lineage(spark, sf_dir):
    return store.tag_lineage(events(spark, sf_dir).select("event_id"), "exp_1", "bert", "imdb")


@query("chunk_numbers", f"""WITH {STORED_SQL}, n AS (SELECT batch_id, event_id,
  row_number() OVER (PARTITION BY batch_id ORDER BY timestamp, event_id) - 1 AS position FROM stored)
SELECT batch_id, event_id, position, CAST(position // 100 AS BIGINT) AS chunk_no FROM n""")
def chunk_numbers(spark, sf_dir):
    rows = stored_rows(spark, sf_dir).select("batch_id", "event_id", "timestamp")
    return store.chunk_numbers(rows, ["timestamp", "event_id"], 100).drop("timestamp")


@query("union_batches", f"""WITH {EV} SELECT event_id, m AS train_loss, NULL AS train_step FROM ev WHERE k % 2 = 0
UNION ALL SELECT event_id, NULL, k FROM ev WHERE k % 2 = 1""")
def union_batches(spark, sf_dir):
    ev = events(spark, sf_dir)
    left = ev.where(F.col("k") % 2 == 0).select("event_id", F.col("m").alias("train_loss"))
    right = ev.where(F.col("k") % 2 == 1).select(F.col("k").alias("train_step"), "event_id")
    return store.union_batches(left, right)


@query("enabled_metrics", """WITH m AS (SELECT p_brand AS source, p_type AS category, p_name AS metric, p_size % 3 <> 0 AS enabled FROM part)
SELECT source, category, metric FROM m WHERE enabled""")
def enabled_metrics(spark, sf_dir):
    metrics = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("source"), F.col("p_type").alias("category"), F.col("p_name").alias("metric"),
        (F.col("p_size") % 3 != 0).alias("enabled"),
    )
    return registry.enabled_metrics(metrics)


# --- labelled datasets ---------------------------------------------------------------

def split_of(doc_id):
    return F.when(doc_id % 10 < 7, "train").when(doc_id % 10 == 7, "valid").otherwise("test")


SQL_SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'valid' ELSE 'test' END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("split", split_of(F.col("doc_id")))


@query("dataset_registry", f"""SELECT {SQL_SPLIT} AS split, doc_id, text, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS label FROM documents""")
def dataset_registry(spark, sf_dir):
    """A registered dataset is read by name; only its columns are scanned."""
    path = scratch_path(spark, "imdb")
    label = F.when(F.col("lang") == "en", 1).otherwise(0)
    documents(spark, sf_dir).withColumn("label", label).write.parquet(path)
    return registry.load_dataset(spark, "imdb_sentiment", path, order="doc_id")


@query("custom_dataset_check", f"""SELECT {SQL_SPLIT} AS split, count(*) AS n_rows, count(*) FILTER (quality IS NULL) AS n_broken
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def custom_dataset_check(spark, sf_dir):
    labelled = documents(spark, sf_dir).join(
        table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left"
    )
    return registry.required_nulls(labelled, ["text", "label"])


@query("split_cap", f"""WITH d AS (SELECT doc_id, {SQL_SPLIT} AS split, n_chars FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS rn FROM d)
SELECT doc_id, split, n_chars FROM r WHERE rn <= CASE split WHEN 'train' THEN 500 WHEN 'test' THEN 100 ELSE rn END""")
def split_cap(spark, sf_dir):
    capped = registry.cap_splits(documents(spark, sf_dir), {"train": 500, "test": 100}, "split", "doc_id")
    return capped.select("doc_id", "split", "n_chars")


@query("label_distribution", f"""SELECT {SQL_SPLIT} AS split, quality AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def label_distribution(spark, sf_dir):
    labelled = documents(spark, sf_dir).select("doc_id", "split").join(
        table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left"
    )
    return registry.label_distribution(labelled)


SQL_WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"


@query("truncate_text", f"SELECT doc_id, array_to_string({SQL_WORDS}[1:512], ' ') AS text FROM documents")
def truncate_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", texts.truncate_words(F.col("text"), 512).alias("text"))


@query("overlap_chunks", f"""WITH w AS (SELECT doc_id, {SQL_WORDS} AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(0, greatest(0, CAST(ceil((len(words) - 384) / 256.0) AS BIGINT)) * 256 + 1, 256)) AS first_word
  FROM w WHERE len(words) > 0)
SELECT doc_id, first_word // 256 AS chunk_no, first_word, len(words[first_word + 1:first_word + 384]) AS n_words,
  array_to_string(words[first_word + 1:first_word + 384], ' ') AS chunk FROM s""")
def overlap_chunks(spark, sf_dir):
    return texts.overlapping_chunks(documents(spark, sf_dir).select("doc_id", "text"), "text")


@query("batched_map", "SELECT doc_id, length(text) AS n, lang || '/' || source AS tag FROM documents")
def batched_map(spark, sf_dir):
    """A user function over batches; it sees whole texts, its input columns are dropped."""

    def measure(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "doc_id": batch["doc_id"], "n": batch["text"].str.len(), "tag": batch["lang"] + "/" + batch["source"]
        })

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return registry.batched_map(docs, measure, "doc_id long, n long, tag string")


@query("split_export", f"SELECT doc_id, {SQL_SPLIT} AS split, lang, text FROM documents")
def split_export(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "lang", "text", "split")
    path = store.export(rows, scratch_path(spark, "splits"), "json", by=["split"])
    return spark.read.schema("doc_id long, lang string, text string, split string").json(path)


# --- experiment plans ------------------------------------------------------------------

DATASETS = ("imdb_sentiment", "glue_sst2")
FAULTS = ("baseline", "nan_loss", "oom")
SQL_PLAN = """dims AS (SELECT d, f FROM (VALUES ('imdb_sentiment'), ('glue_sst2')) a(d), (VALUES ('baseline'), ('nan_loss'), ('oom')) b(f)),
plan AS (SELECT p_name || ' ' || p_partkey || '_' || d || '_' || f AS experiment_id, p_type AS model_type, p_name || ' ' || p_partkey AS model_name,
  d AS dataset_type, f AS fault_type, 'pending' AS status, p_partkey FROM part, dims)"""


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_name", "p_partkey").alias("model_name"), F.col("p_type").alias("model_type")
    )


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.combine(models(spark, sf_dir), DATASETS, FAULTS)


@query("plan_cross", f"WITH {SQL_PLAN} SELECT * EXCLUDE (p_partkey) FROM plan")
def plan_cross(spark, sf_dir):
    return plan(spark, sf_dir)


OUTCOME_SQL = f"""{SQL_PLAN}, agg AS (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
outcome AS (SELECT p_name || ' ' || p_partkey || '_imdb_sentiment_' || f AS experiment_id, n % 4 <> 0 AS success, q AS duration,
  n AS anomaly_count, n / 128.0 AS final_accuracy, p_type AS model_type, q AS training_time
  FROM part JOIN agg ON p_partkey = l_partkey, (VALUES ('baseline'), ('oom')) b(f)),
updated AS (SELECT plan.*, success, duration, anomaly_count, final_accuracy,
  CASE WHEN success THEN 'completed' WHEN NOT success THEN 'failed' ELSE status END AS new_status FROM plan LEFT JOIN outcome USING (experiment_id))"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the runs on the first dataset without the middle fault, measured on line items."""
    per_part = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("q")
    )
    # A broadcast would be chosen by the compressed size of the part table's file.
    run = table(spark, sf_dir, "part").hint("merge").join(per_part, "p_partkey").withColumn(
        "f", F.explode(F.array(F.lit("baseline"), F.lit("oom")))
    )
    name = F.concat_ws(" ", "p_name", "p_partkey")
    return run.select(
        F.concat_ws("_", name, F.lit("imdb_sentiment"), "f").alias("experiment_id"),
        (F.col("n") % 4 != 0).alias("success"), F.col("q").alias("duration"),
        F.col("n").alias("anomaly_count"), (F.col("n") / 128.0).alias("final_accuracy"),
    )


def updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every experiment ran twice; the first time it came to the opposite result, and some have no time of that."""
    last = outcomes(spark, sf_dir)
    times = F.when(F.col("anomaly_count") % 3 != 0, F.lit("2024-01-01 10:00:00"))
    first = last.withColumns({"success": ~F.col("success"), "duration": F.col("duration") + 1, "end_time": times})
    both = first.unionByName(last.withColumn("end_time", F.lit("2024-01-01 11:00:00")))
    return experiments.update(plan(spark, sf_dir), both).drop("end_time")


@query("plan_update", f"""WITH {OUTCOME_SQL} SELECT experiment_id, new_status AS status, success, duration, anomaly_count,
  final_accuracy FROM updated""")
def plan_update(spark, sf_dir):
    return updated(spark, sf_dir).select(
        "experiment_id", "status", "success", "duration", "anomaly_count", "final_accuracy"
    )


@query("plan_pending", f"WITH {OUTCOME_SQL} SELECT experiment_id, new_status AS status FROM updated WHERE new_status <> 'completed'")
def plan_pending(spark, sf_dir):
    return experiments.to_run(updated(spark, sf_dir)).select("experiment_id", "status")


@query("plan_report", f"""WITH {OUTCOME_SQL} SELECT fault_type, count(*) AS total_experiments, count(*) FILTER (new_status = 'completed') AS completed,
  count(*) FILTER (new_status = 'failed') AS failed, count(*) FILTER (new_status = 'pending') AS pending,
  round(count(*) FILTER (new_status = 'completed') / count(*), 6) AS success_rate,
  round(coalesce(avg(duration) FILTER (success), 0), 6) AS average_duration,
  CAST(coalesce(sum(anomaly_count) FILTER (success), 0) AS BIGINT) AS total_anomalies,
  round(coalesce(avg(final_accuracy) FILTER (success), 0), 6) AS average_accuracy FROM updated GROUP BY 1""")
def plan_report(spark, sf_dir):
    return rounded(experiments.report(updated(spark, sf_dir), ["fault_type"]))


@query("model_performance", f"""WITH {OUTCOME_SQL} SELECT model_type, round(avg(final_accuracy), 6) AS average_accuracy,
  round(stddev_pop(final_accuracy), 6) AS std_accuracy, count(*) AS n FROM updated WHERE success GROUP BY 1""")
def model_performance(spark, sf_dir):
    return rounded(experiments.model_performance(updated(spark, sf_dir)))


@query("training_outcomes", f"""WITH {OUTCOME_SQL} SELECT success, count(*) AS models,
  round(sum(CASE WHEN success THEN duration ELSE 0 END), 6) AS total_training_time FROM outcome GROUP BY 1""")
def training_outcomes(spark, sf_dir):
    return rounded(experiments.outcome_totals(outcomes(spark, sf_dir).withColumnRenamed("duration", "training_time")))


@query("plan_rows", f"WITH {SQL_PLAN} SELECT 'plan_' || fault_type AS plan_name, experiment_id, model_type, dataset_type, fault_type, status FROM plan")
def plan_rows(spark, sf_dir):
    """Plans written as nested JSON documents, one per plan and model with all its combinations, and unfolded again."""
    rows = plan(spark, sf_dir)
    entry = F.struct(
        "experiment_id", F.struct("model_type", "model_name").alias("model_config"),
        F.struct("dataset_type").alias("dataset_config"), F.struct("fault_type").alias("fault_config"), "status",
    )
    documents_ = rows.groupBy(F.concat(F.lit("plan_"), F.col("fault_type")).alias("plan_name"), "model_name").agg(
        F.collect_list(entry).alias("experiment_combinations")
    ).drop("model_name")
    path = scratch_path(spark, "plans")
    documents_.write.json(path)
    read = spark.read.schema(experiments.PLAN_SCHEMA).json(path)
    return experiments.plan_rows(read).select(
        "plan_name", "experiment_id", "model_type", "dataset_type", "fault_type", "status"
    )
