"""Stored datasets: parquet by batch, with small tables of the ranges in batches and in files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefuse.functions.measures import TYPE_NAMES, coerce, type_default
from tidefuse.operators.blocks import range_blocks, scan
from tidefuse.operators.matrix import clean_values

# Declared columns and types of a stored matrix.
MATRIX_SCHEMA = {
    "timestamp": "datetime", "is_anomaly": "int",
    "gpu_utilization_gpu": "float", "gpu_utilization_memory": "float",
    "gpu_memory_total": "int", "gpu_memory_used": "int", "gpu_memory_free": "int",
    "gpu_temperature": "float", "gpu_power_draw": "float",
    "sys_cpu_percent": "float", "sys_memory_percent": "float", "sys_disk_usage": "float",
    "train_step": "int", "train_loss": "float", "train_learning_rate": "float",
    "train_throughput": "float", "train_step_time": "float",
    "eval_accuracy": "float", "eval_loss": "float", "event_anomaly": "int",
    "gpu_memory_utilization_ratio": "float", "train_step_rate": "float",
    "train_loss_change_rate": "float", "total_anomaly_events": "int",
}
CHUNK_ROWS = 10_000
FORMATS = ("parquet", "csv", "json")
#: Types whose ranges are kept per file. Of texts only a beginning is, and only where asked for.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
ZONED = (*NUMBERS, "timestamp_ntz", "date")
TEXT_PREFIX = 64
#: File names of one list in a filter.
LISTED = 10_000


def conform(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Add missing columns with their default; further columns stay."""
    missing = {
        c: type_default(w).cast(TYPE_NAMES.get(w, "string"))
        for c, w in schema.items() if c not in df.columns
    }
    return df.withColumns(missing) if missing else df


def coerce_types(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    types = dict(df.dtypes)
    changed = {c: coerce(F.col(c), w, types[c]) for c, w in schema.items() if c in types}
    return df.withColumns(changed) if changed else df


def tag_lineage(df: DataFrame, experiment_id: str, model_type: str, dataset_type: str,
                fault_type: str | None = None) -> DataFrame:
    return df.withColumns({
        "experiment_id": F.lit(experiment_id), "model_type": F.lit(model_type),
        "dataset_type": F.lit(dataset_type), "fault_type": F.lit(fault_type or "baseline"),
    })


def prepare(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    return clean_values(coerce_types(conform(df, schema), schema))


def chunk_numbers(df: DataFrame, order: Sequence[str], chunk_rows: int = CHUNK_ROWS,
                  keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Position and chunk of each row in its batch, for batches of any size."""
    counted = scan(range_blocks(df, keys, order), keys, order, total={"_n": F.lit(1)})
    return counted.select(
        *df.columns, (F.col("_n") - 1).alias("position"),
        F.floor((F.col("_n") - 1) / chunk_rows).alias("chunk_no"),
    )


def batch_index(df: DataFrame) -> DataFrame:
    """Time range, rows and anomalies per batch; null where the dataset has no such column."""
    time = F.col("timestamp") if "timestamp" in df.columns else F.lit(None).cast("timestamp_ntz")
    anomaly = F.col("is_anomaly") if "is_anomaly" in df.columns else F.lit(None)
    return df.groupBy("batch_id").agg(
        F.min(time).alias("min_timestamp"), F.max(time).alias("max_timestamp"),
        F.count("*").alias("record_count"),
        F.sum(anomaly.cast("long")).alias("anomaly_count"),
    )


def global_index(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count("*").alias("batches"),
        F.min("min_timestamp").alias("min_timestamp"), F.max("max_timestamp").alias("max_timestamp"),
        F.sum("record_count").alias("total_records"), F.sum("anomaly_count").alias("total_anomalies"),
    )


#: Casts that lose nothing, by the type that is stored.
WIDER = {
    "smallint": ("tinyint",), "int": ("tinyint", "smallint"), "bigint": ("tinyint", "smallint", "int"),
    "float": ("tinyint", "smallint"), "double": ("tinyint", "smallint", "int", "float"),
    "timestamp_ntz": ("date",),
}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def fitted(df: DataFrame, root: str) -> DataFrame:
    """``df`` in the types in which the dataset stores its columns; what would lose values is an error.

    Columns that the dataset lacks are new ones and are null in its other batches.
    """
    if not _exists(df.sparkSession, f"{root}/data"):
        return df
    stored = dict(read(df.sparkSession, root).dtypes)
    types = dict(df.dtypes)
    void = [c for c, t in types.items() if t == "void"]
    other = {c: t for c, t in types.items() if c in stored and c not in void and t != stored[c] and c != "batch_id"}
    if lossy := [f"{c} is {t}, stored as {stored[c]}" for c, t in other.items() if t not in WIDER.get(stored[c], ())]:
        raise ValueError(f"batch does not fit the dataset: {'; '.join(sorted(lossy))}")
    return df.withColumns({c: F.col(c).cast(stored[c]) for c in [*other, *[c for c in void if c in stored]]})


def file_zones(df: DataFrame, lookup: Sequence[str] = ()) -> DataFrame:
    """Least and greatest value of each column in each file of a stored dataset.

    Numbers and times always, texts among ``lookup`` by their first characters. Both ends are
    null where a file has no value of the column. What the index tells of a batch is there per file.
    """
    time = F.col("timestamp") if "timestamp" in df.columns else F.lit(None).cast("timestamp_ntz")
    anomaly = F.col("is_anomaly") if "is_anomaly" in df.columns else F.lit(None)
    types = {c: t for c, t in df.dtypes if t in ZONED or (t == "string" and c in lookup)}
    types.pop("batch_id", None)
    values = {c: F.col(f"`{c}`") if t in ZONED else F.substring(F.col(f"`{c}`"), 1, TEXT_PREFIX) for c, t in types.items()}
    return df.groupBy("batch_id", F.col("_metadata.file_path").alias("file")).agg(
        F.min(time).alias("min_timestamp"), F.max(time).alias("max_timestamp"),
        F.count("*").alias("record_count"), F.sum(anomaly.cast("long")).alias("anomaly_count"),
        *[F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias(f"zone_{c}") for c, v in values.items()])


#: How the index of a batch comes from those of its files.
INDEX_COLUMNS = {"min_timestamp": F.min, "max_timestamp": F.max, "record_count": F.sum, "anomaly_count": F.sum}


def append(
    df: DataFrame, root: str, chunk_rows: int = CHUNK_ROWS, batch_ids: Sequence[str] | None = None,
    lookup: Sequence[str] = (),
) -> None:
    """Write the batches of ``df``; a batch written again replaces itself.

    Rows of a batch are sorted by time in each task, so that a file holds a narrow range of it.
    Columns named in ``lookup`` get Bloom filters for equality; their row groups are left out on reading.

    Types are compared with the stored ones before anything is written, and the writing
    itself is given up as a whole on an error, so a bad batch leaves the dataset as it was.
    Rebalancing splits a dominant batch over tasks and joins up small ones. The index is
    made from the written batches, whose ids are taken down while they are written.
    Rows without a batch, or outside of those named in ``batch_ids``, are an error.
    """
    known = F.col("batch_id").isin(*batch_ids) if batch_ids is not None else F.lit(True)
    df = fitted(df, root).withColumn("batch_id", F.when(
        F.col("batch_id").isNotNull() & known, F.col("batch_id").cast("string")).otherwise(F.raise_error(
            F.concat(F.lit("batch not named: "), F.coalesce(F.col("batch_id").cast("string"), F.lit("null"))))))
    if unknown := [c for c in lookup if c not in df.columns]:
        raise ValueError(f"batch lacks columns {unknown}")
    seen = Observation()
    rows = df.observe(seen, F.collect_set("batch_id").alias("ids")).hint("rebalance", "batch_id")
    rows = rows.sortWithinPartitions("batch_id", *[c for c in ("timestamp",) if c in df.columns])
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", chunk_rows).option("compression", "zstd")
        .options(**{f"parquet.bloom.filter.enabled#{c}": "true" for c in lookup})
        .options(**{f"parquet.bloom.filter.expected.ndv#{c}": str(chunk_rows) for c in lookup})
        .partitionBy("batch_id").parquet(f"{root}/data")
    )
    # One id per folder that was written, which the driver has listed anyway.
    ids = sorted(seen.get["ids"] or [])
    if not ids:
        return
    # The written files have the columns of ``df``, so no footers are merged; they are read once, for the zones.
    written = df.sparkSession.read.schema(df.schema).parquet(f"{root}/data").where(F.col("batch_id").isin(*ids))
    zones = file_zones(written, lookup)
    (
        zones.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id").parquet(f"{root}/zones")
    )
    per_file = zones.select("batch_id", *INDEX_COLUMNS).schema
    (
        df.sparkSession.read.schema(per_file).parquet(f"{root}/zones").where(F.col("batch_id").isin(*ids))
        .groupBy("batch_id").agg(*[how(c).alias(c) for c, how in INDEX_COLUMNS.items()])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id").parquet(f"{root}/index")
    )


def add_batches(df: DataFrame, root: str, name: str, required: Sequence[str] = ("timestamp",),
                chunk_rows: int = CHUNK_ROWS, lookup: Sequence[str] = ()) -> DataFrame:
    """Check, clean, write and index batches of a dataset of the catalog below ``root``; its new totals.

    A dataset that the catalog lacks, a required column that the batch lacks, or a type that does not
    fit is an error before a byte is written.
    """
    spark = df.sparkSession
    entry = catalog(spark, root).where(F.col("name") == name).first()
    if entry is None:
        raise ValueError(f"no dataset {name} below {root}")
    if missing := [c for c in ("batch_id", *required) if c not in df.columns]:
        raise ValueError(f"batch lacks columns {missing}")
    folder = f"{root}/datasets/{name}"
    append(prepare(df, entry["schema"]), folder, chunk_rows, lookup=lookup)
    global_index(read_index(spark, folder)).write.mode("overwrite").parquet(f"{folder}/totals")
    return totals(spark, root, name)


def totals(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Batches, time range, rows and anomalies of a dataset as of its last batch."""
    return spark.read.parquet(f"{root}/datasets/{name}/totals")


def _read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Parquet by batch, with batch ids as the text they were written as ('007' is no 7)."""
    found = spark.read.options(mergeSchema=True, **options).parquet(path).schema
    fields = [T.StructField("batch_id", T.StringType()) if f.name == "batch_id" else f for f in found]
    return spark.read.options(**options).schema(T.StructType(fields)).parquet(path)


def read(spark: SparkSession, root: str, ignore_corrupt: bool = False) -> DataFrame:
    """All batches; corrupt files fail unless they are to be skipped."""
    return _read(spark, f"{root}/data", ignoreCorruptFiles=ignore_corrupt)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/index")


def _comparable(value: object, kind: str) -> bool:
    """Whether a column of this type and the value compare as their ranges do."""
    if kind in NUMBERS:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return kind == "string" and isinstance(value, str)


def without_files(
    rows: DataFrame, root: str, start: datetime | None = None, end: datetime | None = None,
    filters: Mapping[str, object] | None = None,
) -> DataFrame:
    """``rows`` of a stored dataset without the files that can hold no row in the range and of the filters.

    Zones only leave out: a file that they lack, or that was moved, is read. The ids of files that go
    come to the driver, which lists all files of the dataset in any case, and the scan drops them there.
    """
    spark = rows.sparkSession
    if not _exists(spark, f"{root}/zones"):
        return rows
    zones = _read(spark, f"{root}/zones")
    kinds = dict(rows.dtypes)
    zoned = {c.removeprefix("zone_") for c in zones.columns if c.startswith("zone_")}
    outside: list[Column] = []
    if "timestamp" in zoned and kinds.get("timestamp") == "timestamp_ntz":
        low, high = F.col("zone_timestamp.low"), F.col("zone_timestamp.high")
        if start is not None:
            outside.append(F.coalesce(high < F.lit(start).cast("timestamp_ntz"), F.lit(True)))
        if end is not None:
            outside.append(F.coalesce(low > F.lit(end).cast("timestamp_ntz"), F.lit(True)))
    for name, wanted in (filters or {}).items():
        values = wanted if isinstance(wanted, (list, tuple)) else [wanted]
        if name not in zoned or not values or not all(_comparable(v, kinds.get(name, "")) for v in values):
            continue
        zone = F.col(f"`zone_{name}`")
        cut = [F.lit(v[:TEXT_PREFIX] if isinstance(v, str) else v) for v in values]
        # A file whose ends are unknown may be of a batch whose texts were not looked at.
        known = F.lit(kinds[name] != "string") | zone["low"].isNotNull()
        outside.append(known & ~F.coalesce(reduce(Column.__or__, [
            (zone["low"] <= v) & (zone["high"] >= v) for v in cut]), F.lit(False)))
    if not outside:
        return rows
    gone = [r.file for r in zones.where(reduce(Column.__or__, outside)).select("file").collect()]
    return rows.where(not_named(gone)) if gone else rows


def not_named(paths: Sequence[str]) -> Column:
    """Whether a row is of none of these files. A list is one text: literals made one by one cost a call each."""
    odd = [p for p in paths if "'" in p or "\\" in p]
    plain = [p for p in paths if not ("'" in p or "\\" in p)] if odd else paths
    lists = [", ".join(f"'{p}'" for p in plain[i:i + LISTED]) for i in range(0, len(plain), LISTED)]
    kept = [F.expr(f"_metadata.file_path NOT IN ({texts})") for texts in lists]
    return reduce(Column.__and__, [*kept, *([~F.col("_metadata.file_path").isin(*odd)] if odd else [])])


def scan_batch(spark: SparkSession, root: str, batch_id: str, columns: Sequence[str]) -> DataFrame:
    return read(spark, root).where(F.col("batch_id") == batch_id).select(*columns)


def select_rows(
    df: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    filters: Mapping[str, object] | None = None,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    order: Sequence[str] = ("timestamp",),
    ignore_unknown: bool = False,
) -> DataFrame:
    """Time range, filters, then columns, then the first rows in order."""
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    for name, wanted in (filters or {}).items():
        if name not in df.columns:
            if ignore_unknown:
                continue
            raise ValueError(f"no column {name} to filter on")
        column = F.col(name)
        df = df.where(column.isin(*wanted) if isinstance(wanted, (list, tuple)) else column == wanted)
    if limit is not None and limit > 0:
        df = df.orderBy(*order).limit(limit)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def query(
    spark: SparkSession, root: str, start: datetime | None = None, end: datetime | None = None,
    **selection: object,
) -> DataFrame:
    """Query a stored dataset; batches and files that can hold no wanted row are not read."""
    rows = without_files(read(spark, root), root, start, end, selection.get("filters"))
    if start is not None or end is not None:
        # The index only leaves out: a batch that it lacks is read.
        outside = F.lit(False)
        if start is not None:
            outside |= F.col("max_timestamp") < F.lit(start).cast("timestamp_ntz")
        if end is not None:
            outside |= F.col("min_timestamp") > F.lit(end).cast("timestamp_ntz")
        # Partition values alone say which batches there are; the semi-join prunes their folders at run time.
        outside_ids = read_index(spark, root).where(outside).select("batch_id")
        inside = rows.select("batch_id").distinct().join(outside_ids, "batch_id", "left_anti")
        rows = rows.join(inside, "batch_id", "left_semi")
    return select_rows(rows, start, end, **selection)


def query_experiments(
    df: DataFrame, start: datetime | None = None, end: datetime | None = None,
    model_types: Sequence[str] = (), dataset_types: Sequence[str] = (),
    fault_types: Sequence[str] = (), anomaly_only: bool = False, limit: int | None = None,
    order: Sequence[str] = ("timestamp",),
) -> DataFrame:
    filters: dict[str, object] = {}
    if model_types:
        filters["model_type"] = list(model_types)
    if dataset_types:
        filters["dataset_type"] = list(dataset_types)
    if fault_types:
        filters["fault_type"] = list(fault_types)
    if anomaly_only:
        filters["is_anomaly"] = 1
    return select_rows(df, start, end, filters, limit=limit, order=order)


def union_batches(*batches: DataFrame) -> DataFrame:
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch, allowMissingColumns=True)
    return out


def export(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> str:
    """Write a full copy as parquet, csv or json, by split or other columns if asked."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}, use one of {FORMATS}")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt != "parquet":
        # Text formats would cut times to milliseconds.
        writer = writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if fmt == "csv":
        writer = writer.option("header", True)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)
    return path


def store_info(spark: SparkSession, root: str) -> DataFrame:
    """Rows and batches from the index, files and bytes from the listing."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").load(f"{root}/data")
        .agg(F.count("*").alias("file_count"), F.sum("length").alias("bytes"))
    )
    totals = global_index(read_index(spark, root))
    one = F.lit(1).alias("_one")
    return totals.select("*", one).join(files.select("*", one), "_one").drop("_one")


CATALOG = (
    "name string, created timestamp, schema map<string,string>, description string, tags array<string>"
)


def create_dataset(
    spark: SparkSession, root: str, name: str, schema: Mapping[str, str],
    description: str = "", tags: Sequence[str] = (),
) -> str:
    """Enter a dataset in the catalog below ``root`` and return its own folder.

    The catalog is a table like any other, so every later session sees it.
    """
    entry = spark.createDataFrame(
        [(name, datetime.now(), dict(schema), description, list(tags))], CATALOG
    )
    entry.write.mode("overwrite").json(f"{root}/catalog/{name}")
    return f"{root}/datasets/{name}"


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Catalog entries of all datasets below ``root``."""
    return spark.read.schema(CATALOG).option("recursiveFileLookup", True).json(f"{root}/catalog")


def drop_entry(spark: SparkSession, root: str, name: str) -> bool:
    """Drop a dataset's data and its catalog entry."""
    drop_dataset(spark, f"{root}/datasets/{name}")
    return _delete(spark, f"{root}/catalog/{name}")


def _delete(spark: SparkSession, path: str) -> bool:
    """Remove a folder on whatever file system holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.delete(target, True)


def drop_batches(spark: SparkSession, root: str, batch_ids: Sequence[str]) -> None:
    """Drop the partitions of some batches; no other data is touched. An unknown batch is an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for part in ("zones", "index", "data"):
        if part == "zones" and not _exists(spark, f"{root}/zones"):
            continue
        folder = hadoop.Path(f"{root}/{part}")
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # Folder names are escaped; they are compared as the ids they stand for.
        found = {unquote(s.getPath().getName().removeprefix("batch_id=")): s.getPath() for s in system.listStatus(folder)}
        if missing := [b for b in batch_ids if b not in found]:
            raise ValueError(f"no batches {missing} below {root}/{part}")
        for batch in batch_ids:
            system.delete(found[batch], True)


def drop_dataset(spark: SparkSession, root: str) -> bool:
    return _delete(spark, root)
