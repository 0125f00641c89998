"""Shared small helpers: reading tables, tables that cut lineage, Arrow batches, folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefuse.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
#: Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizer files are installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, safe from lost executors.

    ``forget`` removes the table once nothing reads it any more.
    """
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    # The table stands for its plan from now on, so that plan's shuffle files can go.
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    table_ = df.sparkSession.read.schema(df.schema).parquet(path)
    table_.scratch = path
    return table_


def forget(*tables: DataFrame) -> None:
    """Removes tables made by ``kept`` that no plan to come will read; others are left alone."""
    for df in tables:
        if path := getattr(df, "scratch", None):
            context = df.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def joined(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the corpus: neither is sent through the driver.

    A written table of hashes can lie below the size up to which Spark sends a side to all executors, while its
    rows, unfolded and with the hash table over them, are many times that on the driver.
    """
    return left.hint("merge").join(right, on, how)


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """``df`` with the place of each row in its group (from 0, in ascending order) and the group's ``total``.

    Rows are sorted over all partitions, whatever the sizes of the groups; the groups' parts are
    counted per partition, and a row's place is its row number behind the parts before. Equal rows
    are told apart by their place in the input, so that they can lie in several partitions.
    """
    rows = kept(df.withColumn("_tie", F.monotonically_increasing_id()), "unplaced")
    keys = [*group, *order, "_tie"]
    # The partition's number is in the upper bits of the id, the row's number in the lower 33.
    at = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = kept(at.drop("_tie").withColumn("_part", F.shiftright("_at", 33)), "sorted")
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        *[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], F.col("_part").alias("_p"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("total"))
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return placed.join(bases, same).select(
        *df.columns, (F.col("_at") - F.col("_first") + F.col("_base")).alias(name), "total")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, and fewer where texts are long."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            if part.nbytes > 1 << 23 and part.num_rows > 1:
                for k in range(part.num_rows):
                    yield part.slice(k, 1)
            else:
                yield part


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the offsets of each; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    size = int(offsets[-1] - offsets[0])
    if data is None or size == 0:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8, size, int(offsets[0])), offsets - offsets[0]


