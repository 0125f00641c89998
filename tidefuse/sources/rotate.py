"""Text files of bounded size from rows in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefuse.operators.blocks import range_blocks, scan

FILE_NO = "file_no"


def rotate(df: DataFrame, path: str, max_bytes: int, order: Sequence[str], keep: int | None = None) -> int:
    """Write rows as JSON lines, in order, to numbered files of at most ``max_bytes``; the number of the last one.

    Where a file ends follows from the running number of encoded bytes, so rows may be of any
    width. ``keep`` leaves the last files alone, as rotated logs do. A longer line than the
    bound is an error. Files are ``path/file_no=<n>/part-*``, written by one task each.
    """
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    lines = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], line.alias("value")).withColumns({
        "_all": F.lit(0), "_bytes": (F.octet_length("value") + 1).cast("long")})
    names = [f"_o{i}" for i in range(len(order))]
    longest, total = lines.agg(F.max("_bytes"), F.sum("_bytes")).first()
    if longest is None:
        return -1
    if longest > max_bytes:
        raise ValueError(f"a line has {longest} bytes, more than a file of {max_bytes}")
    # A file's first line may begin before its multiple, by less than a line.
    room = max_bytes - longest + 1
    running = scan(range_blocks(lines, ["_all"], names), ["_all"], names, total={"_upto": F.col("_bytes")})
    numbered = running.withColumn(FILE_NO, F.floor((F.col("_upto") - 1) / room))
    last = (total - 1) // room
    if keep is not None:
        numbered = numbered.where(F.col(FILE_NO) > last - keep)
    numbered.repartition(FILE_NO).sortWithinPartitions(FILE_NO, *names).select(FILE_NO, "value") \
        .write.partitionBy(FILE_NO).text(path)
    return last
