"""A stream of the lines of files that grow in place, and of new files beside them."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Tasks carry the reader with them, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

NAME = "growing_files"
#: Bytes of one task, and of one look back for the beginning of a line.
TASK_BYTES, LOOK_BACK = 64 << 20, 64 << 10


def file_system(path: str):
    """The file system of a path or URI, as pyarrow sees it, and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


class GrowingReader(DataSourceStreamReader):
    """The offset of a micro-batch is the size of each file; a line is in the batch in which its end arrives.

    No state is kept beside the offsets: a task looks back from its first byte for the beginning of
    the line that lies across it. What follows the last line feed waits for the next batch.
    """

    def __init__(self, path: str):
        self.path = path

    def sizes(self) -> dict[str, int]:
        from pyarrow import fs

        system, inside = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(inside, recursive=True))
        name = lambda p: p.rsplit("/", 1)[-1]
        return {f.path: f.size for f in found if f.is_file and not name(f.path).startswith((".", "_"))}

    def initialOffset(self) -> dict:
        return {"sizes": "{}"}

    def latestOffset(self) -> dict:
        return {"sizes": json.dumps(self.sizes(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, now = json.loads(start["sizes"]), json.loads(end["sizes"])
        out = []
        for file, size in now.items():
            begin = before.get(file, 0)
            if size < begin:
                raise ValueError(f"{file} shrank from {begin} to {size} bytes")
            out += [Range(file, a, min(a + TASK_BYTES, size)) for a in range(begin, size, TASK_BYTES)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        with system.open_input_file(part.file) as source:
            begin = part.begin
            # The first line begins behind the last line feed before this range.
            while begin > 0:
                size = min(LOOK_BACK, begin)
                at = source.read_at(size, begin - size).rfind(b"\n")
                begin = begin - size + at + 1
                if at >= 0:
                    break
            text = source.read_at(part.end - begin, begin)
        at = 0
        while (stop := text.find(b"\n", at)) >= 0:
            line = text[at:stop].removesuffix(b"\r").decode("utf-8", "replace")
            # A line that ended before the range was given by another one.
            if begin + stop >= part.begin and line.strip():
                yield part.file, begin + at, line
            at = stop + 1

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"])


def tail_growing(spark: SparkSession, folder: str) -> DataFrame:
    """file, offset (of the line's first byte), line: new lines of all files below ``folder``, each once.

    Files may grow between triggers, and new ones may appear; one that shrinks is an error.
    ``(file, offset)`` orders the lines of a run. Blank lines are dropped, undecodable bytes replaced.
    """
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format(NAME).load(folder)
