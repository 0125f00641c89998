"""Best-fit packing of tokenized documents into sequences of a fixed size.

Exact-complement hashing: the histogram of piece lengths is all that a plan
needs. Sums of one, two and three available lengths are indexed; combinations
that fill a sequence exactly are consumed as often as the counts allow, then
the remaining lengths are placed best-fit, longest first. The plan says which
ranks of each length go where; it has a few thousand rows at any input size,
as every step uses up a length or a group of open sequences.

Null text is an empty document (its end token only). Repeated rows are
documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefuse.llm.common import kept, slices
from tidefuse.llm.vocabulary import PATTERN, Vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Groups in which the rows of one length are ranked apart from each other, per shuffle partition.
RANK_GROUPS = 4
LONG_SPACE = re.compile(r"\s{4096}")


class Encoder:
    """Ids of whole texts as little-endian bytes.

    The merges run in ``tiktoken`` over the ranks of the given file, which gives
    the ids of the ``tokenizers`` library faster. Its pattern matcher cannot take
    very long white space; those texts go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary = Vocabulary(path)
        self.special = set(vocabulary.special)
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=vocabulary.ids,
                                      special_tokens=vocabulary.special)
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()

    def __call__(self, text: str) -> bytes:
        if LONG_SPACE.search(text):
            ids = self.plain.encode(text, add_special_tokens=False).ids
        elif any(s in text for s in self.special):
            ids = self.fast.encode(text, allowed_special=self.special, disallowed_special=())
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes()


def tokenize_pieces(documents: DataFrame, path: str, size: int = 1024, end_id: int = 2,
                    keep_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``size`` tokens; a longer document begins with its short piece.

    ``keep_ids`` adds the token ids of each piece (``ids``).
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in slices(batches):
            out = [[] for _ in range(5 + keep_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row = [doc_id, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])]
                    if keep_ids:
                        row.append(np.frombuffer(ids, "<u4", b - a, 4 * a))
                    for values, v in zip(out, row, strict=True):
                        values.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][:len(out)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(out)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(pieces, PIECES + (", ids array<int>" if keep_ids else ""))


class Planner:
    """Places counted lengths; ``runs`` are (length, first rank, end rank, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.left = size, np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(size + 1, np.int64)
        self.sequences, self.runs = 0, []

    def take(self, length: int, n: int, sequence: int, offset: int) -> None:
        first = int(self.used[length])
        self.runs.append((length, first, first + n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def fill(self, combination: list[int]) -> None:
        n = min(int(self.left[x]) // k for x, k in Counter(combination).items())
        offset = 0
        for x in combination:
            self.take(x, n, self.sequences, offset)
            offset += x
        self.sequences += n

    def index(self) -> None:
        """Which sums one, two or three available lengths can have."""
        have = (self.left > 0).astype(np.float64)
        pairs = np.convolve(have, have)[:self.size + 1] > 0.5
        self.sums = [have > 0.5, pairs, np.convolve(pairs.astype(np.float64), have)[:self.size + 1] > 0.5]

    def parts(self, total: int, n: int, taken: Counter) -> list[int] | None:
        """``n`` available lengths of this sum, the longest first, beside those ``taken``."""
        if n == 1:
            return [total] if self.left[total] > taken[total] else None
        if not self.sums[n - 1][total]:
            return None
        rest = np.arange(1, total)
        for x in rest[self.sums[0][rest] & self.sums[n - 2][total - rest]][::-1].tolist():
            if self.left[x] > taken[x] and (others := self.parts(total - x, n - 1, taken + Counter([x]))):
                return [x, *others]
        return None

    def exact(self) -> None:
        self.index()
        for length in range(self.size, 0, -1):
            while self.left[length] > 0:
                gap = self.size - length
                found = [] if gap == 0 else None
                for n in (1, 2, 3):
                    if found is None:
                        found = self.parts(gap, n, Counter([length]))
                if found is None:
                    break
                combination = [length, *found]
                self.fill(combination)
                if any(self.left[x] == 0 for x in combination):
                    self.index()

    def best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
        for length in range(self.size, 0, -1):
            while (n := int(self.left[length])) > 0:
                gap = min((g for g in open_ if g >= length), default=None)
                if gap is None:
                    each = min(self.size // length, n)
                    many = n // each
                    for k in range(each):
                        self.take(length, many, self.sequences, k * length)
                    if rest := self.size - each * length:
                        open_.setdefault(rest, []).append((self.sequences, many))
                    self.sequences += many
                    continue
                first, many = open_[gap].pop()
                placed = min(n, many)
                self.take(length, placed, first, self.size - gap)
                for g, at, m in ((gap - length, first, placed), (gap, first + placed, many - placed)):
                    if g and m:
                        open_.setdefault(g, []).append((at, m))
                if not open_[gap]:
                    del open_[gap]


def plan(counts: dict[int, int], size: int = 1024) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs of ranks with their sequences and offsets, and the number of sequences."""
    planner = Planner(counts, size)
    planner.exact()
    planner.best_fit()
    return planner.runs, planner.sequences


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more, lengths from 1 to ``size``) with sequence_id and offset.

    Ranks within a length are counted in groups by hash, so that a length which
    most rows share is not ranked in one task.
    """
    spark = pieces.sparkSession
    groups = RANK_GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = kept(pieces, "pieces")
    names = pieces.columns
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)).cast("int"))
    counts = kept(grouped.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    # At most `size` rows, whatever the input.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    if any(not 1 <= x <= size for x in histogram):
        raise ValueError(f"lengths must lie between 1 and {size}")
    runs, _ = plan(histogram, size)
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "start")
    ranked = grouped.withColumn("_row", F.row_number().over(within) - 1).join(bases, ["length", "_group"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_row"))
    placed = spark.createDataFrame(
        runs, "length long, _from long, _to long, _sequence long, _offset long").withColumnRenamed("length", "_length")
    # The plan has at most a few runs per length, so its size has a bound: broadcast.
    where = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(placed), where).select(
        *names, (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"),
        F.col("_offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence from packed pieces with ids: sequence_id, ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return parts.select("sequence_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"))
