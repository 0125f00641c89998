"""Vector code compression with a lexicographic trie.

Components become integers, vectors are cut into consecutive parts, and each part
position has a codebook. The distinct parts of a position, in lexicographic order,
are a trie: the distances of a prefix to the same prefixes of all entries are one
vector, which all parts that begin with the prefix share. A walk through the trie
in depth-first order adds one dimension per step down; a leaf takes the least
distance as its code, and adds its part, times its copies, to that entry's sum.

The distinct parts with their copies are made once, sorted over all partitions and
written; each round of fitting reads them, a task walks the tries of its runs, and
sums per entry are all that leaves it. The walk goes on over blocks of parts: within a
block the new nodes of a depth are computed together, and the path to the last leaf is
kept as the stack with which the next block begins. The last assignment needs no
shuffle: each batch of vectors walks the tries of its own parts.

Everything is exact in integers. Components beyond ``LIMIT`` after scaling are an error.
Rows whose vector is null or holds null or non-finite components go. Codebooks begin with
the smallest ids; equal ids count each, in order of their vectors, a null id comes last. With
fewer rows there are fewer entries. Vectors of each dimension are compressed apart; a
dimension that is no multiple of the parts is cut as equally as can be. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefuse.llm.common import kept

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LIMIT = 1 << 26
#: Parts of a block of the walk.
WALKED = 8192
#: Copies of a label's error that the join has.
SALTS = 16

Books = dict[tuple[int, int], np.ndarray]


def scaled(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """vec_id, label, v (integers, as ints), dim, without rows whose vector is not whole."""
    x = F.transform(F.col(vector), lambda v: v.cast("double") * scale)
    good = F.col(vector).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("v"))
    far = F.exists("v", lambda v: F.abs(v) > LIMIT)
    error = F.raise_error(F.lit(f"components times {scale} must lie within {LIMIT}")).cast("array<int>")
    rows = rows.withColumn("v", F.when(far, error).otherwise(F.transform("v", lambda v: F.floor(v).cast("int"))))
    return rows.withColumn("dim", F.size("v"))


def cuts(dim: int, parts: int) -> list[int]:
    return [k * dim // parts for k in range(parts + 1)]


def first_rows(rows: DataFrame, entries: int) -> DataFrame:
    """dim, vec_id, v of the rows with the smallest ids of each dimension: each task leaves a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            ids = batch.column("vec_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for dim in np.unique(dims).tolist():
                use = dims == dim
                if len(held[dim]) == entries:
                    last_null, last = held[dim][-1][:2]
                    use &= (null < last_null) | ((null == last_null) & (ids <= last))
                at = np.flatnonzero(use)
                at = at[np.lexsort((ids[at], null[at]))]
                # Beyond the first ones only equal ids are of use.
                if len(at) > entries:
                    k = at[entries - 1]
                    at = at[(null[at] < null[k]) | ((null[at] == null[k]) & (ids[at] <= ids[k]))]
                lists = batch.column("v").take(pa.array(at)).to_pylist()
                new = zip(null[at].tolist(), ids[at].tolist(), map(tuple, lists))
                held[dim] = heapq.nsmallest(entries, [*held[dim], *new])
        found = [(dim, None if absent else i, v) for dim, best in held.items() for absent, i, v in best]
        dims, ids, lists = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(ids, pa.int64()),
                                          pa.array(lists, pa.list_(pa.int32()))], ["dim", "vec_id", "v"])

    few = rows.select("dim", "vec_id", "v").mapInArrow(run, "dim int, vec_id long, v array<int>")
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "v"))
    return few.withColumn("place", place).where(F.col("place") <= entries)


def first_books(rows: DataFrame, parts: int, entries: int) -> Books:
    by_dim = defaultdict(list)
    for row in first_rows(rows, entries).orderBy("dim", "place").collect():  # `entries` rows per dimension
        by_dim[row["dim"]].append(row["v"])
    books = {}
    for dim, found in by_dim.items():
        whole, at = np.array(found, np.int64).reshape(len(found), dim), cuts(dim, parts)
        books |= {(dim, k): whole[:, at[k]:at[k + 1]].copy() for k in range(parts)}
    return books


def distinct_parts(rows: DataFrame, parts: int) -> DataFrame:
    """dim, number, part, copies: the distinct parts of each position, sorted over all partitions."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice(
        F.col("v"), (F.floor(k * F.col("dim") / parts) + 1).cast("int"),
        (F.floor((k + 1) * F.col("dim") / parts) - F.floor(k * F.col("dim") / parts)).cast("int")))
    each = rows.select("dim", F.posexplode(cut).alias("number", "part"))
    counted = kept(each.groupBy("dim", "number", "part").agg(F.count(F.lit(1)).alias("copies")), "parts")
    keys = ["dim", "number", "part"]
    return kept(counted.repartitionByRange(*keys).sortWithinPartitions(*keys), "tries")


class Trie:
    """A depth-first walk over the parts of one position, in blocks."""

    def __init__(self, book: np.ndarray):
        self.book = book
        width = book.shape[1]
        self.path = None
        #: Distances of the prefixes of the last leaf, by depth.
        self.stack = np.zeros((width + 1, len(book)), np.int64)

    def walk(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and distances of ``parts`` (rows in lexicographic order, else less is shared)."""
        same = np.zeros(parts.shape, bool)
        same[1:] = parts[1:] == parts[:-1]
        if self.path is not None:
            same[0] = parts[0] == self.path
        shared = np.cumprod(same, axis=1).sum(axis=1)
        # Node 0 of each depth is that of the stack, the others are new in this block.
        nodes, node = self.stack[:1], np.zeros(len(parts), np.int64)
        for depth in range(parts.shape[1]):
            new = shared <= depth
            step = parts[new, depth][:, None] - self.book[:, depth]
            nodes = np.concatenate([self.stack[depth + 1:depth + 2], nodes[node[new]] + step * step])
            node = np.cumsum(new)
            self.stack[depth + 1] = nodes[-1]
        self.path = parts[-1]
        code = nodes.argmin(axis=1)
        return code[node], nodes[np.arange(len(nodes)), code][node]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The stretches of a batch with one dimension and position, cut into blocks."""
    dim, number = (batch.column(c).to_numpy() for c in ("dim", "number"))
    change = np.flatnonzero((dim[1:] != dim[:-1]) | (number[1:] != number[:-1])) + 1
    for a, b in zip([0, *change.tolist()], [*change.tolist(), len(dim)]):
        for start in range(a, b, WALKED):
            yield (int(dim[a]), int(number[a])), batch.slice(start, min(WALKED, b - start))


def moved(tries: DataFrame, books: Books) -> Books:
    """The codebooks after one round: means, rounded down, of the parts that chose an entry."""
    shared = tries.sparkSession.sparkContext.broadcast(books)  # one vector per entry and dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, sums, counts, walks = shared.value, {}, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, block in runs(batch):
                book = books[key]
                if key not in walks:
                    walks[key], sums[key], counts[key] = Trie(book), np.zeros_like(book), np.zeros(len(book), np.int64)
                parts, copies = matrix(block.column("part"), book.shape[1]), block.column("copies").to_numpy()
                code, _ = walks[key].walk(parts)
                np.add.at(sums[key], code, parts * copies[:, None])
                np.add.at(counts[key], code, copies)
        found = [(*key, e, int(counts[key][e]), sums[key][e]) for key in sums for e in np.flatnonzero(counts[key]).tolist()]
        columns = list(zip(*found)) if found else [()] * 5
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         ["dim", "number", "entry", "n", "sums"])

    partial = tries.mapInArrow(run, "dim int, number int, entry int, n long, sums array<long>")
    # The counts go along as the first element, so that parts of no dimension are counted too.
    values = partial.select("dim", "number", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("k", "x"))
    total = values.groupBy("dim", "number", "entry", "k").agg(F.sum("x").alias("x"))
    out = {key: book.copy() for key, book in books.items()}
    # One number per entry and dimension, whatever the input.
    rows = defaultdict(dict)
    for dim, number, entry, k, x in total.collect():
        rows[dim, number, entry][k] = x
    for (dim, number, entry), x in rows.items():
        book = out[dim, number]
        book[entry] = [x[k + 1] // x[0] for k in range(book.shape[1])]
    return out


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks by (dimension, position)."""
    books = first_books(rows, parts, entries)
    if books:
        tries = distinct_parts(rows, parts)
        for _ in range(rounds):
            books = moved(tries, books)
    return books


def encode(rows: DataFrame, books: Books, parts: int = PARTS) -> DataFrame:
    """vec_id, label, code (two hex digits per part), error."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    place = rows.columns.index("label")
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, WALKED):
                batch = whole.slice(start, WALKED)
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    some = batch.filter(pa.array(dims == dim))
                    v, at = matrix(some.column("v"), dim), cuts(dim, parts)
                    codes, error = np.zeros((len(v), parts), np.uint8), np.zeros(len(v), np.int64)
                    for k in range(parts):
                        if at[k] == at[k + 1]:
                            continue
                        distinct, back = np.unique(v[:, at[k]:at[k + 1]], axis=0, return_inverse=True)
                        code, distance = Trie(shared.value[dim, k]).walk(distinct)
                        codes[:, k] = code[back.ravel()]
                        error += distance[back.ravel()]
                    yield pa.RecordBatch.from_arrays(
                        [some.column("vec_id"), some.column(place), pa.array([x.tobytes().hex() for x in codes]),
                         pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, schema)


def digest(books: Books) -> str:
    numbers = ",".join(str(x) for key in sorted(books) for x in books[key].ravel().tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per whole vector: vec_id, code, error, label_error, codebooks_sha256."""
    if entries > 256:
        raise ValueError("a code has one byte")
    rows = kept(scaled(vectors, vector, scale), "scaled")
    books = fit(rows, parts, entries, rounds)
    coded = kept(encode(rows, books, parts), "codes")
    # A label that a third of all rows have is spread over several keys.
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    same = F.col("label").eqNullSafe(F.col("_label")) & (salt == F.col("_salt"))
    return coded.join(totals, same).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
