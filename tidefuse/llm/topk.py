"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets by length, longest first, and buckets into
blocks of bounded size. A block of long vectors gives every query a first
threshold: the k-th best product there. A bucket whose longest vector cannot
reach a query's threshold is left out for it. In the others the threshold over
both lengths is a cosine threshold, which is higher in buckets of shorter
vectors; where it is high and leaves few, candidates are those whose largest
coordinate of the query lies in the range the cosine allows, elsewhere those long
enough. Their products are computed in full, as products of matrices, and what is
found raises the thresholds for the rest.

Queries are a set stated by the caller, against all rows, in blocks. Null
vectors and those with null or non-finite components take no part; only vectors
of equal dimension meet. Every row is a candidate, also where several rows share
an id; rows that carry a query's own id are never its results. Exact repeated rows
count once, or each with ``repeats``; they are searched once and unfolded among the
results. Products must fit a long, else it is an error. Ties go to the smaller id.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefuse.llm.common import joined, kept

#: Rows and values of a block of vectors, and of one of queries.
BLOCK, BLOCK_VALUES = 1 << 15, 1 << 21
QUERY_BLOCK, QUERY_VALUES = 1 << 13, 1 << 19
#: Rows of a block and queries whose products are held at once.
ROWS, QUERIES = 4096, 1024
BUCKETS = 8
#: From this local cosine threshold on, a bucket is pruned by a coordinate.
COORDINATE_FROM = 0.5
#: Candidates are taken one by one where this many times their number is no more than the block.
FEW = 16
SLACK = 1 - 1e-9
EXACT = 2.0 ** 52
EXACT_SINGLE = 2.0 ** 24 * SLACK


def whole(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of every component, of the vectors that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & ~bad)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"),
                         F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("v"))


def room(values: int, most: int, dim: int) -> int:
    """Rows of a block: so many values, and ``most`` rows, at most."""
    return max(256, min(most, values // max(dim, 1)))


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block: its keys, ids, numbers of equal rows and vectors as bytes, longest first."""

    def run(block: pa.Table) -> pa.Table:
        order = np.argsort(-block["norm"].to_numpy(), kind="stable")
        v = block["v"].combine_chunks().flatten().to_numpy().reshape(block.num_rows, -1)[order]
        return pa.table({k: block[k][:1] for k in keys} | {
            "ids": pa.array([block["vec_id"].to_numpy()[order].tobytes()], pa.binary()),
            "copies": pa.array([block["copies"].to_numpy()[order].tobytes()], pa.binary()),
            "data": pa.array([stored(v)], pa.binary())})

    kinds = ", ".join(f"{k} int" for k in keys)
    return rows.groupBy(*keys).applyInArrow(run, f"{kinds}, ids binary, copies binary, data binary")


def stored(v: np.ndarray) -> bytes:
    """Whole numbers as bytes with their shape and type, the narrowest one that holds them."""
    most = np.abs(v).max(initial=0)
    out = io.BytesIO()
    np.save(out, v.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64))
    return out.getvalue()


def unpacked(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.load(io.BytesIO(data)).astype(np.float64)


def lengths(v: np.ndarray) -> np.ndarray:
    return np.linalg.norm(v, axis=1)


def exact(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which all products and their partial sums are exact: floats while these hold every whole number that can occur, else ints."""
    # No partial sum is larger than the product of the lengths.
    a, b = lengths(q).max(initial=0), lengths(v).max(initial=0)
    if max(a, b, a * b) < EXACT_SINGLE:
        return q.astype(np.float32), v.astype(np.float32)
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] < EXACT:
        return q, v
    as_int = lambda x: np.array([[int(y) for y in row] for row in x.tolist()], object).reshape(x.shape)
    return as_int(q), as_int(v)


def below(score: np.ndarray) -> np.ndarray:
    """Thresholds from whole numbers, none larger than its number."""
    found = score.astype(np.float64)
    return np.where(np.abs(found) < EXACT, found, np.nextafter(found, -np.inf))


def first_thresholds(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """The k-th best product of each query, or -inf where there are fewer rows."""
    least = np.full(len(q), -np.inf)
    if len(v) >= k:
        one, other = exact(q, v)
        for start in range(0, len(q), QUERIES):
            part = slice(start, start + QUERIES)
            score = below(one[part] @ other.T)
            score[q_ids[part, None] == ids] = -np.inf
            least[part] = np.partition(score, -k, axis=1)[:, -k]
    return least


def in_range(unit: np.ndarray, reach: np.ndarray, q: np.ndarray, q_norm: np.ndarray, local: np.ndarray) -> dict[int, np.ndarray]:
    """Candidates of the queries to which a coordinate leaves few: those in the range of the query's largest coordinate.

    ``local`` has each query's cosine threshold, ``unit`` the block's directions, of which a query takes the first ``reach``.
    """
    tried = np.flatnonzero(local >= COORDINATE_FROM)
    found: dict[int, np.ndarray] = {}
    if not len(tried):
        return found
    f = np.abs(q[tried]).argmax(axis=1)
    x, cut = q[tried, f] / q_norm[tried], np.minimum(local[tried], 1)
    spread = np.sqrt(np.maximum(0.0, (1 - x * x) * (1 - cut * cut))) + 1e-9
    low = np.where(x < -cut, -np.inf, cut * x - spread)
    high = np.where(x > cut, np.inf, cut * x + spread)
    least, most = unit.min(axis=0)[f], unit.max(axis=0)[f]
    # Others would keep most of the block.
    narrow = np.flatnonzero(np.minimum(high, most) - np.maximum(low, least) < (most - least) / 2)
    for c in np.unique(f[narrow]):
        order = np.argsort(unit[:, c])
        values = unit[order, c]
        own = narrow[f[narrow] == c]
        begins, ends = np.searchsorted(values, low[own]), np.searchsorted(values, high[own], "right")
        few = FEW * (ends - begins) <= reach[tried[own]]
        for i, begin, end in zip(tried[own[few]].tolist(), begins[few], ends[few], strict=True):
            rows = order[begin:end]
            found[i] = rows[rows < reach[i]]
    return found


class Block:
    """Vectors, longest first, with their lengths; those of one type that suits the queries are kept."""

    def __init__(self, ids: bytes, copies: bytes, data: bytes):
        self.ids, self.v = unpacked(ids, data)
        self.copies, self.norm = np.frombuffer(copies, np.int64), lengths(self.v)


def best(q_ids, q, q_copies, block: Block, least: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of a block for each query, of those that reach its threshold, and how often each counts.

    Raises the thresholds by what is found.
    """
    q_norm = np.maximum(lengths(q), 1e-300)
    one, other = exact(q, block.v)
    step = QUERIES if one.dtype != object else 16
    at, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, one.dtype if one.dtype == object else np.int64)
    for start in range(0, len(block.v), ROWS):
        norm, v = block.norm[start:start + ROWS], other[start:start + ROWS]
        need = least * SLACK / q_norm  # length that a candidate has at least
        reach = np.searchsorted(-norm, -need, side="right")
        live = np.flatnonzero(reach)
        few = {}
        local = need[live] / max(norm[0], 1e-300)
        if (local >= COORDINATE_FROM).any():
            unit = block.v[start:start + ROWS] / np.maximum(norm, 1e-300)[:, None]
            few = in_range(unit, reach[live], q[live], q_norm[live], local)
        found = [(at, row, score)]

        def keep(i: np.ndarray, j: np.ndarray, products: np.ndarray) -> None:
            use = block.ids[start + j] != q_ids[i]
            found.append((i[use], start + j[use], products[use].astype(score.dtype)))

        for i, j in few.items():
            products = v[j] @ one[live[i]]
            good = np.flatnonzero((products >= least[live[i]]).astype(bool))
            keep(np.full(len(good), live[i]), j[good], products[good])
        live = np.delete(live, list(few))
        live = live[np.argsort(reach[live], kind="stable")]
        for k_ in range(0, len(live), step):
            part = live[k_:k_ + step]
            products = one[part] @ v[:reach[part[-1]]].T
            # Thresholds of singles are exact in singles, as products are.
            bound = least[part].astype(products.dtype if products.dtype != object else np.float64)
            hit = np.flatnonzero((products >= bound[:, None]).astype(bool, copy=False))
            keep(part[hit // products.shape[1]], hit % products.shape[1], products.ravel()[hit])
        if len(found) == 1:
            continue
        at, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((block.ids[row], -score, at))
        at, row, score = at[order], row[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last = place == k - 1
        least[at[last]] = np.maximum(least[at[last]], below(score[last]))
        at, row, score = at[place < k], row[place < k], score[place < k]
    return q_ids[at], block.ids[row], score, np.minimum(k, q_copies[at] * block.copies[row])


def search(vectors: DataFrame, is_query: Column, k: int = 5, repeats: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score from whole-number vectors (vec_id, v).

    With ``repeats`` exact repeated rows, of queries too, count each.
    """
    # More than k equal rows cannot be results of one query.
    copies = F.least(F.count(F.lit(1)), F.lit(k)) if repeats else F.lit(1)
    shape = vectors.groupBy("vec_id", "v").agg(copies.cast("long").alias("copies")).withColumn("dim", F.size("v"))
    shape = kept(shape.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    cuts = [i / BUCKETS for i in range(BUCKETS - 1, 0, -1)]
    borders = shape.agg(F.percentile_approx("norm", cuts, 1000)).first()[0] or []
    bucket = F.lit(0)
    for b in borders:
        bucket = bucket + (F.col("norm") < b).cast("int")
    shape = shape.withColumn("bucket", bucket)
    # A few rows: one per bucket and dimension.
    sizes = shape.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def blocks_of(r) -> int:
        return -(-r["n"] // room(BLOCK_VALUES, BLOCK, r["dim"]))

    blocks = F.lit(1)
    for r in sizes:
        blocks = F.when((F.col("dim") == r["dim"]) & (F.col("bucket") == r["bucket"]), blocks_of(r)).otherwise(blocks)
    numbered = shape.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), blocks).cast("int"))
    base = kept(packed(numbered, ["dim", "bucket", "block"]), "blocks")
    asked = shape.where(is_query)
    groups = F.lit(1)
    for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():
        groups = F.when(F.col("dim") == r["dim"], -(-r["n"] // room(QUERY_VALUES, QUERY_BLOCK, r["dim"]))).otherwise(groups)
    queries = packed(asked.withColumn("group", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), groups).cast("int")),
                     ["dim", "group"]).withColumnsRenamed({"ids": "q_ids", "copies": "q_copies", "data": "q_data"})
    queries = kept(queries, "queries")

    def threshold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                q_ids, q = unpacked(r["q_ids"], r["q_data"])
                least = np.full(len(q), -np.inf)
                if r["ids"] is not None:
                    ids, v = unpacked(r["ids"], r["data"])
                    least = first_thresholds(q_ids, q, ids[:ROWS], v[:ROWS], k)
                norm = np.maximum(lengths(q), 1e-300)
                r["least"], r["shortest"] = least.tobytes(), float((least * SLACK / norm).min())
            yield pa.RecordBatch.from_pylist(
                [{x: r[x] for x in ("dim", "group", "q_ids", "q_copies", "q_data", "least", "shortest")} for r in rows],
                pa.schema([("dim", pa.int32()), ("group", pa.int32()), ("q_ids", pa.binary()),
                           ("q_copies", pa.binary()), ("q_data", pa.binary()), ("least", pa.binary()),
                           ("shortest", pa.float64())]))

    # The fullest bucket of long vectors of each dimension gives the first thresholds.
    lead = {}
    for r in sorted(sizes, key=lambda r: r["bucket"]):
        lead.setdefault(r["dim"], r["bucket"])
    first = F.lit(False)
    for dim, at in lead.items():
        first = first | ((F.col("dim") == dim) & (F.col("bucket") == at) & (F.col("block") == 0))
    seeded = queries.join(base.where(first).select("dim", "ids", "data"), "dim", "left")
    bounded = kept(seeded.mapInArrow(threshold, "dim int, group int, q_ids binary, q_copies binary, q_data binary, "
                                                "least binary, shortest double"), "thresholds")
    # Buckets in which some query of the group can still find something, then all their blocks.
    tried = bounded.withColumn("at", F.explode(F.array(*[
        F.struct(F.lit(r["dim"]).alias("of"), F.lit(r["bucket"]).alias("bucket"),
                 F.lit(blocks_of(r)).alias("blocks"), F.lit(float(r["longest"])).alias("longest"))
        for r in sizes]))).where("at.of = dim AND at.longest >= shortest")
    tried = tried.select("dim", "group", "q_ids", "q_copies", "q_data", "least", F.col("at.bucket").alias("bucket"),
                         F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1)).alias("block"))

    block = ["dim", "bucket", "block"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of one block follow each other, and what a block gave a group's queries is known to the next one.
        at, vectors_, known = None, None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {x: batch.column(x)[r].as_py() for x in (*block, "group", "q_ids", "q_copies", "q_data")}
                if (now := [row[x] for x in block]) != at:
                    at, vectors_ = now, Block(*(batch.column(x)[r].as_py() for x in ("ids", "copies", "data")))
                if (own := (row["dim"], row["group"])) not in known:
                    known[own] = np.frombuffer(batch.column("least")[r].as_py(), np.float64).copy()
                q_ids, q = unpacked(row["q_ids"], row["q_data"])
                found = best(q_ids, q, np.frombuffer(row["q_copies"], np.int64), vectors_, known[own], k)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist() if x.dtype == object else x, pa.int64()) for x in found],
                                                 ["query_id", "vec_id", "score", "n"])

    met = joined(tried, base, block).select(*block, "group", "q_ids", "q_copies", "q_data", "ids", "copies", "data", "least")
    found = met.mapInArrow(meet, "query_id long, vec_id long, score long, n long")
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
