"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target of words. A source takes all its documents as many
whole times as its target holds its size, and for the rest of the target, its
budget, some of them once more. Which, is found on counts alone: documents are
counted by exact length; each length first takes its share of the budget, rounded
down; what is left is at most the sum of the source's distinct lengths, is brought
below ``WINDOW`` by the longest lengths that fit, and is then met as nearly as can be by
a bounded-knapsack dynamic program over the counts that remain. Of each length the
documents with the smallest seeded hashes are selected, so reruns agree.

Sources in order (by code point, null last) weigh 3, 1, 2, and so on again. Targets
share ``share`` times all sizes by weight; one that exceeds ``most`` times its source's size
stops there, and the excess is shared anew. Only sums reach the driver. One task
handles the distinct lengths of one source (n of them need n * n / 2 words at least),
never its documents; documents of one length of a source are ranked in blocks.

The size of a null or empty text is 0 and it takes no words. Repeated rows count
each for itself. Rows with a null id are hashed like one id. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefuse.llm.common import kept, positions, slices, text_bytes

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 13
#: Largest budget of the dynamic program, in words.
WINDOW = 1 << 18
#: Documents of one source and length that a key of the last join has at most.
BLOCK = 1 << 16


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text: runs of bytes that are no blanks."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = ~space[first]
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[offsets[1:]] - total[offsets[:-1]]


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, name (of the source, never null, in the order of sources), size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = word_counts(*text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts.astype(np.int64))],
                                             ["doc_id", "name", "size"])

    name = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("name"),
                            F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, name string, size long")


def targets(lengths: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST) -> DataFrame:
    """name, source_size, target, from the counts (name, size, n) of documents."""
    each = lengths.groupBy("name").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    ranked = positions(each.withColumn("_all", F.lit(0)), ["_all"], ["name"], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    each = kept(ranked.select("name", "source_size", weight.cast("long").alias("weight")), "sources")
    stop = (F.col("source_size") * most).cast("double")
    budget = each.agg(F.sum("source_size")).first()[0]
    budget, total = share * (budget or 0), -1
    rest, left = 0.0, 1
    # The share per weight only grows, so sources that stop stay stopped: each turn stops more of them, or is the last.
    while True:
        open_ = F.lit(True) if total < 0 else stop * left >= F.col("weight") * rest
        weighed, stopped = each.agg(F.sum(F.when(open_, F.col("weight"))), F.sum(F.when(~open_, stop))).first()
        if weighed is None or weighed == total:
            break
        total, rest, left = weighed, budget - (stopped or 0), weighed
    return each.select("name", "source_size", F.least(
        stop, F.col("weight") * F.lit(float(rest)) / F.lit(float(left))).alias("target"))


def fitted(length: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length (at most ``free``) to take so that their sum comes nearest to ``budget``.

    Lengths are distinct, positive and ascending.
    """
    size = int((length * free).sum())
    if not budget or not size:
        return np.zeros(len(length), np.int64)
    if budget >= size:
        return free.copy()
    # Integers of any size: counts times budgets can pass 63 bits.
    taken = np.array([int(n) * budget // size for n in free], np.int64)
    free = free - taken
    gap = budget - int((length * taken).sum())
    # The longest first, to the middle of the window. Lengths beyond that are left to the coarse program.
    for k in np.flatnonzero(length <= WINDOW // 2)[::-1].tolist():
        if gap <= WINDOW:
            break
        n = min(int(free[k]), (gap - WINDOW // 2) // int(length[k]))
        if n > 0:
            taken[k] += n
            free[k] -= n
            gap -= n * int(length[k])
    # Where only long documents are left the gap can exceed the window: first in coarser units, then in words.
    while gap > 0:
        some = np.flatnonzero((free > 0) & (length < 2 * gap))
        if not len(some):
            break
        limit = gap + min(gap, int(length[some[-1]]))
        unit = -(-limit // (2 * WINDOW))
        chosen = knapsack(-(-length[some] // unit), free[some], gap // unit, limit // unit)
        left = gap - int((length[some] * chosen).sum())
        if abs(left) >= gap:
            break
        taken[some] += chosen
        free[some] -= chosen
        gap = left
        if unit == 1:
            break
    return taken


def knapsack(length: np.ndarray, free: np.ndarray, budget: int, limit: int | None = None) -> np.ndarray:
    """Counts whose sum is the nearest to ``budget`` that is possible up to ``limit`` (the budget if not given).

    Counts are split into powers of two. ``made`` has the item by which each sum became possible
    first, so that the items of a sum are found by walking back; no item is used twice.
    """
    limit = budget if limit is None else limit
    made = np.full(limit + 1, -1, np.int32)
    made[0] = 0
    items = []
    for k in np.flatnonzero((free > 0) & (length <= limit))[::-1].tolist():
        n, many = min(int(free[k]), limit // int(length[k])), 1
        while n and made[budget] < 0:
            many = min(many, n)
            weight = many * int(length[k])
            items.append((k, many, weight))
            fresh = np.flatnonzero((made[:-weight] >= 0) & (made[weight:] < 0)) + weight
            made[fresh] = len(items)
            n, many = n - many, many * 2
    sums = np.flatnonzero(made >= 0)
    at = int(sums[np.abs(sums - budget).argmin()])
    out = np.zeros(len(length), np.int64)
    while at:
        k, many, weight = items[made[at] - 1]
        out[k] += many
        at -= weight
    return out


def plan(lengths: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """name, size, n, epochs (whole times), extra (documents of the length taken once more), source_size, target."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("size")
        length, n = (group[c].to_numpy().astype(np.int64) for c in ("size", "n"))
        whole, target = group["source_size"][0].as_py(), group["target"][0].as_py()
        epochs = min(most, int(target // whole)) if whole else 0
        budget = round(target - epochs * whole) if epochs < most else 0
        extra = np.zeros(len(length), np.int64)
        some = length > 0
        extra[some] = fitted(length[some], n[some], budget)
        return pa.table({"name": group["name"], "size": group["size"], "n": group["n"],
                         "epochs": pa.array(np.full(len(length), epochs, np.int64)), "extra": pa.array(extra),
                         "source_size": group["source_size"], "target": group["target"]})

    rows = lengths.join(goals, "name").select("name", "size", "n", "source_size", "target")
    return rows.groupBy("name").applyInArrow(
        run, "name string, size long, n long, epochs long, extra long, source_size long, target double")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
        seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies (how often the mix takes it)."""
    rows = kept(sizes(documents), "sizes")
    lengths = kept(rows.groupBy("name", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    planned = kept(plan(lengths, targets(lengths, weights, share, most), most), "plan")
    ranked = positions(rows.withColumn("_hash", F.xxhash64("doc_id", F.lit(seed))), ["name", "size"],
                       ["_hash", "doc_id"], "rank")
    # A length that a third of all rows share has many blocks, and each of them its own copy of the plan's row.
    last = F.expr(f"(n - 1) DIV {BLOCK}")
    blocks = planned.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    ranked = ranked.withColumn("_block", F.expr(f"rank DIV {BLOCK}"))
    copies = F.col("epochs") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0)
    return ranked.join(blocks, ["name", "size", "_block"]).select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))
