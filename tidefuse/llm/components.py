"""Connected components by contraction.

Every round each node joins its neighbour of smallest rank (or stays, if its own
is smaller), and the edges are rewritten to the joined nodes. Ranks are hashes,
so chains of ids in order take no more rounds than any other graph, and the
edges shrink by a constant share per round. Rounds are written tables; nothing
but their counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefuse.llm.common import joined, kept


def rank(node: str):
    return F.struct(F.xxhash64(node, F.lit(7)).alias("h"), F.col(node).alias("v"))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: one row per node of ``edges``; two nodes have one root if a path joins them.

    Edges with a null end or with equal ends are left out. No edges give no rows.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = kept(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    moves = []
    while not edges.isEmpty():
        best = edges.groupBy("a").agg(F.min(rank("b")).alias("m"))
        move = kept(best.select(F.col("a").alias("node"), F.least("m", rank("a"))["v"].alias("root")), "roots")
        moves.append(move)
        ends = joined(edges, move.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        ends = joined(ends, move.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = kept(ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # The last roots first: a node's root of one round has a root of the next.
    result = moves.pop()
    while moves:
        later = result.select(F.col("node").alias("root"), F.col("root").alias("last"))
        result = joined(moves.pop(), later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return result
