"""Merkle manifest of a dataset by checkpoint-and-recompute.

Each row is a leaf, a digest of its columns. The leaves of a source, in order of
their ids, are the lowest level of the source's tree; every ``FAN`` consecutive
nodes become one node of the next level, until one is left, the subroot. The
subroots in order of their sources make the tree of the root in the same way.

Only every ``STRIDE``-th level is written. A stored node and the ``FAN ** STRIDE``
stored nodes under it are an aligned subtree, which one task can hold. Proofs are
taken from the root down: for each aligned subtree the missing interior nodes are
computed again from its stored nodes, each stored node gets the siblings on its
way up, in front of those of the subtree's top, and the interior nodes are
dropped. So the work of a level is one join with the level above, whose rows are
fewer by ``FAN ** STRIDE``.

``H`` is the lower-case hex SHA-256 of its inputs put together, digests as hex
text. A leaf is H of doc_id, source, lang, n_chars and text: ``-`` for null, else the
number of bytes, ``:`` and the value. Rows of one id in a source stand in order of
their digests, a null id first; the null source comes first. A tree of one node is
that node. An empty table has no root and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefuse.llm.common import kept, positions

FAN = 16
STRIDE = 3
SPAN = FAN ** STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHAIN = "tree string, block long, lefts array<string>, rights array<string>, subroot string, root string"


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column | None = None) -> Column:
    """The leaf digest of a row of documents, with another text if one is given."""
    values = [F.col(c) if c != "text" or text is None else text for c in FIELDS]
    return F.sha2(F.concat(*map(field, values)), 256)


def claims(documents: DataFrame, changed: Column, text: Column) -> DataFrame:
    """doc_id, tree, digest, claimed: the leaf, and where ``changed`` holds the leaf of the row with that text."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        # In the order of trees null comes first, then the sources byte by byte.
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"),
        leaf().alias("digest"), F.when(changed, leaf(text)).alias("claimed"))


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def subtree(digests: list[str], n: int) -> list[list[str]]:
    """The levels of an aligned subtree from its stored nodes up to its top; the tree has ``n`` nodes at the lowest."""
    levels = [digests]
    while len(levels) <= STRIDE and n > 1:
        below = levels[-1]
        levels.append([h("".join(below[k:k + FAN])) for k in range(0, len(below), FAN)])
        n = -(-n // FAN)
    return levels


def siblings(levels: list[list[str]], k: int) -> tuple[list[str], list[str]]:
    """What stands left and right of the node over ``k`` in its run, for each level below the top."""
    lefts, rights = [], []
    for level in levels[:-1]:
        first = k - k % FAN
        lefts.append("".join(level[first:k]))
        rights.append("".join(level[k + 1:first + FAN]))
        k //= FAN
    return lefts, rights


def in_order(group: pa.Table) -> pa.Table:
    return group.sort_by("pos")


def grown(group: pa.Table) -> pa.Table:
    """The stored node above an aligned subtree."""
    group = in_order(group)
    n = group["n"][0].as_py()
    top = subtree(group["digest"].to_pylist(), n)[-1]
    return pa.table({"tree": group["tree"][:1], "pos": pa.array([group["pos"][0].as_py() // SPAN], pa.int64()),
                     "n": pa.array([-(-n // SPAN)], pa.int64()), "digest": pa.array(top)})


def blocks(level: DataFrame) -> DataFrame:
    return level.withColumn("block", F.expr(f"pos DIV {SPAN}"))


def grow(nodes: DataFrame) -> list[DataFrame]:
    """The stored levels over the lowest one (tree, pos, n, digest and more); ``n``: nodes of the tree at that level."""
    levels = [nodes]
    # Each turn divides the nodes by SPAN.
    while not (open_ := levels[-1].where("n > 1")).isEmpty():
        grouped = blocks(open_.select("tree", "pos", "n", "digest")).groupBy("tree", "block")
        levels.append(kept(grouped.applyInArrow(grown, "tree string, pos long, n long, digest string"), "level"))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """tree, digest of each tree's last node."""
    found = [x.where("n = 1").select("tree", "digest") for x in levels]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def descended(group: pa.Table, parent: pa.Table) -> pa.Table:
    """The chains of an aligned subtree's stored nodes, from that of its top."""
    group, parent = in_order(group), parent.to_pylist()[0]
    levels = subtree(group["digest"].to_pylist(), group["n"][0].as_py())
    chains = [siblings(levels, k) for k in range(group.num_rows)]
    n = group.num_rows
    return pa.table({
        "tree": group["tree"], "block": group["pos"],
        "lefts": pa.array([a + parent["lefts"] for a, _ in chains], pa.list_(pa.string())),
        "rights": pa.array([b + parent["rights"] for _, b in chains], pa.list_(pa.string())),
        "subroot": pa.array([parent["subroot"]] * n), "root": pa.array([parent["root"]] * n)})


def joined(level: DataFrame, above: DataFrame):
    # Columns of their own: ``above`` may come from ``level``.
    above = above.select(*[F.col(c).alias(c) for c in above.columns])
    return blocks(level).groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))


def chains(levels: list[DataFrame], crowns: DataFrame) -> DataFrame:
    """The chains (see CHAIN) of the tops of the lowest level's aligned subtrees; ``crowns`` has those of the trees."""
    above = None
    for level in reversed(levels):
        own = crowns.join(level.where("n = 1").select("tree"), "tree").select(
            "tree", F.lit(0).cast("long").alias("block"), "lefts", "rights", "subroot", "root")
        above = own if above is None else above.unionByName(own)
        if level is not levels[0]:
            stored = level.select("tree", "pos", "n", "digest")
            above = kept(joined(stored, above).applyInArrow(descended, CHAIN), "chains")
    return above


@dataclass
class Manifest:
    """The stored levels of the sources' trees and of the tree of subroots."""

    levels: list[DataFrame]
    top_levels: list[DataFrame]

    def root(self) -> DataFrame:
        return tops(self.top_levels).select(F.col("digest").alias("root"))

    def subroots(self) -> DataFrame:
        """source, subroot, pos among the subroots."""
        return self.top_levels[0].select(
            F.when(F.col("name") != "", F.expr("substr(name, 2)")).alias("source"),
            F.col("digest").alias("subroot"), "pos")


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves`` (tree, doc_id, digest and more)."""
    placed = kept(positions(leaves, ["tree"], ["doc_id", "digest"]).withColumnRenamed("total", "n"), "leaves")
    levels = grow(placed)
    crowns = tops(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    crowns = kept(positions(crowns, ["tree"], ["name"]).withColumnRenamed("total", "n"), "subroots")
    return Manifest(levels, grow(crowns))


def proofs(manifest: Manifest, with_siblings: bool = False) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is H of the siblings from the leaf's level to the root, left to right in each.
    ``folded_root`` comes from the claimed digest (the leaf's own where null) and the siblings.
    ``with_siblings`` adds them as two arrays, ``lefts`` and ``rights``, with a text per level.
    """
    none = F.array().cast("array<string>")
    root = tops(manifest.top_levels).select(
        "tree", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    subroots = manifest.top_levels[0].select("tree", "pos", "n", "digest", "name")
    over = chains(manifest.top_levels, root)
    ways = kept(joined(subroots, over).applyInArrow(descended, CHAIN), "chains")
    crowns = ways.join(subroots.select(F.col("pos").alias("block"), "name", "digest"), "block").select(
        F.col("name").alias("tree"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
    over = chains(manifest.levels, kept(crowns, "crowns"))

    def run(group: pa.Table, parent: pa.Table) -> pa.Table:
        group, parent = in_order(group), parent.to_pylist()[0]
        digests = group["digest"].to_pylist()
        levels = subtree(digests, group["n"][0].as_py())
        upper = list(zip(parent["lefts"], parent["rights"]))
        upper_text = "".join(a + b for a, b in upper).encode()
        proof, folded, both = [], [], ([], [])
        for k, claimed in enumerate(group["claimed"].to_pylist()):
            lefts, rights = siblings(levels, k)
            own = list(zip(lefts, rights))
            proof.append(hashlib.sha256("".join(a + b for a, b in own).encode() + upper_text).hexdigest())
            digest = claimed or digests[k]
            for a, b in own + upper:
                digest = h(a + digest + b)
            folded.append(digest)
            if with_siblings:
                both[0].append(lefts + parent["lefts"])
                both[1].append(rights + parent["rights"])
        n = group.num_rows
        out = {"doc_id": group["doc_id"], "leaf": group["digest"], "subroot": pa.array([parent["subroot"]] * n),
               "root": pa.array([parent["root"]] * n), "proof_sha256": pa.array(proof),
               "folded_root": pa.array(folded), "verified": pa.array([x == parent["root"] for x in folded])}
        if with_siblings:
            out |= {name: pa.array(x, pa.list_(pa.string())) for name, x in zip(("lefts", "rights"), both)}
        return pa.table(out)

    schema = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean") + (", lefts array<string>, rights array<string>" if with_siblings else "")
    leaves = manifest.levels[0].select("tree", "pos", "n", "digest", "doc_id", "claimed")
    return joined(leaves, over).applyInArrow(run, schema)


def lower_cased(text: Column) -> Column:
    """The text with A to Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)
