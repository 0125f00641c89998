"""From raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefuse.llm import jaccard, packing, quality, secrets, toxicity
from tidefuse.llm.common import kept, table, vocabulary_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; rejected ones, and texts without words, go."""
    return quality.accepted(docs, quality.train(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold. All labels of kept documents train, also in small samples."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def free_name(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    while name in columns:
        name += "_"
    return name


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id (nulls last).

    Repeated rows count as copies. Documents without words all stay. An id that stands for
    one row decides about it; rows that share an id, or have none, are told apart by their sets.
    """
    names = docs.columns
    key, digest, size, row, other = (free_name(x, names) for x in ("_key", "_digest", "_size", "_row", "_other"))
    groups = kept(jaccard.components(docs), "groups")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    # Documents whose ids are null have their component through their class.
    roots = groups.where("n_shingles > 0").groupBy("component_id", F.when(
        F.col("component_id").isNull(), F.col("node")).alias("alone")).agg(F.min(first).alias("m"))
    chosen = kept(roots.select(F.col("m.doc_id").alias("doc_id"), F.col("m.node").alias("node")), "chosen")
    rows = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("words"))
    single = rows.where("n = 1 AND doc_id IS NOT NULL")
    stay = single.where("words = 0").select("doc_id").union(single.where("words > 0").join(chosen, "doc_id").select("doc_id"))
    several = rows.where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(other))

    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    plain = keyed.join(stay.select(F.col("doc_id").alias(other)), F.col(key) == F.col(other), "left_semi")
    again = keyed.join(several, F.col(key).eqNullSafe(F.col(other)), "left_semi")
    again = jaccard.with_digest(again, digest, size)
    kept_sets = chosen.select(F.col("doc_id").alias(other), F.col("node").alias(row))
    full = again.where(F.col(size) > 0).join(
        kept_sets, F.col(key).eqNullSafe(F.col(other)) & (F.col(digest) == F.col(row)), "left_semi")
    # Map-side too: rows of one id and set are as many as they like.
    one = full.groupBy(key, digest).agg(F.min_by(
        F.struct(*[F.col(f"`{c}`") for c in names]), F.struct("text", F.xxhash64(*[F.col(f"`{c}`") for c in names]))).alias(row))
    bare = again.where(F.col(size) == 0)
    quoted = [f"`{c}`" for c in names]
    return plain.select(*quoted).unionByName(one.select(f"{row}.*")).unionByName(bare.select(*quoted))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    return secrets.redact(docs, secrets.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return packing.pack(packing.tokenize_pieces(docs, vocabulary_path()))


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Trained models, tokenizers and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
