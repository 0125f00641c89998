"""Labelled datasets by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefuse.operators.blocks import range_blocks, scan


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    task: str
    inputs: tuple[str, ...]
    label: str | None = None
    n_labels: int | None = None


# Known public datasets with their input and label columns.
REGISTRY = {
    s.name: s
    for s in (
        DatasetSpec("imdb_sentiment", "text_classification", ("text",), "label", 2),
        DatasetSpec("glue_cola", "text_classification", ("sentence",), "label", 2),
        DatasetSpec("glue_sst2", "text_classification", ("sentence",), "label", 2),
        DatasetSpec("ag_news", "text_classification", ("text",), "label", 4),
        DatasetSpec("cifar10", "image_classification", ("img",), "label", 10),
        DatasetSpec("cifar100", "image_classification", ("img",), "label", 100),
        DatasetSpec("fashion_mnist", "image_classification", ("image",), "label", 10),
        DatasetSpec("mnist", "image_classification", ("image",), "label", 10),
        DatasetSpec("wikitext", "language_modeling", ("text",)),
        DatasetSpec("squad", "question_answering", ("context", "question", "answers")),
    )
}


def register(spec: DatasetSpec) -> None:
    REGISTRY[spec.name] = spec


def load_dataset(
    spark: SparkSession, name: str, path: str, split: str = "split",
    split_sizes: Mapping[str, int] | None = None, order: str | None = None,
) -> DataFrame:
    """Rows of a registered dataset, only its columns, optionally capped per split."""
    if name not in REGISTRY:
        raise ValueError(f"unknown dataset {name}")
    if split_sizes and not order:
        raise ValueError("split sizes need an order that says which rows stay")
    spec = REGISTRY[name]
    raw = spark.read.parquet(path)
    wanted = [split, *spec.inputs, *([spec.label] if spec.label else []), *([order] if order else [])]
    rows = check_columns(raw, wanted).select(*dict.fromkeys(wanted))
    return cap_splits(rows, split_sizes, split, order) if split_sizes else rows


def check_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"dataset lacks columns {missing}")
    return df


def required_nulls(df: DataFrame, required: Sequence[str], split: str = "split") -> DataFrame:
    """Per split: rows, and rows in which a required value is missing."""
    check_columns(df, [split, *required])
    broken = F.greatest(*[F.col(c).isNull() for c in required]) if len(required) > 1 else F.col(required[0]).isNull()
    return df.groupBy(split).agg(
        F.count("*").alias("n_rows"), F.count_if(broken).alias("n_broken")
    )


def cap_splits(df: DataFrame, sizes: Mapping[str, int], split: str, order: str) -> DataFrame:
    """The first rows of each named split by ``order`` (unique), other splits whole.

    Only (split, order) is ranked; the rows themselves are filtered against one
    cut-off per split, so wide columns never move.
    """
    size = F.create_map(*[x for s, n in sizes.items() for x in (F.lit(s), F.lit(n))])
    limit = F.try_element_at(size, F.col(split))
    narrow = df.where(limit.isNotNull()).select(split, order)
    ranked = scan(range_blocks(narrow, [split], [order]), [split], [order], total={"_n": F.lit(1)})
    cutoffs = (
        ranked.where(F.col("_n") <= limit).groupBy(F.col(split).alias("_split"))
        .agg(F.max(order).alias("_cutoff"))
    )
    joined = df.join(cutoffs, F.col(split) == F.col("_split"), "left")
    inside = limit.isNull() | F.coalesce(F.col(order) <= F.col("_cutoff"), F.lit(False))
    return joined.where(inside).select(*df.columns)


def label_distribution(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    return df.groupBy(split, label).agg(F.count("*").alias("n"))


def enabled_metrics(metrics: DataFrame) -> DataFrame:
    """Enabled metrics per source; a disabled category counts as disabled metrics."""
    return metrics.where(F.col("enabled")).select("source", "category", "metric")


def batched_map(df: DataFrame, function, schema: str) -> DataFrame:
    """A user function over batches of rows as pandas frames.

    Batches stream through the tasks; for work the built-in functions cannot do.
    """

    def over(batches):
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(over, schema)
