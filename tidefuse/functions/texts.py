"""Word-based text preparation: truncation and overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Whitespace-separated words; blank text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def truncate_words(text: Column, limit: int) -> Column:
    return F.array_join(F.slice(words(text), 1, limit), " ")


def overlapping_chunks(
    df: DataFrame, text: str, limit: int = 384, stride: int = 128
) -> DataFrame:
    """Cut a text into chunks of ``limit`` words, neighbours sharing ``stride`` words.

    Adds chunk_no, first_word, n_words and chunk; the text column is dropped.
    Every word is covered, blank texts give no row.
    """
    if not 0 <= stride < limit:
        raise ValueError("stride must be at least 0 and below the chunk length")
    step = limit - stride
    kept = [c for c in df.columns if c != text]
    split = df.select(*kept, words(F.col(text)).alias("_words")).withColumn("_n", F.size("_words"))
    # The last chunk is the first one that reaches the end of the text.
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - limit) / step).cast("int")) * step
    starts = F.when(F.col("_n") > 0, F.sequence(F.lit(0), last, F.lit(step)))
    return (
        split.select(*kept, "_words", F.posexplode(starts).alias("chunk_no", "first_word"))
        .withColumn("_chunk", F.slice("_words", F.col("first_word") + 1, limit))
        .select(
            *kept, "chunk_no", "first_word",
            F.size("_chunk").alias("n_words"),
            F.array_join("_chunk", " ").alias("chunk"),
        )
    )
