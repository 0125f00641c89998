"""Secret scans with DataFrame functions only.

Three kinds of secrets have fixed patterns: assignments, access keys and hex
strings. A fourth kind, ``random``, comes from two character Markov models, one
of random strings and one of ordinary identifiers: a long token whose
log-likelihood ratio of the two is high is a secret too. The models are trained
from labelled samples: the values of the first kinds in a bounded sample of
documents against the words of these documents outside of such values.

A span is the whole match, in code points, its end exclusive; matches of one
kind do not overlap. Random spans that overlap another kind's are left out.
Null text is empty and has no spans. At most ``sample`` documents train the
models, those with the smallest hashed ids; counts are smoothed, so that no
sample at all gives a ratio of zero and no random spans.
A text with many matches takes work in proportion to them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, group that counts, its least length. Runs of one class of characters are
#: matched with their least length at once, which finds the same runs and no short ones to drop.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
RANDOM = "random"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9+/_=-]{3,}"
SAMPLE = 2000
#: Letters of the models: place in this string, else the last state.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(LETTERS) + 1
SMOOTHING = 0.5
#: Matches whose list grows step by step before it is joined to the others.
CHUNK = 256
#: Least log-likelihood ratio of a token, and per character.
LEAST_RATIO, LEAST_PER_CHARACTER = 12.0, 0.5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas read it per element."""
    return F.get(F.transform(F.array(value), use), 0)


def in_chunks(items: Column, total: Callable[[Column], Column], carry: Callable[[Column], Column],
              scan: Callable[[Column, Column], Column]) -> Column:
    """Concatenated ``scan(chunk, value carried into it)`` over consecutive chunks of a non-empty array.

    ``total`` sums up a chunk and ``carry`` the totals before it. An ``aggregate`` that grows a list copies it
    at each step; within chunks these copies stay short, and the work grows with the array.
    """
    def chunk(xs: Column, k: Column) -> Column:
        return F.slice(xs, k * CHUNK + 1, F.lit(CHUNK))

    return let(items, lambda xs: let(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda k: total(chunk(xs, k))),
        lambda totals: F.flatten(F.transform(totals, lambda _, k: scan(
            chunk(xs, k), carry(F.slice(totals, F.lit(1), k)))))))


def with_matches(df: DataFrame, name: str, pattern: str, group: int, least: int, guard: Column) -> DataFrame:
    """Adds the array of (start, end, value) of all leftmost matches whose group has the least length.

    The pieces between the matches come from splitting; running lengths of pieces and matches give the places.
    """
    empty = F.array().cast("array<string>")
    found = df.withColumn("_m", F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty))
    some = F.size("_m") > 0
    found = found.withColumn("_g", F.when(some, F.split("text", pattern, -1)).otherwise(empty)).withColumn(
        "_v", F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(empty)
        if group else F.col("_m"))
    span = "struct<start:bigint,end:bigint,value:string>"
    none = F.array().cast(f"array<{span}>")

    def total(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0).cast("long"), lambda a, x: a + F.length(x["_g"]) + F.length(x["_m"]))

    def carry(totals: Column) -> Column:
        return F.aggregate(totals, F.lit(0).cast("long"), lambda a, x: a + x)

    def scan(chunk: Column, at: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["_g"])
            end = start + F.length(x["_m"])
            one = F.struct(start.alias("start"), end.alias("end"), x["_v"].alias("value")).cast(span)
            return F.struct(end.alias("at"), F.when(
                F.length(x["_v"]) >= least, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])

    # Splitting gives one piece more than there are matches; it has no match after it.
    pieces = F.slice(F.arrays_zip("_g", "_m", "_v"), F.lit(1), F.size("_m"))
    return found.withColumn(name, F.when(some, in_chunks(pieces, total, carry, scan)).otherwise(none)).drop(
        "_m", "_g", "_v")


def base_spans(df: DataFrame) -> DataFrame:
    """Adds one array of spans per kind of BASE to rows with ``text``."""
    guards = {"assign": F.contains("text", F.lit("=")) | F.contains("text", F.lit(":")),
              "access": F.contains("text", F.lit("AKIA")),
              "hex": F.rlike("text", F.lit("[0-9a-f]{24}"))}
    for name, pattern, group, least in BASE:
        df = with_matches(df, name, pattern, group, least, guards[name])
    return df


def states(text: Column) -> Column:
    """The model states of a token's characters."""
    return F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(STATES)).otherwise(
        F.pmod(F.instr(F.lit(LETTERS), c) - 1, F.lit(STATES))))


def steps(text: Column) -> Column:
    """Pairs of neighbouring states as numbers."""
    s = states(text)
    return F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1),
                      lambda a, b: a * STATES + b)


def train(documents: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratio (random to ordinary) of each pair of characters; STATES * STATES numbers."""
    ids = documents.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` ids: broadcast, so that no text is shuffled.
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(ids), "doc_id").select("text")
    rows = base_spans(texts)
    values = F.concat(*[F.transform(name, lambda x: x["value"]) for name, *_ in BASE])
    rest = F.col("text")
    for _, pattern, *_ in BASE:
        rest = F.regexp_replace(rest, pattern, " ")
    rows = rows.select(F.array_distinct(values).alias("secret"),
                       F.array_distinct(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("word"))
    labelled = rows.select(F.explode("secret").alias("value"), F.lit(1).alias("label")).union(
        rows.select(F.explode("word"), F.lit(0)))
    pairs = labelled.select("label", F.explode(steps(F.col("value"))).alias("pair"))
    counts = {(r[0], r[1]): r[2] for r in pairs.groupBy("label", "pair").count().collect()}  # at most 2 * STATES^2
    if not any(label == 1 for label, _ in counts) or not any(label == 0 for label, _ in counts):
        return [0.0] * (STATES * STATES)
    table = []
    for a in range(STATES):
        total = [sum(counts.get((y, a * STATES + b), 0) for b in range(STATES)) for y in (0, 1)]
        p = [[(counts.get((y, a * STATES + b), 0) + SMOOTHING) / (total[y] + SMOOTHING * STATES)
              for b in range(STATES)] for y in (0, 1)]
        table += [math.log(p[1][b] / p[0][b]) for b in range(STATES)]
    return table


def before(spans: Column, field: str, limit: Column) -> Column:
    """How many of the ordered spans have ``field`` below ``limit``, by halving."""
    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        below = F.get(spans, middle)[field] < limit
        return F.when(a["low"] >= a["high"], a).otherwise(F.struct(
            F.when(below, middle + 1).otherwise(a["low"]).alias("low"),
            F.when(below, a["high"]).otherwise(middle).alias("high")))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda a: a["low"])


def scanned(documents: DataFrame, model: list[float]) -> DataFrame:
    """``documents`` with base and all spans: arrays of (start, order, end, kind, value), sorted."""
    rows = base_spans(documents.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = with_matches(rows, "_token", TOKEN, 0, 20, F.rlike("text", F.lit(TOKEN)))
    # A literal array: folded from one text once, at planning.
    ratio = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in model) + "]"), "array<double>")

    def score(x: Column) -> Column:
        return F.aggregate(steps(x["value"]), F.lit(0.0), lambda a, p: a + F.get(ratio, p))

    def as_spans(name: str, order: int) -> Column:
        return F.transform(name, lambda x: F.struct(
            x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"),
            F.lit(RANDOM if order == len(BASE) else BASE[order][0]).alias("kind"), x["value"].alias("value")))

    base = F.array_sort(F.concat(*[as_spans(name, k) for k, (name, *_) in enumerate(BASE)]))
    rows = rows.withColumn("_base", base)
    # Spans of one kind are apart and in order, so two binary searches count those that a token meets.
    free = let(F.struct(*[F.col(name) for name, *_ in BASE]), lambda base: F.filter("_token", lambda x: ~reduce(
        Column.__or__, [before(base[name], "start", x["end"]) > before(base[name], "end", x["start"] + 1)
                        for name, *_ in BASE])))
    rows = rows.withColumn("_token", free)
    judged = F.transform("_token", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                                      x["value"].alias("value"), score(x).alias("ratio")))
    rows = rows.withColumn("_token", judged)
    rows = rows.withColumn("_token", F.filter("_token", lambda x: (x["ratio"] >= LEAST_RATIO) & (
        x["ratio"] >= LEAST_PER_CHARACTER * F.length(x["value"]))))
    return rows.withColumn("_spans", F.array_sort(F.concat("_base", as_spans("_token", len(BASE)))))


def joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def scan(documents: DataFrame, model: list[float]) -> DataFrame:
    """doc_id, counts per base kind, base_sha256, spans (text), n_random, found (nested spans with values)."""
    # Named apart, so that other columns of the table cannot clash.
    rows = scanned(documents.select("doc_id", "text"), model)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(name).cast("long").alias(f"n_{name}") for name, *_ in BASE],
        F.sha2(joined("_base").cast("binary"), 256).alias("base_sha256"), joined("_spans").alias("spans"),
        F.size("_token").cast("long").alias("n_random"), F.col("_spans").alias("found"))


def redact(documents: DataFrame, model: list[float], mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every span replaced by ``mark``; the other columns stay, n_chars is counted anew."""
    names = documents.columns
    # Scanned apart from the other columns' names, which may be anything.
    rows = scanned(documents.select(F.struct(*names).alias("_row"), F.col("text").alias("text")), model)
    spans = F.col("_spans")

    def total(chunk: Column) -> Column:
        return F.array_max(F.transform(chunk, lambda x: x["end"] + 1))

    def carry(totals: Column) -> Column:
        return F.coalesce(F.array_max(totals), F.lit(1).cast("long"))

    def scan(chunk: Column, at: Column) -> Column:
        """What stays of the text between ``at`` and the last end, with a mark for each group of spans."""
        # Substrings count from the text's beginning, so each chunk has its own part of it.
        part = F.substring(F.col("text"), at, F.greatest(total(chunk) - at, F.lit(0)))
        none = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))
        return let(F.struct(part.alias("part"), at.alias("from")), lambda p: F.aggregate(
            chunk, none, lambda a, x: F.struct(
                F.greatest(a["at"], x["end"] + 1).alias("at"),
                F.when(x["start"] + 1 < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(
                    F.substring(p["part"], a["at"] - p["from"] + 1, x["start"] + 1 - a["at"]), F.lit(mark)))).alias("out")),
            lambda a: a["out"]))

    rows = rows.withColumn("_merged", F.when(F.size(spans) > 0, in_chunks(spans, total, carry, scan)))
    after = F.substring(F.col("text"), total(spans), F.length("text"))
    text = F.when(F.col("_merged").isNull(), F.col("_row.text")).otherwise(
        F.concat(F.array_join("_merged", ""), after))
    rows = rows.withColumn("_text", text)
    size = {"n_chars": F.when(F.col("_merged").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text"))
            .cast(documents.schema["n_chars"].dataType)} if "n_chars" in names else {}
    return rows.select(*[(size | {"text": F.col("_text")}).get(c, F.col("_row")[c]).alias(c) for c in names])
