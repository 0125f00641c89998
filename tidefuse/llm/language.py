"""Language identification by mixtures.

Hashed byte n-grams of each language are counted over all training documents.
A document's n-grams are a mixture of the languages' distributions: its shares
come from expectation-maximisation, and its set of languages from penalised
likelihood. It starts with the best single language; another one joins while
the log-likelihood gains more than the penalty.

Null text, or text without a letter, is ``und`` with score 0. Only text is used
to predict. Without any training row everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefuse.llm.common import slices, text_bytes

GRAM = 4
BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 25
UNKNOWN = "und"
F1 = np.uint32(0x9E3779B1)


def letters(data: np.ndarray) -> np.ndarray:
    """ASCII letters and accented Latin letters lower-cased; every other ASCII byte becomes a space."""
    upper = (data >= 65) & (data <= 90)
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    out = np.where(upper | accented, data + np.uint8(32), data)
    return np.where((out < 97) | ((out > 122) & (out < 128)), np.uint8(32), out)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams with a letter, and the text each lies in."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = letters(data)
    code = np.zeros(n, np.uint32)
    blank = np.ones(n, bool)
    for k in range(GRAM):
        part = data[k:n + k]
        code = (code << np.uint32(8)) | part
        blank &= part == 32
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good = ~blank & (owner[:n] == owner[GRAM - 1:])
    return ((code[good] * F1) >> np.uint32(32 - 16)).astype(np.int64), owner[:n][good]


def train(documents: DataFrame) -> dict:
    """Counts per language over all rows with a language; the model has languages x BUCKETS numbers."""
    known = documents.where("lang IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    number = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(number) * BUCKETS, np.int64)
        for batch in slices(batches):
            gram, owner = grams(*text_bytes(batch.column(1)))
            language = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            counts += np.bincount(language[owner] * BUCKETS + gram, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["place", "n"])

    total = known.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(len(languages) * BUCKETS, SMOOTHING)
    counts[total["place"].to_numpy()] += total["n"].to_numpy()
    table = counts.reshape(len(languages), BUCKETS) if languages else np.zeros((0, BUCKETS))
    common = int(table.sum(axis=1).argmax()) if languages else 0
    return {"languages": languages, "common": common, "p": (table / table.sum(axis=1, keepdims=True)).astype(np.float32)}


def shares(counts: np.ndarray, p: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The chosen languages and their proportions in one document."""
    total = counts.sum()
    penalty = 0.5 * GRAM * np.log(total + 1)
    single = np.log(p) @ counts
    chosen = [int(single.argmax())]
    share, mix, best = np.ones(1), p[chosen[0]], single[chosen[0]]
    while len(chosen) < len(p):
        # The likelihood is concave: a language whose slope is not positive here cannot raise it.
        slope = p @ (counts / mix)
        slope[chosen] = 0
        new = int(slope.argmax())
        if slope[new] <= total:
            break
        tried = [*chosen, new]
        rows = p[tried]
        w = np.append(share * 0.9, 0.1)
        for _ in range(ROUNDS):
            w = w * (rows @ (counts / (w @ rows))) / total
        mixed = w @ rows
        likelihood = np.log(mixed) @ counts
        if likelihood - best <= penalty:
            break
        chosen, share, mix, best = tried, w, mixed, likelihood
    return chosen, share


def predict(documents: DataFrame, model: dict, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (name and share of each language in the text)."""
    named = model["languages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model["p"].astype(np.float64)
        for batch in slices(batches):
            texts = batch.column(2)
            lettered = batch.column(3).to_pylist()
            gram, owner = grams(*text_bytes(texts))
            key, counts = np.unique(owner * BUCKETS + gram, return_counts=True)
            ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * BUCKETS)
            best, score, all_ = [], [], []
            for k, (a, b) in enumerate(zip(ends, ends[1:])):
                if a == b or not named or not lettered[k]:
                    some = bool(named) and lettered[k]
                    # Too short for an n-gram: the most common language.
                    best.append(named[model["common"]] if some else UNKNOWN)
                    score.append(1.0 / len(named) if some else 0.0)
                    all_.append([])
                    continue
                chosen, share = shares(counts[a:b].astype(np.float64), p[:, key[a:b] % BUCKETS])
                top = int(share.argmax())
                best.append(named[chosen[top]])
                score.append(min(1.0, max(0.0, float(share[top]))))
                all_.append([{"lang": named[c], "share": float(s)} for c, s in zip(chosen, share)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64()),
                 pa.array(all_, kind)], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
                            F.col("text").cast("string").alias("text"))
    # N-grams hold any byte outside ASCII; whether a text has a letter is asked of its characters.
    rows = rows.withColumn("lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, "
                                "languages array<struct<lang:string,share:double>>")
