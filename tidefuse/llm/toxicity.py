"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a score, the logistic
function of its hashed byte n-grams' weights; the document's score is their
noisy-or. Only documents have labels, so the weights are fitted through the
noisy-or. Sentences with a high score of their own are the offending ones.

A sentence without any telling n-gram scores 0, and sentences below a floor do not add
up, so a text is not more toxic for being long. Sentences end after ASCII, full-width,
ideographic and Devanagari marks and at line ends.

Fitting uses at most ``sample`` labelled rows, those with the smallest hashed
ids, one row of each id. Only n-gram buckets that are far more frequent in toxic
documents get a weight. Null text is empty and scores 0; so does
everything when no labelled row of either kind exists. Labels that repeat for
a document count once, as toxic if any says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefuse.llm.common import slices, text_bytes
from tidefuse.llm.language import letters

#: Ends of sentences: ASCII, the line's end, the ideographic and full-width ones, the danda.
ENDS = (b".", b"!", b"?", b"\n", "\u3002".encode(), "\uff01".encode(), "\uff1f".encode(), "\u0964".encode())
GRAM = 5
#: Bytes of the beginnings of words that count too, their leading space included.
BEGINNINGS = (6, 7, 8, 9, 10, 12)
BITS = 19
SAMPLE = 20_000
FEATURES = 4096
LEAST_DOCUMENTS = 3
LEAST_ODDS, LEAST_Z = 2.0, 3.5
STEPS = 400
OFFENDING = 0.5
#: Weight of a clean document against a toxic one in fitting.
CLEAN = 2.0
#: Sentences below the floor do not add up; the highest sentence of all adds this share of its score.
FLOOR, LITTLE = 0.4, 0.05
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all sentences, and the text each is in. A sentence ends after one of ENDS, or a run of them."""
    stop = np.isin(data, np.frombuffer(b"".join(e for e in ENDS if len(e) == 1), np.uint8))
    for end in (e for e in ENDS if len(e) == 3):
        at = np.flatnonzero((data[:-2] == end[0]) & (data[1:-1] == end[1]) & (data[2:] == end[2]))
        stop[at] = stop[at + 1] = stop[at + 2] = True
    begins = np.zeros(len(data), bool)
    begins[1:] = stop[:-1] & ~stop[1:]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(offsets, starts, side="right") - 1


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams with a letter, and longer beginnings of words, with their places in order."""
    plain = letters(data)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    codes, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in (GRAM, *BEGINNINGS):
        n = len(data) - size + 1
        if n <= 0:
            continue
        use = owner[:n] == owner[size - 1:]
        if size == GRAM:
            use &= np.convolve(plain != 32, np.ones(size, np.int8))[size - 1:][:n] > 0
        else:
            use &= (plain[:n] == 32) & (plain[1:n + 1] != 32)
        at = np.flatnonzero(use)
        code = np.full(len(at), size, np.uint64)
        for k in range(size):
            code = (code ^ plain[at + k]) * FACTOR
            code ^= code >> np.uint64(29)
        codes.append(((code * FACTOR) >> np.uint64(64 - BITS)).astype(np.int64))
        places.append(at)
    at = np.concatenate(places)
    order = np.argsort(at, kind="stable")
    return np.concatenate(codes)[order], at[order]


def labelled(documents: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """text and label of at most ``sample`` labelled documents, one row each: of repeated ids the greatest text."""
    said = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("label"))
    said = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    # At most `sample` rows of two numbers: broadcast, so that only the sampled documents' texts are shuffled.
    rows = texts.join(F.broadcast(said), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    return rows.select("text", "label")


def document_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of either label that hold each bucket; element 0 of the second array has their numbers."""
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(0))
            label = (batch.column(1).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            gram, at = grams(data, offsets)
            key = np.unique((np.searchsorted(offsets, at, side="right") - 1) * size + gram)
            counts += np.bincount(label[key // size] * size + key % size, minlength=2 * size).reshape(2, size)
            total += np.bincount(label, minlength=2)
        at = np.flatnonzero(counts.sum(axis=0))
        place = np.append(at, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place), *(pa.array(np.append(counts[k][at], total[k])) for k in (0, 1))], ["place", "n0", "n1"])

    found = rows.mapInArrow(run, "place long, n0 long, n1 long").groupBy("place").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    place = found["place"].to_numpy()
    counts, total = np.zeros((2, size)), np.zeros(2)
    for k, name in enumerate(("n0", "n1")):
        values = found[name].to_numpy()
        counts[k][place[place >= 0]] = values[place >= 0]
        total[k] = values[place < 0].sum()
    return counts, total


def telling(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The buckets that are far more frequent in toxic documents, by their log-odds over its error."""
    odds = [np.log((counts[k] + 0.5) / (total[k] - counts[k] + 0.5)) for k in (0, 1)]
    error = sum(1 / (counts[k] + 0.5) + 1 / (total[k] - counts[k] + 0.5) for k in (0, 1))
    z = (odds[1] - odds[0]) / np.sqrt(error)
    z[(counts[1] < LEAST_DOCUMENTS) | (odds[1] - odds[0] < LEAST_ODDS)] = 0
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return best[z[best] > LEAST_Z]


def bags(rows: DataFrame, features: np.ndarray) -> list[np.ndarray]:
    """label and sentences of each document; document, sentence and feature of each occurrence of a chosen bucket."""
    number = np.full(1 << BITS, -1, np.int32)
    number[features] = np.arange(len(features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(0))
            starts, text = sentences(data, offsets)
            gram, at = grams(data, offsets)
            feature = number[gram]
            at, feature = at[feature >= 0], feature[feature >= 0]
            sentence = np.searchsorted(starts, at, side="right") - 1
            n = np.bincount(text, minlength=batch.num_rows)
            first = np.cumsum(n) - n
            cuts = np.searchsorted(text[sentence], np.arange(batch.num_rows + 1)).astype(np.int32)
            local = (sentence - first[text[sentence]]).astype(np.int32) if len(sentence) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(n.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(local)),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32)))],
                ["label", "n", "sentence", "feature"])

    got = rows.mapInArrow(run, "label int, n int, sentence array<int>, feature array<int>").toArrow()
    label, n = got["label"].to_numpy(), got["n"].to_numpy()
    lists = got["sentence"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    document = np.repeat(np.arange(len(label)), sizes)
    return [label, n, document, lists.flatten().to_numpy(), got["feature"].combine_chunks().flatten().to_numpy()]


def fit(label, n, document, local, feature, features: int) -> tuple[np.ndarray, float]:
    """Weights and bias that make noisy-or document scores likely (Adam on the mean log-loss).

    Sentences without a chosen feature have no part in it, so a bag is no likelier for being long.
    """
    first = np.cumsum(n) - n
    sentence, place = np.unique(first[document] + local, return_inverse=True)
    owner = np.searchsorted(first, sentence, side="right") - 1
    w, moment, square = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    w[-1] = -4.0
    for step in range(1, STEPS + 1):
        z = np.clip(w[-1] + np.bincount(place, w[feature], minlength=len(sentence)), -30, 30)
        q = 1 / (1 + np.exp(-z))
        none = np.bincount(owner, np.log1p(-np.minimum(q, 1 - 1e-12)), minlength=len(n))
        p = np.clip(-np.expm1(none), 1e-9, 1)
        factor = np.where(label > 0, -(1 - p) / p, CLEAN) / len(n)  # d loss / d log(1 - q), negated
        # A toxic text without any chosen feature cannot be learned from.
        slope = factor[owner] * q
        grad = np.zeros(features + 1)
        grad[:-1] = np.bincount(feature, slope[place], minlength=features) + 1e-5 * w[:-1]
        grad[-1] = slope.sum()
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        w -= 0.1 * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        w[-1] = min(w[-1], -2.0)
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> dict:
    """Weights of all buckets and the bias; a fixed size."""
    rows = labelled(documents, labels, label, sample)
    counts, total = document_counts(rows)
    table = np.zeros(1 << BITS, np.float32)
    if total.min() == 0:
        return {"weights": table, "bias": -np.inf}
    features = telling(counts, total)
    weights, bias = fit(*bags(rows, features), len(features))
    table[features] = weights
    return {"weights": table, "bias": bias}


def batch_scores(batch_text: pa.Array, model: dict):
    """Document scores; first byte, text and score of every sentence; the texts' bytes and offsets.

    A sentence without a chosen feature scores 0. Sentences from ``FLOOR`` on count in the noisy-or; of
    all, the highest counts once more for a little, so that no length of clean ones adds up to a verdict.
    """
    data, offsets = text_bytes(batch_text)
    n = len(offsets) - 1
    starts, text = sentences(data, offsets)
    if not len(starts) or not np.isfinite(model["bias"]):
        return np.zeros(n), starts, text, np.zeros(len(starts)), data, offsets
    gram, at = grams(data, offsets)
    weight = model["weights"][gram]
    at, weight = at[weight != 0], weight[weight != 0]
    sentence = np.searchsorted(starts, at, side="right") - 1
    z = model["bias"] + np.bincount(sentence, weight, minlength=len(starts))
    some = np.bincount(sentence, minlength=len(starts)) > 0
    q = np.where(some, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
    above = np.where(q >= FLOOR, np.minimum(q, 1 - 1e-12), 0.0)
    none = np.bincount(text, np.log1p(-above), minlength=n)
    highest = np.zeros(n)
    np.maximum.at(highest, text, q)
    return 1 - np.exp(none) * (1 - LITTLE * highest), starts, text, q, data, offsets


def score(documents: DataFrame, model: dict, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending sentences (start, end in code points, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p, starts, text, q, data, offsets = batch_scores(batch.column(2), model)
            p = np.clip(p, 0.0, 1.0)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            ends = np.append(starts[1:], len(data))
            out = [[] for _ in p]
            for k in np.flatnonzero(q >= OFFENDING).tolist():
                base = points[offsets[text[k]]]
                out[text[k]].append({"start": int(points[starts[k]] - base), "end": int(points[ends[k]] - base),
                                     "score": float(q[k])})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)),
                 pa.array(out, kind)], ["doc_id", "held_out", "score", "predicted", "offending"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
                            F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, "
                                "offending array<struct<start:long,end:long,score:double>>")


def accepted(documents: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The documents, all columns, that score below the threshold."""
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(batch_scores(batch.column(place), model)[0] < threshold))

    return documents.mapInArrow(run, documents.schema)
