"""Quality classification from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Their
accuracies are not known; expectation-maximisation estimates them, and the share
of good documents, from how often each pattern of votes occurs over all
documents. The posterior of each pattern then labels a bounded sample of
documents, and these labels train a linear scorer of hashed features (shapes of
characters and binned counts), which decides on every document.

At most ``sample`` documents, those with the smallest hashed ids, train the
scorer. A text without words, or null, scores 0. An empty table gives a scorer
that keeps every text with words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefuse.llm.common import slices, text_bytes
from tidefuse.llm.jaccard import word_hashes

SAMPLE = 6000
BUCKETS = 1024
#: Words are compared inside windows of about so many, as any prose repeats more words the longer it is.
WINDOW_WORDS = 512
#: Passages of so many words are compared in the whole text; prose of any length hardly repeats them.
PASSAGE_WORDS = 5
ROUNDS = 60
STEPS = 250
#: Weight of the assumed accuracy beside the estimated one.
PRIOR = 0.5
GOOD, BAD, NONE = 0, 1, 2
#: name, measure, votes bad from here on, ordinary below this, least words to vote bad.
SUSPECTS = (
    ("symbols", "symbols", 0.10, 0.06, 2),
    ("symbol_runs", "runs", 0.15, 0.06, 3),
    ("shouting", "upper", 0.40, 0.25, 4),
    ("bare_symbols", "bare", 0.10, 0.03, 8),
    ("echo", "echo", 0.15, 0.08, 8),
    ("few_words", "repeated", 0.65, 0.55, 40),
    ("long_words", "word_length", 24.0, 14.0, 8),
    ("repeated_lines", "lines", 0.60, 0.50, 40),
)
#: Two more labellers vote good: all measures ordinary, and varied words in mixed case.
LABELLERS = (*(x[0] for x in SUSPECTS), "ordinary", "varied")
MEASURES = ("symbols", "runs", "upper", "bare", "echo", "repeated", "word_length", "lines")


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of a text's bytes are marked."""
    # Running counts of the narrowest type, in place: they are the largest arrays of a batch.
    total = np.zeros(len(values) + 1, np.int32 if len(values) < 2 ** 31 else np.int64)
    np.cumsum(values, dtype=total.dtype, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def distinct(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return np.bincount(owner[first], minlength=n)


def repeated_words(words: np.ndarray, owner: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Share of words seen before in their window, or of passages seen before in the text if that is more."""
    n = len(count)
    windows = np.maximum(1, np.rint(count / WINDOW_WORDS).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(windows)])
    place = np.arange(len(words)) - (np.cumsum(count) - count)[owner]
    window = first[owner] + place * windows[owner] // np.maximum(1, count)[owner]
    new = np.concatenate([[0], np.cumsum(distinct(window, words, int(first[-1])))])
    near = 1 - (new[first[1:]] - new[first[:-1]]) / np.maximum(1, count)
    starts = max(0, len(words) - PASSAGE_WORDS + 1)
    passage = np.zeros(starts, np.uint64)
    for k in range(PASSAGE_WORDS):
        passage = passage * np.uint64(0x9E3779B97F4A7C15) + words[k:k + starts]
    inside = owner[:starts] == owner[len(owner) - starts:]
    total = np.bincount(owner[:starts][inside], minlength=n)
    far = np.where(total > 0, 1 - distinct(owner[:starts][inside], passage[inside], n) / np.maximum(1, total), 0)
    return np.maximum(near, far)


def unspaced(data: np.ndarray) -> np.ndarray:
    """First bytes of code points of Chinese, Japanese, Thai, Lao, Burmese and Khmer, by their UTF-8 ranges."""
    after = np.append(data[1:], np.uint8(0)) if len(data) else data
    return (((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE0) & (after >= 0xB8) & (after <= 0xBB))
            | ((data == 0xE1) & (((after >= 0x80) & (after <= 0x82)) | (after == 0x9E) | (after == 0x9F))))


def letters(data: np.ndarray, space: np.ndarray) -> np.ndarray:
    """First bytes of code points that are no blanks, without scripts that put no spaces between words."""
    out = unspaced(data)
    out |= space
    out |= (data & 0xC0) == 0x80
    return np.logical_not(out, out=out)


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Shares and means per text, with the number of words."""
    n = len(offsets) - 1
    lower, upper = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90)
    other = data >= 128
    space = (data == 32) | ((data >= 9) & (data <= 13))
    digit = (data >= 48) & (data <= 57)
    symbol = ~(lower | upper | other | space | digit)
    run = np.zeros(len(data), bool)
    run[1:] = symbol[1:] & symbol[:-1]
    size = np.maximum(1, np.diff(offsets)).astype(np.float64)
    words, owner = word_hashes(data, offsets)
    count = np.bincount(owner, minlength=n)
    some = np.maximum(1, count)
    echo = np.zeros(len(words), bool)
    echo[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] |= inside[offsets[:-1][np.diff(offsets) > 0]]
    starts = np.flatnonzero(begins)
    has_letter = np.add.reduceat((lower | upper | other | digit).astype(np.int64), starts) > 0 if len(starts) else starts
    line = np.zeros(len(data), bool)
    line[1:] = data[:-1] == 10
    line[offsets[:-1][np.diff(offsets) > 0]] = True
    line_starts = np.flatnonzero(line)
    line_owner = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = np.bincount(line_owner, minlength=n)
    line_words = np.concatenate([[np.uint64(0)], np.cumsum(words, dtype=np.uint64)])
    at = np.searchsorted(starts, np.append(line_starts, len(data)))
    line_hash = line_words[at[1:]] - line_words[at[:-1]]
    return {
        "words": count,
        "symbols": per_text(symbol, offsets) / size,
        "runs": per_text(run, offsets) / some,
        "upper": per_text(upper, offsets) / np.maximum(1, per_text(lower | upper, offsets)),
        "bare": np.bincount(owner[~has_letter], minlength=n) / some if len(starts) else np.zeros(n),
        "echo": np.bincount(owner[echo], minlength=n) / some,
        "repeated": np.where(count > 0, repeated_words(words, owner, count), 0.0),
        "word_length": per_text(letters(data, space), offsets) / some,
        "lines": 1 - distinct(line_owner, line_hash, n) / np.maximum(1, lines) - (lines == 0),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """GOOD, BAD or NONE of each labeller (columns) on each text."""
    out = np.full((len(m["words"]), len(LABELLERS)), NONE)
    ordinary = m["words"] > 0
    for k, (_, name, bad, below, least) in enumerate(SUSPECTS):
        enough = m["words"] >= least
        out[enough & (m[name] >= bad), k] = BAD
        ordinary &= ~enough | (m[name] < below)
    out[ordinary, -2] = GOOD
    out[(m["words"] >= 20) & (m["repeated"] < 0.4) & (m["upper"] < 0.3) & (m["symbols"] < 0.08), -1] = GOOD
    return out


def vote_counts(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vote patterns (at most 3 ** labellers) and how many documents have each."""
    base = 3 ** np.arange(len(LABELLERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in slices(batches):
            m = measures(*text_bytes(batch.column(0)))
            counts += np.bincount((votes(m) @ base)[m["words"] > 0], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["pattern", "n"])

    texts = documents.select(F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    pattern = found["pattern"].to_numpy()
    return pattern[:, None] // base % 3, found["n"].to_numpy().astype(np.float64)


def estimate(patterns: np.ndarray, counts: np.ndarray) -> dict:
    """Share of bad documents, and how often each labeller is right when it votes."""
    right, bad = np.full(len(LABELLERS), 0.8), 0.15
    for _ in range(ROUNDS if len(counts) else 0):
        post = posterior(patterns, right, bad)
        bad = float(np.clip((counts * post).sum() / counts.sum(), 1e-3, 0.5))
        agree = counts @ np.where(patterns == BAD, post[:, None], np.where(patterns == GOOD, 1 - post[:, None], 0))
        # Drawn to 0.9: labellers of different faults seldom meet, and their votes alone would let
        # the rarer class vanish.
        voted = counts @ (patterns != NONE) + 1e-9
        right = np.clip(((1 - PRIOR) * agree / voted + PRIOR * 0.9), 0.55, 0.999)
    return {"right": right, "bad": bad}


def posterior(patterns: np.ndarray, right: np.ndarray, bad: float) -> np.ndarray:
    """Probability that a document with these votes is bad; a labeller that does not vote says nothing."""
    odds = ((patterns == BAD) - (patterns == GOOD).astype(int)) @ np.log(right / (1 - right))
    return 1 / (1 + np.exp(-np.clip(odds + np.log(bad / (1 - bad)), -40, 40)))


def features(data: np.ndarray, offsets: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """Hashed features: frequencies of three-character shapes, and bins of the measures."""
    n = len(offsets) - 1
    shape = np.full(256, 97, np.uint32)
    shape[:128] = np.arange(128)
    shape[65:91], shape[97:123], shape[48:58], shape[9:14] = 65, 97, 48, 10
    x = np.zeros((n, BUCKETS), np.float32)
    if len(data) > 2:
        s = shape[data]
        code = (s[:-2] << np.uint32(16)) | (s[1:-1] << np.uint32(8)) | s[2:]
        owner = np.repeat(np.arange(n), np.diff(offsets))
        same = owner[:-2] == owner[2:]
        key = owner[:-2][same] * BUCKETS + ((code[same] * np.uint32(0x9E3779B1)) >> np.uint32(22))
        place, count = np.unique(key, return_counts=True)
        x.ravel()[place] = np.sqrt(count / np.maximum(1, np.diff(offsets))[place // BUCKETS])
    for k, name in enumerate(MEASURES):
        scale = 1.0 if name != "word_length" else 20.0
        bin_ = np.clip(m[name] / scale * 20, 0, 19).astype(np.uint32)
        at = ((np.uint32(k * 32 + 7) + bin_) * np.uint32(0x85EBCA6B)) >> np.uint32(22)
        x[np.arange(n), at] += 0.5
    return x


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (Adam)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, moment, square = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        grad = (p - y) @ x / len(x) + 1e-5 * w
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        w -= 0.1 * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1].astype(np.float32), float(w[-1])


def train(documents: DataFrame, sample: int = SAMPLE) -> dict:
    """The labellers' estimated accuracies and the scorer's weights."""
    model = estimate(*vote_counts(documents))
    right, bad = model["right"], model["bad"]
    ids = documents.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(0))
            m = measures(data, offsets)
            some = m["words"] > 0
            y = posterior(votes(m), right, bad)[some]
            x = features(data, offsets, m)[some].astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in x], pa.binary()), pa.array(y, pa.float64())], ["x", "y"])

    # At most `sample` ids: broadcast, so that no other text is shuffled. Rows that repeat an id count
    # once, with the text of the smallest hash, so that no more than `sample` rows reach the driver.
    chosen = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = chosen.select("text").mapInArrow(run, "x binary, y double").toArrow()
    if rows.num_rows == 0:
        return model | {"weights": np.zeros(BUCKETS, np.float32), "bias": -1.0}
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    weights, bias = fit(x, rows["y"].to_numpy())
    return model | {"weights": weights, "bias": bias}


def batch_scores(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Score (1 is good) and weak-label posterior of being good, of each text."""
    data, offsets = text_bytes(texts)
    m = measures(data, offsets)
    z = features(data, offsets, m) @ model["weights"] + model["bias"]
    some = m["words"] > 0
    good = 1 - 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
    weak = 1 - posterior(votes(m), model["right"], model["bad"])
    return np.where(some, good, 0.0), np.where(some, weak, 0.0)


def classify(documents: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1, higher is better), weak_label (posterior of good), kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score, weak = batch_scores(batch.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(weak), pa.array(score >= threshold)],
                ["doc_id", "score", "weak_label", "kept"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, weak_label double, kept boolean")


def accepted(documents: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that the scorer keeps."""
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(batch_scores(batch.column(place), model)[0] >= threshold))

    return documents.mapInArrow(run, documents.schema)
