"""Toxicity scores against a plain noisy-or, on long texts, and at sentence ends."""

from __future__ import annotations

import math
import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidefuse.llm import toxicity  # noqa: E402
from tidefuse.llm.common import fold  # noqa: E402
from tidefuse.llm.language import letters  # noqa: E402

ROOT = "/root/testdata/sf0.1"
MASK = (1 << 64) - 1
FACTOR = int(toxicity.FACTOR)


@pytest.fixture(scope="module")
def trained(spark):
    documents = spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    model = toxicity.train(documents, labels.where(fold(F.col("doc_id"), 3) != 1))
    rows = documents.join(labels, "doc_id").where(fold(F.col("doc_id"), 3) == 1).select("text", "lang", "toxic").collect()
    return model, [r.text for r in rows if not r.toxic and r.lang == "en"], [r.text for r in rows if r.toxic]


def plain_score(text, model):
    """The same score, one byte at a time."""
    data = text.encode()
    plain = letters(np.frombuffer(data, np.uint8)).tolist()
    parts, at = [], 0
    for end in re.finditer(r"[.!?\n。！？।]+", text):
        parts.append((len(text[:at].encode()), len(text[:end.end()].encode())))
        at = end.end()
    if at < len(text):
        parts.append((len(text[:at].encode()), len(data)))
    scores = []
    for start, end in parts:
        z, some = model["bias"], False
        for k in range(start, end):
            for size in (toxicity.GRAM, *toxicity.BEGINNINGS):
                if k + size > len(plain):
                    continue
                gram = plain[k:k + size]
                fits = any(c != 32 for c in gram) if size == toxicity.GRAM else gram[0] == 32 and gram[1] != 32
                if not fits:
                    continue
                code = size
                for c in gram:
                    code = (code ^ c) * FACTOR & MASK
                    code ^= code >> 29
                w = float(model["weights"][(code * FACTOR & MASK) >> (64 - toxicity.BITS)])
                z, some = z + w, some or w != 0
        scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if some else 0.0)
    none = math.prod(1 - q for q in scores if q >= toxicity.FLOOR)
    return 1 - none * (1 - toxicity.LITTLE * max(scores, default=0.0))


def scores(texts, model):
    return toxicity.batch_scores(pa.array(texts), model)[0]


def test_noisy_or_by_hand(trained):
    model, clean, toxic = trained
    texts = [t[:1500] for t in toxic[:12] + clean[:12]] + ["", "。", "one。two！three", "a.b?c!d\ne।f"]
    assert scores(texts, model) == pytest.approx([plain_score(t, model) for t in texts], abs=1e-9)


def test_length_is_no_fault(trained, spark):
    model, clean, toxic = trained
    long = " ".join(clean)
    n = len(toxicity.sentences(*toxicity.text_bytes(pa.array([long])))[0])
    long = " ".join([long] * -(-50_000 // n))
    worst = max(toxic, key=lambda t: scores([t], model)[0])
    p, starts, _, q, data, _ = toxicity.batch_scores(pa.array([worst]), model)
    k = int(q.argmax())
    bad = bytes(data[starts[k]:(list(starts[1:]) + [len(data)])[k]]).decode().strip()
    half = long.index(". ", len(long) // 2) + 2
    rows = [(1, long), (2, "we walked home. " * 50_000), (3, long[:half] + bad + " " + long[half:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(df, model, F.lit(False)).collect()}
    assert got[1]["score"] < 0.1 and got[2]["score"] < 0.1 and not got[1]["offending"]
    assert got[3]["predicted"] == 1
    assert any(s["start"] <= half + len(bad) // 2 < s["end"] for s in got[3]["offending"])


def test_sentence_ends():
    data, offsets = toxicity.text_bytes(pa.array(["a。b", "", "c！？d", "e।f", "...g\n\nh", "。"]))
    starts, text = toxicity.sentences(data, offsets)
    assert text.tolist() == [0, 0, 2, 2, 3, 3, 4, 4, 4, 5]
    assert [chr(data[s]) for s in starts[:8]] == ["a", "b", "c", "d", "e", "f", ".", "g"]


def test_sampled_rows_are_bounded(spark):
    rows = [(1, f"text {k}") for k in range(300)] + [(k, "t") for k in range(2, 60)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] * 2, "doc_id long, toxic int")
    got = toxicity.labelled(documents, labels, "toxic", 20)
    assert got.count() == 20
    assert toxicity.labelled(documents, labels.where("doc_id = 1"), "toxic", 20).collect()[0]["text"] == "text 99"


def test_labels_that_no_feature_explains(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["sun", "moon", "sea", "hill"]) for _ in range(30))) for k in range(60)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    got = toxicity.score(documents, toxicity.train(documents, labels), F.lit(False)).collect()
    assert len(got) == 60 and all(0 <= r["score"] <= 1 for r in got)
