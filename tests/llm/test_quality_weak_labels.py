"""The weak-label model against a plain version, and its measures in scripts of many kinds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidefuse.llm import quality
from tidefuse.llm.common import text_bytes


def plain_posterior(pattern: tuple, right: list[float], bad: float) -> float:
    p_bad, p_good = bad, 1 - bad
    for vote, a in zip(pattern, right):
        if vote == quality.BAD:
            p_bad, p_good = p_bad * a, p_good * (1 - a)
        elif vote == quality.GOOD:
            p_bad, p_good = p_bad * (1 - a), p_good * a
    return p_bad / (p_bad + p_good)


def plain_estimate(counted: dict[tuple, int]) -> tuple[list[float], float]:
    """Expectation-maximisation, one pattern and labeller after the other."""
    right, bad = [0.8] * len(quality.LABELLERS), 0.15
    for _ in range(quality.ROUNDS):
        post = {p: plain_posterior(p, right, bad) for p in counted}
        bad = min(0.5, max(1e-3, sum(n * post[p] for p, n in counted.items()) / sum(counted.values())))
        for k in range(len(right)):
            voted = sum(n for p, n in counted.items() if p[k] != quality.NONE)
            agree = sum(n * (post[p] if p[k] == quality.BAD else 1 - post[p])
                        for p, n in counted.items() if p[k] != quality.NONE)
            estimated = agree / (voted + 1e-9)
            right[k] = min(0.999, max(0.55, (1 - quality.PRIOR) * estimated + quality.PRIOR * 0.9))
    return right, bad


def measured(*texts: str) -> dict[str, np.ndarray]:
    return quality.measures(*text_bytes(pa.array(texts)))


def test_accuracies_and_posteriors_are_those_of_the_plain_version(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    patterns, counts = quality.vote_counts(documents)
    texts = [r.text for r in documents.select("text").collect()]
    counted: dict[tuple, int] = {}
    for text in texts:
        m = measured(text or "")
        if m["words"][0]:
            pattern = tuple(int(x) for x in quality.votes(m)[0])
            counted[pattern] = counted.get(pattern, 0) + 1
    assert {tuple(int(x) for x in p): int(n) for p, n in zip(patterns, counts)} == counted
    right, bad = plain_estimate(counted)
    model = quality.estimate(patterns, counts)
    assert model["bad"] == pytest.approx(bad) and list(model["right"]) == pytest.approx(right)
    for p, got in zip(patterns, quality.posterior(patterns, model["right"], model["bad"])):
        assert math.isclose(got, plain_posterior(tuple(p), right, bad), rel_tol=1e-6, abs_tol=1e-9)


@pytest.mark.parametrize("text, length", [
    ("four five seven", 13 / 3),
    ("длинное слово по-русски", 21 / 3),
    ("हिन्दी में लिखा", 13 / 3),
    ("Größe über Straße", 15 / 3),
    ("中文没有空格", 0.0),
    ("ภาษาไทยไม่มีช่องว่าง", 0.0),
    ("日本語 と English", 7 / 3),
])
def test_word_lengths_are_code_points_of_spaced_scripts(text, length):
    assert measured(text)["word_length"][0] == pytest.approx(length)


def test_length_of_words_speaks_against_no_script():
    at = quality.LABELLERS.index("long_words")
    for text in ("यह एक साधारण वाक्य है जो अच्छा लिखा गया है", "это обычное предложение на русском языке без ошибок совсем",
                 "这是一个普通的句子没有任何空格因为中文不需要它们 " * 10, "ประโยคภาษาไทยธรรมดาที่เขียนโดยไม่มีช่องว่างระหว่างคำ " * 10):
        assert quality.votes(measured(text))[0, at] == quality.NONE


def test_one_row_of_each_sampled_id_trains(spark):
    good = "The river ran past the old mill while {} people walked home along its quiet and shaded eastern bank"
    rows = [(k, good.format(k)) for k in range(40)] + [(7, "$$$ ### !!! @@@ " * 20)] * 500 + [(None, "x"), (8, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    one, two = quality.train(documents), quality.train(documents.orderBy(F.desc("doc_id")))
    # Which row of a repeated id counts does not depend on the order of rows; sums differ by rounding only.
    assert np.allclose(one["weights"], two["weights"], atol=1e-3) and one["bias"] == pytest.approx(two["bias"], abs=1e-3)
