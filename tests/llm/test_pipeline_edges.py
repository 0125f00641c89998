"""One document of each group: repeated and missing ids, clashing columns, an empty table."""

from __future__ import annotations

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402

CLASHING = ("_key", "_digest", "_size", "_row", "_other", "node", "n_shingles", "component_id", "_copy")


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(CLASHING)])


def test_one_of_each_group(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
    text, near, other = " ".join(base), " ".join([*base, "more"]), " ".join(base[::-1])
    rows = [
        (5, text, "en", "s", 1), (3, near, "en", "s", 1), (3, near, "en", "s", 1),  # the smallest id stands for two rows
        (9, other, "en", "t", 1), (9, "", "en", "t", 0), (9, " ", None, None, 1),  # an id of three different texts
        (None, "a b c d e f g", None, None, None), (None, "a b c d e f g", "de", None, None), (None, None, None, None, None),
        (11, None, None, None, None), (12, other + " x", "en", "t", 1),
    ]
    docs = documents(spark, rows)
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(3, near), (9, other), (9, ""), (9, " "), (None, "a b c d e f g"), (None, None), (11, None)], key=repr)


def test_stages_of_an_empty_table(spark):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES[2:4]:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns and not got.count(), name
    assert not corpus_pipeline.STAGES[4][1](spark, docs, "").count()
