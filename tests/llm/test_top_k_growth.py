"""Blocks of vectors met by many queries at once: the same results as all products, thresholds that rise."""

from __future__ import annotations

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidefuse.llm import topk  # noqa: E402

K = 3


def block_of(ids, v, copies=None):
    order = np.argsort(-np.linalg.norm(v, axis=1), kind="stable")
    copies = np.ones(len(ids), np.int64) if copies is None else copies
    return topk.Block(ids[order].tobytes(), copies[order].tobytes(), topk.stored(v[order]))


def wanted(q_ids, q, ids, v):
    """All products in Python's whole numbers."""
    out = []
    for i in range(len(q)):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], x, strict=True)), int(own))
                        for own, x in zip(ids, v, strict=True) if own != q_ids[i])
        out += [(int(q_ids[i]), own, -s) for s, own in scores[:K]]
    return sorted(out)


@pytest.mark.parametrize("scale", [90, 1 << 20, 1 << 29])
@pytest.mark.parametrize("near", [False, True])
def test_matrix_products_give_every_result(monkeypatch, scale, near):
    """In singles, doubles and Python's whole numbers, by length and by coordinate, in several pieces of a block."""
    monkeypatch.setattr(topk, "ROWS", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "FEW", 2)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(230, 6)) * rng.choice([0.2, 1, 3], 230)[:, None]
    if near:  # groups around a few long coordinates
        v = np.eye(6)[rng.integers(0, 6, 230)] * 3 + 0.1 * rng.normal(size=(230, 6))
    v = np.floor(scale * v)
    v[5] = 0
    ids = rng.integers(0, 150, 230)
    pick = rng.integers(0, 230, 40)
    q_ids, q = np.arange(40), v[pick]
    least = topk.first_thresholds(q_ids, q, ids[:40], v[:40], K)
    before = least.copy()
    found = topk.best(q_ids, q, np.ones(40, np.int64), block_of(ids, v), least, K)
    assert sorted(zip(*(x.tolist() for x in found[:3]), strict=True)) == wanted(q_ids, q, ids, v)
    assert (least >= before).all() and (least > before).any()
    last = {i: s for i, _, s in sorted(zip(*(x.tolist() for x in found[:3]), strict=True), key=lambda x: -x[2])}
    assert all(least[i] <= last[i] for i in range(40))


def test_blocks_are_bounded_by_values():
    """Wide vectors make blocks of fewer rows; equal numbers take two bytes each."""
    assert topk.room(topk.BLOCK_VALUES, topk.BLOCK, 64) == 32768 and topk.room(topk.BLOCK_VALUES, topk.BLOCK, 4096) == 512
    assert len(topk.stored(np.full((1000, 64), 256.0))) < 2 * 64000 + 200
    for most in (2.0 ** 15 - 1, -2.0 ** 31 + 1, 2.0 ** 60):
        assert topk.unpacked(b"", topk.stored(np.array([[most, 1.0]])))[1].tolist() == [[most, 1.0]]


def test_query_groups_meet_a_block_in_few_rows(spark):
    """Rows that pair a group of queries with a block do not grow with every 512 queries and 4,096 vectors."""
    vectors = spark.range(9000).selectExpr("id AS vec_id", "transform(sequence(1, 4), x -> CAST(floor(100 * sin(id * x)) AS double)) AS v")
    found = topk.search(vectors, F.col("vec_id") % 2 == 0, k=2)
    assert found.count() == 2 * 4500 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    store = [f for f in found.inputFiles() if "/thresholds-" in f]
    assert spark.read.parquet(*store).count() == 1
