"""The Jaccard join on passages that many texts share, on groups around one original, and near the threshold."""

from __future__ import annotations

import os
import random
import sys
import time

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidefuse.llm import jaccard  # noqa: E402


def words(rng, n):
    return [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]


def brute_force(rows):
    """doc_id to (set size, component) by all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), low[top(i)]) for i, (doc_id, _) in enumerate(rows))


def joined(spark, rows):
    found = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect())


def with_passage(rng, n, passage, own):
    return [(k, " ".join(passage + words(rng, own))) for k in range(n)]


def test_shared_passages_below_the_threshold_cost_no_round(spark, monkeypatch):
    """Lists of texts that share most words but cannot link vanish before any pair is made."""
    rng = random.Random(1)
    asked = []
    monkeypatch.setattr(jaccard, "segments", lambda *a: asked.append(a))
    rows = with_passage(rng, 400, words(rng, 160), 40)
    begin = time.time()
    assert joined(spark, rows) == sorted((k, 196, k) for k, _ in rows)
    assert not asked and time.time() - begin < 60


@pytest.mark.parametrize("own", [16, 20, 24, 28, 32])
def test_passages_around_the_threshold(spark, own):
    """Shared parts of 75 to 87 percent, some with the passage cut or in two pieces."""
    rng = random.Random(own)
    passage = words(rng, 120)
    rows = with_passage(rng, 40, passage, own)
    rows += [(100 + k, " ".join(passage[:60] + words(rng, k) + passage[60:])) for k in range(12)]
    rows += [(200 + k, " ".join(passage[k:] + words(rng, own // 2))) for k in range(20)]
    assert joined(spark, rows) == brute_force(rows)


def test_copies_that_link_through_their_original_alone(spark):
    rng = random.Random(5)
    original = words(rng, 200)
    rows = [(500, " ".join(original))]
    for k in range(60):
        copy = list(original)
        for at in rng.sample(range(0, 200, 10), 4):
            copy[at] = f"x{k}-{at}"
        rows.append((k, " ".join(copy)))
    chain = words(rng, 300)  # each links with the next ones only
    rows += [(1000 + k, " ".join(chain[7 * k:7 * k + 120])) for k in range(25)]
    rows += [(2000 + k, rows[k % 30][1]) for k in range(40)]  # exact copies
    got = joined(spark, rows)
    assert got == brute_force(rows)
    assert len({c for d, _, c in got if d < 900}) == 1


def test_random_edits_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for group in range(6):
        base = words(rng, rng.choice([6, 30, 90, 250]))
        for k in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 15) + 1)):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randrange(0, 2)] = words(rng, rng.randrange(0, 2))
            rows.append((group * 100 + k, " ".join(copy)))
    assert joined(spark, rows) == brute_force(rows)


def test_scratch_tables_are_removed(spark, monkeypatch):
    made, gone = [], []
    kept, forget = jaccard.kept, jaccard.forget

    def noted(df, name):
        made.append(name)
        return kept(df, name)

    def removed(*tables):
        gone.extend(t for t in tables if t is not None)
        forget(*tables)

    monkeypatch.setattr(jaccard, "kept", noted)
    monkeypatch.setattr(jaccard, "forget", removed)
    rng = random.Random(2)
    rows = [(k, " ".join(words(rng, 30))) for k in range(20)]
    rows += [(100 + k, rows[k][1] + " more") for k in range(20)]
    assert joined(spark, rows) == brute_force(rows)
    assert {"lists", "pairs", "ends", "postings"} <= set(made) and len(gone) >= 5


def test_sketches_never_rule_out_a_link():
    """Sketches differ in no more bits than the sets in shingles; long ones tell apart what short ones cannot."""
    rng = np.random.default_rng(4)
    for size in (40, 700, 5000):
        base = rng.integers(0, 1 << 56, size, dtype=np.uint64)
        other = np.concatenate([base[: size * 9 // 10], rng.integers(0, 1 << 56, size // 10, dtype=np.uint64)])
        far = rng.integers(0, 1 << 56, size, dtype=np.uint64)
        hashes = np.concatenate([base, other, far])
        owner = np.repeat(np.arange(3), [len(base), len(other), len(far)])
        sizes = np.bincount(owner)
        short, long = (x.to_pylist() for x in jaccard.sketches(owner, hashes, sizes))
        assert (long[0] is not None) == (size >= jaccard.LONG)
        for sketch in (short, long) if long[0] else (short,):
            def bits(i, j, sketch=sketch):
                return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(sketch[i], sketch[j]))

            assert bits(0, 0) == 0 and bits(0, 1) <= len(np.setxor1d(base, other))
        assert 7 * bits(0, 2) > sizes[0] + sizes[2]
