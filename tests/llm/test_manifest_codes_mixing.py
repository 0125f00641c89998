"""Manifest, vector codes and mixture against brute force, SQL and their edges."""

from __future__ import annotations

import hashlib
import itertools
import os
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from helpers import database, same_result  # noqa: E402
from tidefuse.llm import codes, manifest, mixing  # noqa: E402
from tidefuse.llm.common import positions  # noqa: E402
from tidefuse.llm.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_trie_vector_codes"])
def test_same_as_sql(spark, name):
    same_result(QUERIES[name](spark, SF_DIR), database(SF_DIR), ORACLES[name])


def test_positions(spark):
    rows = [("a" if k % 3 else None, k * 7919 % 50) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, x int")
    by = defaultdict(list)
    for r in positions(df, ["g"], ["x"]).collect():
        by[r["g"]].append((r["pos"], r["x"], r["total"]))
    for g, found in by.items():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert [x for _, x, _ in found] == sorted(x for h, x in rows if h == g)
        assert {t for _, _, t in found} == {len(found)}
    assert not positions(df.limit(0), ["g"], ["x"]).count()


# Manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    shown = [row[0], row[3], row[2], row[4], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in shown))


def tree(digests):
    """All levels of a tree, and for each leaf its siblings by level as (left, right)."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 16]) for k in range(0, len(levels[-1]), 16)])
    ways = []
    for k in range(len(digests)):
        way, at = [], k
        for level in levels[:-1]:
            run = at - at % 16
            way.append((level[run:at], level[at + 1:run + 16]))
            at //= 16
        ways.append(way)
    return levels[-1][0], ways


def manifest_of(rows):
    lower = str.maketrans(manifest.UPPER, manifest.LOWER)
    sources = defaultdict(list)
    for row in rows:
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        text = row[1] if not hit or row[1] is None else row[1].translate(lower)
        sources[row[3]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), leaf(row, text), row[0]))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names]
    root, tops = tree([t[0] for t in trees])
    out = []
    for s, (subroot, ways), top in zip(names, trees, tops):
        for (_, _, digest, claimed, doc_id), way in zip(sorted(sources[s], key=lambda x: x[:3]), ways):
            way = way + top
            folded = claimed
            for left, right in way:
                folded = h(*left, folded, *right)
            proof = h(*(x for left, right in way for x in (*left, *right)))
            out.append((doc_id, digest, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows(spark, rows):
    documents = spark.createDataFrame(rows, DOCUMENT).selectExpr("*", "1 AS tree", "2 AS digest", "3 AS pos", "4 AS root")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest.claims(documents, tampered, manifest.lower_cased(F.col("text")))


def shown(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_brute_force(spark):
    # 5,000 leaves need two stored levels above the lowest; 4,097 end in runs of one.
    rows = [(k, f"Text {k}", "en", "big", k) for k in range(5000)]
    rows += [(k, f"Other {k}", None, "odd", None) for k in range(-4097, 0)]
    rows += [(k, "T", "en", f"s{k}", 1) for k in range(20)]  # lone leaves
    rows += [(7, "Same", "en", "ties", 4)] * 18 + [(None, "No id", "en", "ties", 5), (7, None, "en", "ties", 0)]
    rows += [(1, "Ä ÖX" * 50_000, "de", None, 9), (2, "", None, None, None), (3, None, None, "é", None)]
    leaves = manifest_rows(spark, rows)
    assert shown(manifest.proofs(manifest.build(leaves))) == manifest_of(rows)


def test_manifest_siblings_and_empty(spark):
    rows = [(k, f"Text {k}", "en", "a" if k < 40 else "b", k) for k in range(60)]
    m = manifest.build(manifest_rows(spark, rows))
    got = manifest.proofs(m, with_siblings=True).collect()
    for r in got:
        assert r["proof_sha256"] == h(*(a + b for a, b in zip(r["lefts"], r["rights"])))
        digest = r["leaf"]
        for a, b in zip(r["lefts"], r["rights"]):
            digest = h(a, digest, b)
        assert digest == r["root"] == m.root().first()["root"]
    assert [r["source"] for r in m.subroots().orderBy("pos").collect()] == ["a", "b"]
    assert not manifest.proofs(manifest.build(manifest_rows(spark, []))).count()
    one = manifest.proofs(manifest.build(manifest_rows(spark, rows[:1]))).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h()


# Vector codes


def compressed(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, digest) of rows of one dimension."""
    rows = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(rows[0][1])
    cut = [k * dim // parts for k in range(parts + 1)]
    books = [[r[1][a:b] for r in rows[:entries]] for a, b in zip(cut, cut[1:])]

    def nearest(k, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), n) for n, e in enumerate(books[k]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in rows:
            for k in range(parts):
                part = v[cut[k]:cut[k + 1]]
                groups[k, nearest(k, part)[1]].append(part)
        for (k, n), found in groups.items():
            books[k][n] = [sum(x) // len(found) for x in zip(*found)]
    out, total = [], defaultdict(int)
    digest = h(",".join(str(x) for b in books for e in b for x in e))
    for i, v, label in rows:
        found = [nearest(k, v[cut[k]:cut[k + 1]]) for k in range(parts)]
        error = sum(d for d, _ in found)
        total[label] += error
        out.append((i, "".join(f"{n:02x}" for _, n in found), error, label))
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=repr)


def coded(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 AS v", "2 AS dim", "3 AS code", "4 AS error")
    return sorted((tuple(r) for r in codes.compress(df, **options).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_codes_brute_force(spark):
    rng = np.random.default_rng(3)
    few = rng.integers(-3, 3, (400, 16)) / 4  # many shared prefixes, ties and equal parts
    rows = [(int(k), [float(x) for x in v], int(k % 3) if k % 5 else None) for k, v in enumerate(few)]
    rows += [(9, rows[9][1], 1)] * 30 + [(9, rows[8][1], 1), (None, rows[0][1], 2)]
    rows += [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1)]
    assert coded(spark, rows) == compressed(rows)
    assert coded(spark, rows, parts=5, entries=7, rounds=2) == compressed(rows, 5, 7, 2)


def test_codes_edges(spark):
    rows = [(k, [0.1 * k, -0.2, 0.3, 0.5], k % 2) for k in range(5)]  # fewer rows than entries and than parts
    assert coded(spark, rows) == compressed(rows)
    assert coded(spark, rows[:0]) == []
    two = rows + [(k, [0.5 * k, 1.0], 7) for k in range(9)] + [(77, [], 8)]  # each dimension apart
    got = coded(spark, two)
    assert [r[:3] for r in got if r[0] != 77] == sorted(
        [r[:3] for r in compressed(rows)] + [r[:3] for r in compressed(two[5:14])], key=repr)
    assert [r[1:4] for r in got if r[0] == 77] == [("00" * 8, 0, 0)]
    with pytest.raises(Exception, match="must lie within"):
        coded(spark, [(1, [1e30, 0.0], 1)])


def test_walk_in_blocks():
    """The stack carried between blocks gives what one walk gives, and distances are those of brute force."""
    rng = np.random.default_rng(5)
    parts = np.unique(rng.integers(-2, 3, (3000, 6)), axis=0)
    book = rng.integers(-2, 3, (16, 6))
    walk = codes.Trie(book)
    pieces = [walk.walk(parts[k:k + 37]) for k in range(0, len(parts), 37)]
    far = ((parts[:, None] - book) ** 2).sum(axis=2)
    assert (np.concatenate([p[0] for p in pieces]) == far.argmin(axis=1)).all()
    assert (np.concatenate([p[1] for p in pieces]) == far.min(axis=1)).all()


# Mixture


def size_of(text):
    import re
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_of(sizes):
    """sizes: source to words. Shares by weight, stopped at twice the size, the excess shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        left = budget - sum(out.values())
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over


def check_mixture(rows, got):
    size, source = defaultdict(int), {}
    for doc_id, text, _, s, _ in rows:
        size[s] += size_of(text)
    target = targets_of(size)
    taken, longest = defaultdict(int), defaultdict(int)
    by_id = {r[0]: r for r in rows}
    assert len(got) == len(rows)
    for r in got:
        _, text, _, s, _ = by_id[r["doc_id"]]
        assert r["size"] == size_of(text) and r["source_size"] == size[s]
        assert abs(r["target"] - target[s]) <= 1e-9 * max(1, target[s])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
        source[s] = r["target"]
    for s, t in source.items():
        assert abs(taken[s] - t) <= max(1, longest[s] / 2), (s, taken[s], t)
    return {s: taken[s] - t for s, t in source.items()}


def test_mixture(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    got = QUERIES["op13_budget_mixture"](spark, SF_DIR).collect()
    check_mixture(rows, got)
    again = QUERIES["op13_budget_mixture"](spark, SF_DIR).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_mixture_edges(spark):
    rows = [(k, "word " * (k % 50 + 1), "en", "big", 1) for k in range(2000)]
    rows += [(3000 + k, "same length here", "en", "copies", 1) for k in range(1000)]
    rows += [(5000, None, None, "empty", None), (5001, "", None, "empty", 0), (5002, " \t\n", None, "blank", 3)]
    rows += [(6000, "x y z", None, None, 3), (6001, "long " * 300_000, None, "one", 3), (6002, "a\x0bb\rc", "en", "é", 1)]
    df = spark.createDataFrame(rows, DOCUMENT).selectExpr("*", "1 AS size", "2 AS name", "3 AS rank", "4 AS target")
    apart = check_mixture(rows, mixing.mix(df).collect())
    assert abs(apart["big"]) <= 0.5  # lengths of one word make any sum
    assert not mixing.mix(df.limit(0)).count()
    repeated = spark.createDataFrame([(1, "a b c", "en", "s", 1)] * 40 + [(None, "a b", "en", "t", 1)] * 9, DOCUMENT)
    got = mixing.mix(repeated).collect()
    assert len(got) == 49 and abs(sum(r["taken"] for r in got) - 1.5 * 138) <= 3


def test_knapsack_against_all_sums():
    rng = np.random.default_rng(1)
    for _ in range(60):
        length = np.unique(rng.integers(1, 40, 4))
        free = rng.integers(0, 4, len(length))
        budget = int(rng.integers(1, 150))
        sums = {sum(n * x for n, x in zip(c, length.tolist())) for c in itertools.product(*(range(f + 1) for f in free))}
        got = mixing.knapsack(length, free, budget)
        assert (got <= free).all() and (got * length).sum() == max(s for s in sums if s <= budget)
        near = mixing.fitted(length, free, budget)
        assert (near <= free).all() and (near >= 0).all()


def test_fitted_beyond_the_window():
    length = np.arange(1, 3001)
    free = np.full(3000, 50)
    budget = 111_222_333
    taken = mixing.fitted(length, free, budget)
    assert (taken <= free).all() and (taken * length).sum() == budget
    long_ = np.array([1_000_000, 3_000_000])
    assert (mixing.fitted(long_, np.array([3, 3]), 6_900_000) * long_).sum() == 7_000_000
