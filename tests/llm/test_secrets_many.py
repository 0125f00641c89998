"""Secret scans against a plain version: every span, the ratio of the two models, texts with many matches."""

from __future__ import annotations

import random
import re
import time

import pytest

from tidefuse.llm import secrets

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, n_chars long"


@pytest.fixture(scope="module")
def model(spark):
    """Learned from ordinary texts and texts with secrets; ordinary texts alone hold too few of them."""
    ordinary = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text")
    odd = spark.createDataFrame([(k, odd_text(100 + k, 20)) for k in range(100)], "doc_id long, text string")
    return secrets.train(ordinary.union(odd))


def plain(text: str, model: list[float]) -> list[tuple]:
    """(start, order, end, kind, value) of all spans, in order."""
    base = [(m.start(), k, m.end(), name, m.group(group)) for k, (name, pattern, group, least) in enumerate(secrets.BASE)
            for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    random_ = []
    for m in re.finditer(secrets.TOKEN, text, re.ASCII):
        states = [secrets.LETTERS.index(c) for c in m.group()]
        ratio = sum(model[a * secrets.STATES + b] for a, b in zip(states, states[1:]))
        if any(a < m.end() and b > m.start() for a, _, b, *_ in base):
            continue
        if ratio >= secrets.LEAST_RATIO and ratio >= secrets.LEAST_PER_CHARACTER * len(m.group()):
            random_.append((m.start(), len(secrets.BASE), m.end(), secrets.RANDOM, m.group()))
    return sorted(base + random_)


def cleaned(text: str, spans: list[tuple], mark: str) -> str:
    out, at = [], 0
    for start, _, end, *_ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def odd_text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    makers = (
        lambda: f"{rng.choice(['token', 'API_KEY', 'passwd'])} = \"{''.join(rng.choices(letters, k=rng.randint(2, 40)))}\"",
        lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=rng.randint(12, 30))),
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(20, 60))),
        lambda: "secret:" + "".join(rng.choices("0123456789abcdef", k=rng.randint(20, 60))),
        lambda: "".join(rng.choices(letters, k=rng.randint(15, 60))),
        lambda: rng.choice(["some_ordinary_identifier_name", "üß🙂", "the", "and of", "\n", "token=token:abc"]),
    )
    return " ".join(rng.choice(makers)() for _ in range(n))


def test_spans_and_redaction_are_those_of_the_plain_version(spark, model):
    chunk = secrets.CHUNK
    texts = [odd_text(k, n) for k, n in enumerate((0, 1, 2, 7, 40, chunk, 3 * chunk, 12 * chunk))]
    # Exactly one chunk of matches, one more, and matches that touch.
    texts += [" ".join(["a token=abcdef1"] * n) for n in (chunk - 1, chunk, chunk + 1, 2 * chunk)]
    texts += [None, "token=abcdef" * 5, "secret=" + "ab12" * 9 + "ab12" * 9]
    rows = spark.createDataFrame([(k, t, None if t is None else len(t)) for k, t in enumerate(texts)], COLUMNS).repartition(4)
    wanted = {k: plain(t or "", model) for k, t in enumerate(texts)}
    got = {r.doc_id: [(x.start, x.order, x.end, x.kind, x.value) for x in r.found]
           for r in secrets.scan(rows, model).collect()}
    assert got == wanted
    assert sum(s[3] == secrets.RANDOM for spans in wanted.values() for s in spans) > 100
    clean = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(rows, model, "[X]").collect()}
    for k, t in enumerate(texts):
        expected = None if t is None else cleaned(t, wanted[k], "[X]")
        assert clean[k] == (expected, len(expected) if expected is not None else None)


def test_many_matches_in_one_text_take_work_in_proportion(spark, model):
    n = 100_000
    text = " ".join(f"token{k}: api_key=value{k:06d}x some_ordinary_identifier_name{k}" for k in range(n))
    rows = spark.createDataFrame([(1, text, len(text))], COLUMNS)
    begin = time.time()
    row = secrets.scan(rows, model).select("n_assign").first()
    clean = secrets.redact(rows, model, "[X]").selectExpr("length(text) - length(replace(text, '[X]', '')) AS n").first()
    assert row.n_assign == n and clean.n >= 3 * n
    assert secrets.train(rows) is not None
    assert time.time() - begin < 60
