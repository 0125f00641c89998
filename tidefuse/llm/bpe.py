"""Byte-level BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that occur side by side inside no token of the
vocabulary cannot end up in one token. Every pre-token is cut there, and the
fragments are merged independently of each other, then concatenated. The parts
between safe spaces are remembered within a task.

Null text is the empty text, which has no tokens. The string of a special
token in a text becomes that token, as the tokenizers library does.
"""

from __future__ import annotations

import gc
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefuse.llm.common import slices
from tidefuse.llm.vocabulary import PATTERN, Vocabulary, chunks

CACHED = 1 << 19


class Codec:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        vocabulary = Vocabulary(path)
        self.bytes, self.special = vocabulary.bytes, vocabulary.special
        merges = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})
        self.merged = merges._encode_single_piece
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.together = {pair for token in vocabulary.ids for pair in zip(token, token[1:])}
        self.parts: dict[str, tuple[bytes, str]] = {}

    def forced(self, data: bytes) -> list[bytes]:
        """Fragments of a pre-token between pairs of bytes that no token holds."""
        together = self.together
        if together.issuperset(zip(data, data[1:])):
            return [data]
        cuts = [k for k, pair in enumerate(zip(data, data[1:]), 1) if pair not in together]
        ends = [0, *cuts, len(data)]
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def part(self, text: str) -> tuple[bytes, str]:
        """Ids of a part as little-endian bytes and as decimal text."""
        if text[1:].isalpha() and text[0] == " ":
            ids = [k for fragment in self.forced(text.encode()) for k in self.merged(fragment)]
            return array("I", ids).tobytes(), ",".join(map(str, ids))
        ids = []
        pieces = self.specials.split(text) if self.specials and "<" in text else [text]
        for piece in pieces:
            if piece in self.special:
                ids.append(self.special[piece])
                continue
            for token in self.pattern.findall(piece):
                for fragment in self.forced(token.encode()):
                    ids += self.merged(fragment)
        return array("I", ids).tobytes(), ",".join(map(str, ids))

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a whole text, and the same as comma-joined decimals."""
        parts, known = chunks(text), self.parts
        first = self.part(parts.pop(0))
        found = [*map(known.get, parts)]
        if None in found:
            if len(known) >= CACHED:
                known.clear()
            for k, part in enumerate(found):
                if part is None:
                    found[k] = part = self.part(" " + parts[k])
                    if len(parts[k]) <= 64:
                        known[parts[k]] = part
        if first[1]:
            found.insert(0, first)
        return np.frombuffer(b"".join([p[0] for p in found]), "<u4"), ",".join([p[1] for p in found])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in slices(batches):
            ids = [codec.encode(t or "")[0].astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return chosen(documents).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of ids; null ids are null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in slices(batches):
            texts = [None if x is None else codec.decode(np.asarray(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(
        run, "doc_id long, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text encoded, then decoded from its ids."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        gc.disable()  # the remembered parts hold no cycles
        for batch in slices(batches):
            counts, encoded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids, decimals = codec.encode(text or "")
                counts.append(len(ids))
                encoded.append(sha(decimals))
                decoded.append(sha(codec.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return chosen(documents).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def chosen(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
