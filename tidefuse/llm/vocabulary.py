"""Byte-level BPE vocabularies: token bytes, and safe places to cut a text."""

from __future__ import annotations

import json
import re

#: A space before a visible character always begins a pre-token, whatever stands before it.
CUT = re.compile(r" (?=\S)")
UNSAFE = re.compile(r" (?:\s|\Z)")
#: Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the file, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """The parts of a tokenizer file that encoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        model = content["model"]
        self.ids = {to_bytes(token): k for token, k in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes = {k: b for b, k in self.ids.items()} | {k: s.encode() for s, k in self.special.items()}


def chunks(text: str) -> list[str]:
    """Parts that are encoded alike alone and in the text; all but the first follow a space."""
    return CUT.split(text) if UNSAFE.search(text) else text.split(" ")
