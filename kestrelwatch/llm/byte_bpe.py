"""What a byte-level BPE file of the tokenizers library says, and the pieces it cuts a text into before merging."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import regex

# Fixed value: the pattern by which byte-level BPE cuts texts.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same pieces. A text of ASCII alone is cut by a pattern without Unicode classes, which is faster.
_PLAIN = regex.compile(r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?(?:[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]+)|\s+(?!\S)|\s+", re.ASCII)


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, as U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class ByteBpe:
    """Small enough to be broadcast: its size is that of the vocabulary file.

    ``start``: the token of each byte. ``left``, ``right``, ``made``: the merges in the order of their rank.
    ``spelled``: the bytes of every token, special ones included.
    """

    start: np.ndarray
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    spelled: dict[int, bytes]
    special: dict[str, int] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return max(self.spelled) + 1


def load(path: str) -> ByteBpe:
    """Reads the file on the driver. Kinds of files whose rules are not carried out here are refused."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model, before = found["model"], found.get("pre_tokenizer") or {}
    if (
        model.get("type") != "BPE"
        or before.get("type") != "ByteLevel"
        or before.get("add_prefix_space")
        or not before.get("use_regex", True)
        or found.get("normalizer")
        or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    ):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    vocab, back = model["vocab"], byte_of_char()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in found.get("added_tokens", [])}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in found.get("added_tokens", [])):
        raise ValueError(f"{path} has added tokens that take in their surroundings")
    spelled = {i: bytes(back[c] for c in t) for t, i in vocab.items() if t not in special}
    spelled |= {i: t.encode() for t, i in special.items()}
    start = np.zeros(256, dtype=np.int64)
    for char, byte in back.items():
        start[byte] = vocab[char]
    ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int64).reshape(-1, 3)
    return ByteBpe(start, ids[:, 0].copy(), ids[:, 1].copy(), ids[:, 2].copy(), spelled, special)


@lru_cache(maxsize=4)
def _marks(special: tuple[str, ...]):
    return re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))


def pieces(text: str, special: tuple[str, ...]) -> list[str]:
    """The pieces that are merged apart from each other. The string of a special token is a piece of its own."""
    cut = (_ASCII if text.isascii() else _PLAIN).findall
    if not any(s in text for s in special):
        return cut(text)
    out, at = [], 0
    for mark in _marks(special).finditer(text):
        out += cut(text[at : mark.start()])
        out.append(mark.group())
        at = mark.end()
    return out + cut(text[at:])
