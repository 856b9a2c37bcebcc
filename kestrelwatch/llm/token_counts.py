"""Token counts by merging many pre-tokens at once.

Pre-tokens that a task has not met before lie one after the other in one array of symbols. In every round each sequence
applies its own lowest-ranked pair, wherever it stands in the sequence, and all sequences do so simultaneously; a
sequence without a known pair leaves the array. What is left of it is its count. Counts are remembered per pre-token.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kestrelwatch.llm import byte_bpe
from kestrelwatch.llm.arrow import id_and_text, map_batches, raw_texts, slices

LIMIT = 1024
REMEMBERED = 300_000
NEVER = np.int64(1) << 40


class Merges:
    """Ranks and results of pairs, looked up for whole arrays."""

    def __init__(self, bpe: byte_bpe.ByteBpe) -> None:
        self.width = bpe.width
        keys = bpe.left * self.width + bpe.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), bpe.made
        self.start = bpe.start

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NEVER)
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word; words are not empty."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        counts = lengths.copy()
        symbols = self.start[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols) > 1:
            rank = np.full(len(symbols), NEVER)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.rank(symbols[:-1], symbols[1:]), NEVER)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(symbols)])
            best = np.repeat(lowest, sizes)
            hit = (rank == best) & (best < NEVER)
            # A pair of equal symbols overlaps itself in "aaa": within such a run every second place is taken, from the left.
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place))
            take = hit & (run % 2 == 1)
            symbols = np.where(take, self.made[np.where(take, rank, 0)], symbols)
            stays = np.ones(len(symbols), dtype=bool)
            stays[1:] = ~take[:-1]
            done = lowest >= NEVER
            counts[owner[first[done]]] = sizes[done]
            stays &= ~np.repeat(done, sizes)
            symbols, owner = symbols[stays], owner[stays]
        if len(symbols):
            counts[owner] = 1
        return counts


class Counter:
    """Counts of texts, with a memory of pre-tokens."""

    def __init__(self, bpe: byte_bpe.ByteBpe) -> None:
        self.merges, self.special = Merges(bpe), tuple(bpe.special)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        known.update(dict.fromkeys(self.special, 1))
        cut = [byte_bpe.pieces(t, self.special) for t in texts]
        fresh = list(set(chain.from_iterable(cut)).difference(known))
        raw = [p.encode() for p in fresh]
        for a, b in slices([len(w) for w in raw], 1 << 20):
            known.update(zip(fresh[a:b], self.merges.counts(raw[a:b]).tolist(), strict=True))
        return [sum(map(known.__getitem__, ps)) for ps in cut]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, as the tokenizers library counts with the byte-level BPE
    file at ``path`` and without added tokens; strings of special tokens count as that token.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are kept, one output row per input row;
    other columns are not read. Texts are never cut; a task holds one Arrow batch and the counts of at most
    ``REMEMBERED`` pre-tokens and those of one slice. There is no shuffle, and a lost task is simply run again.
    """
    tables = docs.sparkSession.sparkContext.broadcast(byte_bpe.load(path))
    held: dict[str, Counter] = {}

    def count(batch: pa.RecordBatch):
        counter = held.get("counter") or held.setdefault("counter", Counter(tables.value))
        raw = raw_texts(batch.column(1))
        sizes = [len(t) for t in raw]
        tokens: list[int] = []
        for a, b in slices(sizes):
            tokens += counter.count([t.decode() for t in raw[a:b]])
        yield batch.column(0), sizes, tokens, [n > limit for n in tokens]

    return map_batches(id_and_text(docs, id_col, text_col), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", held)
