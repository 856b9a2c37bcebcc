"""Byte-level BPE over padded matrices of tokens, one row per piece.

Pieces that a task has not met before are sorted into buckets by length. The pieces of a bucket are the rows of a matrix of
tokens, padded to the bucket's width, beside a matrix of the ranks of neighbouring pairs. In every round each row merges its
leftmost pair of minimum rank: the row moves up by one place behind it, and only the two pairs beside the new token are looked
up again, in a hash table with open addressing. Rows without a pair leave the matrix. Ranks are those of a vocabulary that
gives each token a rank and no merges: two tokens may merge if their bytes together are a token, whose rank is theirs.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelwatch.llm.arrow import id_and_text, map_batches, raw_texts, slices

#: Widths of the buckets. A longer piece is a row of its own whose lowest pair comes from a heap.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256)
#: Tokens in one matrix, bytes of text handled at once, and pieces that a task remembers.
CELLS = 1 << 19
SLICE = 1 << 20
REMEMBERED = 250_000
NEVER = np.int32(2**31 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as file:
        found = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    if any(bytes([b]) not in found for b in range(256)):
        raise ValueError(f"{path} lacks single bytes, so not every text has an encoding")
    return found


def mergeable(found: dict[bytes, int]) -> np.ndarray:
    """``left, right, merged`` of every way in which a token falls into two tokens."""
    out = []
    for token, rank in found.items():
        for i in range(1, len(token)):
            left = found.get(token[:i])
            if left is not None:
                right = found.get(token[i:])
                if right is not None:
                    out.append((left, right, rank))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


class Pairs:
    """Hash table from pairs of tokens to the token they merge into: open addressing, looked up for whole arrays."""

    def __init__(self, pairs: np.ndarray) -> None:
        bits = max(4, int(2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.merged = np.full(1 << bits, NEVER, dtype=np.int32)
        keys, values = (pairs[:, 0] << 32) | pairs[:, 1], pairs[:, 2].astype(np.int32)
        at = self.place(keys)
        while len(keys):
            # Of the keys that meet in a free slot the first takes it; all others go on to the next slot.
            free = np.flatnonzero(self.keys[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            self.keys[slots], self.merged[slots] = keys[free[first]], values[free[first]]
            left = np.ones(len(keys), dtype=bool)
            left[free[first]] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token, ``NEVER`` where the two do not merge or one is padding (negative)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(len(keys), NEVER, dtype=np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        at = self.place(keys[open_])
        while len(open_):
            held = self.keys[at]
            same = held == keys[open_]
            out[open_[same]] = self.merged[at[same]]
            on = ~same & (held >= 0)
            open_, at = open_[on], (at[on] + 1) & self.mask
        return out


class Encoder:
    """Ids of texts, with a memory of pieces. Ids of all known pieces stand in one array."""

    def __init__(self, found: dict[bytes, int], pairs: np.ndarray, pattern: str) -> None:
        self.whole, self.pairs, self.cutter = found, Pairs(pairs), regex.compile(pattern)
        self.start = np.array([found[bytes([b])] for b in range(256)], dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.blocks: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def matrix(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of ``words`` (of at most ``width`` bytes) one after the other, and how many each has."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        inside = np.arange(width) < lengths[:, None]
        tokens = np.full((len(words), width + 1), -1, dtype=np.int32)
        tokens[:, :-1][inside] = self.start[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rank = self.pairs(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(words), width)
        done = np.full((len(words), width), -1, dtype=np.int32)
        rows = np.arange(len(words))
        place = np.arange(width)
        while True:
            best = rank.argmin(axis=1)  # the leftmost of equal ranks
            merged = rank[np.arange(len(rows)), best]
            ends = merged == NEVER
            if ends.any():
                # Compaction: finished rows leave, and so do columns that no row needs any more.
                done[rows[ends], : tokens.shape[1] - 1] = tokens[ends, :-1]
                goes_on = ~ends
                rows, tokens, rank, best, merged = rows[goes_on], tokens[goes_on], rank[goes_on], best[goes_on], merged[goes_on]
                if not len(rows):
                    break
                used = int((tokens >= 0).sum(axis=1).max())
                tokens, rank, place = np.ascontiguousarray(tokens[:, : used + 1]), np.ascontiguousarray(rank[:, :used]), place[:used]
            behind = place > best[:, None]
            rank[:, :-1] = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NEVER
            tokens[:, :-1] = np.where(behind, tokens[:, 1:], tokens[:, :-1])
            tokens[:, -1] = -1
            here = np.arange(len(rows))
            tokens[here, best] = merged
            rank[here, best] = self.pairs(merged, tokens[here, best + 1])
            inner = np.flatnonzero(best > 0)
            rank[inner, best[inner] - 1] = self.pairs(tokens[inner, best[inner] - 1], merged[inner])
        return done[done >= 0], (done >= 0).sum(axis=1)

    def long_row(self, word: bytes) -> np.ndarray:
        """One row that is too long to be moved up once per merge: its pairs wait in a heap by rank and place, and tokens know
        their neighbours. Leftmost pair of minimum rank first, as in the matrices."""
        tokens = self.start[np.frombuffer(word, dtype=np.uint8)]
        rank = self.pairs(tokens[:-1], tokens[1:])
        heap = [(int(rank[i]), int(i)) for i in np.flatnonzero(rank != NEVER)]
        heapq.heapify(heap)
        tokens, n = tokens.tolist(), len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = rank.tolist() + [int(NEVER)]
        never, known = int(NEVER), {}

        def look(a: int, b: int) -> int:
            found = known.get((a, b))
            if found is None:
                found = known[a, b] = int(self.pairs(np.array([a], np.int32), np.array([b], np.int32))[0])
            return found

        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            j = after[i]
            tokens[i], tokens[j], now[j] = r, -1, never
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            now[i] = look(r, tokens[k]) if k < n else never
            if now[i] != never:
                heapq.heappush(heap, (now[i], i))
            h = before[i]
            if h >= 0:
                now[h] = look(tokens[h], r)
                if now[h] != never:
                    heapq.heappush(heap, (now[h], h))
        return np.array([t for t in tokens if t >= 0], dtype=np.int32)

    def learn(self, fresh: list[str]) -> None:
        raw = [p.encode() for p in fresh]
        buckets: dict[int, list[int]] = {}
        widths = np.searchsorted(WIDTHS, [len(w) for w in raw]).tolist()
        single, single_ids = [], []
        for i, (word, at) in enumerate(zip(raw, widths, strict=True)):
            # A piece that is a token as a whole is that token, even where merges would not lead to it.
            token = self.whole.get(word)
            if token is None:
                buckets.setdefault(at, []).append(i)
            else:
                single.append(i)
                single_ids.append(token)
        self.store([fresh[i] for i in single], np.array(single_ids, dtype=np.int32), np.ones(len(single), dtype=np.int64))
        for at, members in buckets.items():
            if at == len(WIDTHS):
                for i in members:
                    ids = self.long_row(raw[i])
                    self.store([fresh[i]], ids, np.array([len(ids)]))
                continue
            rows = max(1, CELLS // WIDTHS[at])
            for a in range(0, len(members), rows):
                part = members[a : a + rows]
                self.store([fresh[i] for i in part], *self.matrix([raw[i] for i in part], WIDTHS[at]))

    def store(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        number = len(self.known)
        self.known.update(zip(words, range(number, number + len(words)), strict=True))
        self.blocks.append(ids)
        self.sizes.append(sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins, closed by the total."""
        if len(self.known) > REMEMBERED:
            self.forget()
        cut = [self.cutter.findall(t) for t in texts]
        self.learn(list(dict.fromkeys(p for p in chain.from_iterable(cut) if p not in self.known)))
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=sum(map(len, cut)))
        if len(self.blocks) > 1:
            self.blocks, self.sizes = [np.concatenate(self.blocks)], [np.concatenate(self.sizes)]
        ids, sizes = (self.blocks[0], self.sizes[0]) if self.blocks else (np.empty(0, np.int32), np.empty(0, np.int64))
        flat, ends = stretches(ids, np.cumsum(sizes) - sizes, sizes, which)
        return flat, np.r_[0, ends][np.r_[0, np.cumsum([len(ps) for ps in cut])]]


def stretches(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches numbered ``which`` of ``values`` one after the other, and where each ends."""
    size, start = sizes[which], starts[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - (ends - size), size) + np.arange(total)], ends


class Decoder:
    """Bytes of ids."""

    def __init__(self, found: dict[bytes, int]) -> None:
        self.none = max(found.values()) + 1
        words = [b""] * (self.none + 1)
        for token, rank in found.items():
            words[rank] = token
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(words), dtype=np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        known = np.where((ids < 0) | (ids > self.none), self.none, ids)
        letters, ends = stretches(self.letters, self.starts, self.sizes, known)
        cuts = np.r_[0, ends][bounds].astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(letters)])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], np.ndarray]:
    found = ranks(path)
    return found, mergeable(found)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` (array of int) for every row, as the tiktoken library encodes ordinary text with the ranks at ``path``,
    each match of ``pattern`` by itself; there are no special tokens. With ``decoded`` also the bytes of these ids.

    What no match of the pattern covers has no ids. Null and empty texts have none (an empty array). Null ids and repeated rows
    are kept, one row each; other columns are not read. Texts are never cut. A task holds one Arrow batch, the ids of at most
    ``REMEMBERED`` pieces and those of one slice, and matrices of ``CELLS`` tokens. There is no shuffle, and a lost task is
    simply run again. The vocabulary is broadcast; its size is that of the file.
    """
    tables = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    held: dict[str, object] = {}

    def run(batch: pa.RecordBatch):
        if not held:
            held.update(encoder=Encoder(*tables.value, pattern), decoder=Decoder(tables.value[0]))
        raw = raw_texts(batch.column(1))
        for a, b in slices([len(t) for t in raw], SLICE):
            flat, bounds = held["encoder"].encode([t.decode() for t in raw[a:b]])
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            yield batch.column(0).slice(a, b - a), ids, *([held["decoder"].decode(flat, bounds)] if decoded else [])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>" + ", decoded binary" * decoded, held)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """The rows of ``tokens`` with the bytes of their ids in ``bytes_col`` (replaced if it is there). Null ids and ids without
    a token add nothing; a null array gives null."""
    tables = tokens.sparkSession.sparkContext.broadcast(vocabulary(path)[0])
    held: dict[str, Decoder] = {}

    @F.pandas_udf("binary")
    def spell(rows: pd.Series) -> pd.Series:
        decoder = held.get("decoder") or held.setdefault("decoder", Decoder(tables.value))
        ids = [np.array([-1 if x is None or x != x else int(x) for x in row], dtype=np.int64) if row is not None else np.empty(0, np.int64) for row in rows]
        bounds = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int64)
        found = decoder.decode(np.concatenate(ids) if ids else np.empty(0, np.int64), bounds).to_pylist()
        return pd.Series([None if row is None else word for row, word in zip(rows, found, strict=True)], dtype=object)

    return tokens.withColumn(bytes_col, spell(F.col(f"`{ids_col}`")))
