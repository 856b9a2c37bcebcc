"""BPE encoding by a depth-first walk over a trie of distinct words, and decoding.

The encoding of a prefix ends in exactly one token, and before that token stands the encoding of a shorter prefix. So the
state of a trie node is its last token. It is the vocabulary entry which ends there and which the merges would leave
standing next to the last token of the node where it begins. Sorted words visit the trie depth-first: the states on the
path of the word before are kept, and only the bytes beyond the common prefix are computed. Words with the same beginning
share its encoding.
"""

from __future__ import annotations

from array import array
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelwatch.llm import byte_bpe
from kestrelwatch.llm.arrow import id_and_text, map_batches, raw_texts, slices

REMEMBERED = 250_000
PAIRS = 200_000
SLICE = 1 << 20
LAST = 1 << 40
NONE = np.empty(0, dtype=np.int64)


class Before(dict):
    """Whether a token may stand right before ``right``, remembered by token; nothing (-1) always may."""

    def __init__(self, near: Neighbours, right: int) -> None:
        self.near, self.right = near, right

    def __missing__(self, left: int) -> bool:
        fits = left < 0 or self.near.apart(left, self.right)
        self[left] = fits
        return fits


class Neighbours:
    """Tells whether two tokens stay apart when their bytes are merged by rank."""

    def __init__(self, bpe: byte_bpe.ByteBpe) -> None:
        self.rank = {pair: i for i, pair in enumerate(zip(bpe.left.tolist(), bpe.right.tolist(), strict=True))}
        self.parts = {}
        for i, (a, b, t) in enumerate(zip(bpe.left.tolist(), bpe.right.tolist(), bpe.made.tolist(), strict=True)):
            self.parts.setdefault(t, (a, b, i))
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.after: dict[int, Before] = {}
        self.remembered = 0

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at one end of a token while it grows, each with the rank of the merge that ends it."""
        found = self.edges.get((token, side))
        if found is None:
            found, until, at = [], LAST, token
            while True:
                found.append((at, until))
                if at not in self.parts:
                    break
                a, b, until = self.parts[at]
                at = b if side else a
            found.reverse()
            self.edges[token, side] = found
        return found

    def before(self, token: int) -> Before:
        """What the memory knows about tokens before ``token``."""
        return self.after.setdefault(token, Before(self, token))

    def apart(self, left: int, right: int) -> bool:
        if self.remembered > PAIRS:
            for known in self.after.values():
                known.clear()
            self.remembered = 0
        self.remembered += 1
        return self._apart(self.edge(left, 1), self.edge(right, 0))

    def _apart(self, lefts: list[tuple[int, int]], rights: list[tuple[int, int]]) -> bool:
        """Both ends grow rank by rank. A merge across the border comes first if its rank is below the next of both; of
        equal ranks the one further left is applied first."""
        i = j = 0
        while True:
            (l, l_until), (r, r_until) = lefts[i], rights[j]
            across = self.rank.get((l, r), LAST)
            if across < l_until and (across < r_until or across == r_until < LAST):
                return False
            if l_until == r_until == LAST:
                return True
            if l_until <= r_until:
                i += 1
            else:
                j += 1


class State(dict):
    """What a place of a word has in common with others: ``read``, the longest stretch of bytes up to there with which a token
    begins, and so ``ends``, the tokens that end there (what may stand before them, token, length; longest first). The state
    after one more byte stands under that byte and is found when a text first leads there, so a byte is read once, whatever
    the lengths of tokens. There are no more states than beginnings of tokens."""

    def __init__(self, endings: Endings, read: bytes) -> None:
        self.endings, self.read = endings, read
        tails = ((endings.token.get(read[i:]), len(read) - i) for i in range(len(read)))
        self.ends = tuple((endings.near.before(t), t, n) for t, n in tails if t is not None)

    def __missing__(self, byte: int) -> State:
        found = self[byte] = self.endings.state(self.read + bytes((byte,)))
        return found


class Endings:
    """The states of all places, as far as texts have led to them."""

    def __init__(self, token: dict[bytes, int], near: Neighbours) -> None:
        self.token, self.near = token, near
        self.beginnings = {word[:i] for word in token for i in range(1, len(word) + 1)}
        self.states: dict[bytes, State] = {}
        self.root = State(self, b"")

    def state(self, read: bytes) -> State:
        while read not in self.beginnings:
            read = read[1:]
        found = self.states.get(read)
        if found is None:
            found = self.states[read] = State(self, read)
        return found


class Pieces(dict):
    """Numbers of pieces. One that is asked for the first time gets the next number and waits to be learned."""

    def __init__(self) -> None:
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self.words)
        self.words.append(word)
        return found


class Encoder:
    """Token ids of texts, with a memory of pieces; the ids of all remembered pieces lie in one array."""

    def __init__(self, bpe: byte_bpe.ByteBpe) -> None:
        self.near = Neighbours(bpe)
        self.special = bpe.special
        single = set(bpe.start.tolist())
        whole = {t for t, (a, b, _) in self.near.parts.items() if self._comes_about(a, b, t)}
        self.token = {bpe.spelled[t]: t for t in single | whole}
        self.near.edges.clear()  # those of tokens that texts use come back
        self.length = {t: len(w) for w, t in self.token.items()}
        self.endings = Endings(self.token, self.near)
        self.forget()

    def _comes_about(self, a: int, b: int, token: int) -> bool:
        """Whether the merges of the token's own bytes end in the token: nothing crosses the border before its last merge."""
        rank = self.near.rank[a, b]
        i = j = 0
        lefts, rights = self.near.edge(a, 1), self.near.edge(b, 0)
        while True:
            (l, l_until), (r, r_until) = lefts[i], rights[j]
            across = self.near.rank.get((l, r), LAST)
            if l_until == r_until == LAST:
                return across == rank and self.near.parts[token][2] == rank
            if across < l_until and across <= r_until:
                return False
            if l_until <= r_until:
                i += 1
            else:
                j += 1

    def forget(self, but: np.ndarray = NONE) -> None:
        """Forgets all pieces but those with the given numbers, which a slice has just used. Special tokens come first."""
        but = but[but >= len(self.special)]
        words = [self.known.words[i] for i in but.tolist()]
        ids, sizes = (gathered(self.ids, self.starts[but], self.sizes[but])[0], self.sizes[but]) if words else (NONE, NONE)
        self.known = Pieces()
        self.starts = self.sizes = self.ids = NONE
        for word in chain(self.special, words):
            self.known[word]
        self._remember(np.r_[list(self.special.values()), ids].astype(np.int64), np.r_[[1] * len(self.special), sizes].astype(np.int64))

    def _remember(self, ids: np.ndarray, sizes: np.ndarray, order: np.ndarray | None = None) -> None:
        """The ids of the next pieces one after the other; ``order`` tells which of them each is, if not in the order of numbers."""
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        if order is not None:
            places = np.argsort(order)
            starts, sizes = starts[places], sizes[places]
        self.ids = np.concatenate([self.ids, ids])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])

    def learn(self, first: int) -> None:
        """Finds the ids of the pieces from number ``first`` on."""
        length = self.length
        before, last, states = b"", [-1], [self.endings.root]  # the last token and the state at every place of the word at hand
        order, sizes, found = [], array("q"), array("q")
        for raw, number in sorted(zip(map(str.encode, self.known.words[first:]), count())):
            common = 0
            for x, y in zip(before, raw, strict=False):
                if x != y:
                    break
                common += 1
            del last[common + 1 :], states[common + 1 :]
            state = states[common]
            for byte in raw[common:]:
                state = state[byte]
                states.append(state)
                for fits, t, n in state.ends:
                    if fits[last[-n]]:  # where the token begins
                        last.append(t)
                        break
                else:
                    raise AssertionError(f"no token can end {raw[: len(last)]!r}")
            ids, at = [], len(raw)
            while at:
                t = last[at]
                ids.append(t)
                at -= length[t]
            ids.reverse()
            order.append(number)
            sizes.append(len(ids))
            found.extend(ids)
            before = raw
        self._remember(np.array(found), np.array(sizes), np.array(order, dtype=np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text begins, closed by the total."""
        if len(self.known) > REMEMBERED:
            self.forget(self.latest)
        special = tuple(self.special)
        cut = [byte_bpe.pieces(t, special) for t in texts]
        first = len(self.known)
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=sum(map(len, cut)))
        self.learn(first)
        used = np.zeros(len(self.known), dtype=bool)
        used[which] = True
        self.latest = np.flatnonzero(used)
        flat, ends = gathered(self.ids, self.starts[which], self.sizes[which])
        bounds = np.r_[0, np.cumsum([len(ps) for ps in cut])]
        return flat, np.r_[0, ends][bounds]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` one after the other, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)], ends


class Speller:
    """Texts of ids. Ids without a spelling add nothing."""

    def __init__(self, spelled: dict[int, bytes]) -> None:
        words = [spelled.get(i, b"") for i in range(max(spelled) + 1)] + [b""]
        self.none = len(words) - 1
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(words), dtype=np.uint8)

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        found = np.where((ids < 0) | (ids > self.none), self.none, ids)
        letters, ends = gathered(self.letters, self.starts[found], self.sizes[found])
        raw, cuts = letters.tobytes(), np.r_[0, ends][bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` (array of int) for every row, as the tokenizers library encodes with the byte-level BPE file at
    ``path`` without added tokens; strings of special tokens become that token. With ``decoded`` also the text of these ids,
    so that a round trip needs no second pass.

    Null and empty texts have no ids (an empty array). Null ids and repeated rows are kept; other columns are not read.
    Texts are never cut; a task holds one Arrow batch and at most ``REMEMBERED`` pieces beyond those of one slice.
    """
    tables = docs.sparkSession.sparkContext.broadcast(byte_bpe.load(path))
    held: dict[str, object] = {}

    def run(batch: pa.RecordBatch):
        if not held:
            held.update(encoder=Encoder(tables.value), speller=Speller(tables.value.spelled))
        raw = raw_texts(batch.column(1))
        for a, b in slices([len(t) for t in raw], SLICE):
            flat, bounds = held["encoder"].encode([t.decode() for t in raw[a:b]])
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            yield batch.column(0).slice(a, b - a), ids, *([held["speller"].texts(flat, bounds)] if decoded else [])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>" + ", decoded string" * decoded, held)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows of ``tokens`` with the text of their ids in ``text_col`` (replaced if it is there), special tokens written
    out. Bytes that are no UTF-8 become U+FFFD; unknown and null ids add nothing; a null array gives null."""
    tables = tokens.sparkSession.sparkContext.broadcast(byte_bpe.load(path).spelled)
    held: dict[str, Speller] = {}

    @F.pandas_udf("string")
    def spell(rows: pd.Series) -> pd.Series:
        speller = held.get("speller") or held.setdefault("speller", Speller(tables.value))
        out = []
        for row in rows:
            if row is None:
                out.append(None)
            else:
                ids = np.array([-1 if x is None or x != x else int(x) for x in row], dtype=np.int64)
                out += speller.texts(ids, np.array([0, len(ids)]))
        return pd.Series(out, dtype=object)

    return tokens.withColumn(text_col, spell(F.col(f"`{ids_col}`")))
