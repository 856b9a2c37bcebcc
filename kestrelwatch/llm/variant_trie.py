"""Spelling variants: words that one inserted, deleted or replaced letter parts, found in a trie of letter counts.

A word's vector is its length followed by how many of its letters fall into each group of letters. The trie arranges words by
these numbers one after the other. A search goes down with a budget of one surplus and one deficit: where the word has one
letter more in a group than the branch, the surplus is spent, where it has one less, the deficit. A replaced letter costs one
of both (or nothing, within a group), an inserted one a surplus. The words of a leaf that is reached are compared letter by
letter.

The trie is dealt over tasks. Its nodes with many words form the trunk, which every task knows; what hangs below is a bucket of
bounded size. A word is filed in its own bucket and visits those that its budget reaches. Buckets with very many visitors are
searched by several tasks. Inside a bucket the visitors form a trie too, and both are walked together, depth first, by blocks of
node pairs, so that visitors with the same beginnings share their way. A leaf that is still too large (words made of the same
few letters) is split by the words that remain after taking one letter away, which only few words share.

All letters lie below U+0100, so a word is one byte per letter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelwatch.llm.arrow import BATCH_ROWS, raw_texts, scrambled
from kestrelwatch.session import materialise

GROUPS = 13
LEAST_LETTERS = 5
LEAST_COUNT = 3
SLIP = 97
#: Words below a node that make it part of the trunk, and visitors of a bucket that make it several tasks' work. The numbers grow
#: with the vocabulary where there would otherwise be more than ``NODES`` such nodes on a level or such buckets.
NODE_WORDS = 2048
BUCKET_VISITORS = 16_384
NODES = 20_000
#: Pairs of nodes in a block of the search, and bytes of words compared at once.
BLOCK = 1 << 17
COMPARED = 1 << 22

# The letters of words, for the regular expression after lower-casing A-Z.
RUN = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUP_OF = np.arange(256) % GROUPS


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the runs of letters of all texts with A-Z lower-cased, some with a slip. With ``h`` the crc32 of
    ``<id>:<run>``, the letter ``h`` modulo length is left out where ``SLIP`` divides ``h``. A null id is written as nothing, a null
    text has no runs. Only words of ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences come out."""
    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, LOWER).alias("t"))
    runs = texts.select(F.coalesce("id", F.lit("")).alias("id"), F.explode(F.regexp_extract_all("t", F.lit(RUN), F.lit(0))).alias("run"))
    # Shorter runs give no word, whether a letter goes or not.
    runs = runs.where(F.octet_length("run") >= LEAST_LETTERS).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    slipped = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = runs.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LETTERS))


@dataclass
class Words:
    """Words as bytes, one per letter, with their vectors."""

    letters: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Words:
        """From UTF-8. The letters lie below U+0100, so every word has a Latin-1 form."""
        plain = [w if w.isascii() else w.decode().encode("latin-1") for w in words]
        sizes = np.array([len(w) for w in plain], dtype=np.int64)
        return cls(np.frombuffer(b"".join(plain), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)

    def vectors(self) -> np.ndarray:
        """One row per word: its length, and its letters per group."""
        n = len(self.sizes)
        owner = np.repeat(np.arange(n), self.sizes)
        counts = np.bincount(owner * GROUPS + GROUP_OF[self.letters], minlength=n * GROUPS).reshape(n, GROUPS)
        return np.c_[self.sizes, counts]

    def rows(self, which: np.ndarray, length: int) -> np.ndarray:
        return self.letters[self.starts[which][:, None] + np.arange(length)]

    def bytes(self, i: int) -> bytes:
        return self.letters[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()


def below(node: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The hash of the child that a count leads to."""
    return scrambled(node + (count.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


ROOT = np.uint64(7)


def paths(vectors: np.ndarray) -> np.ndarray:
    """Hashes of the nodes on each word's way: column ``d`` after ``d + 1`` numbers."""
    out = np.empty(vectors.shape, dtype=np.uint64)
    node = np.full(len(vectors), ROOT)
    for d in range(vectors.shape[1]):
        node = out[:, d] = below(node, vectors[:, d])
    return out


class Trunk:
    """The nodes with many words, by hash."""

    def __init__(self, large: np.ndarray) -> None:
        self.large = np.sort(large)

    def large_nodes(self, node: np.ndarray) -> np.ndarray:
        if not len(self.large):
            return np.zeros(len(node), dtype=bool)
        return self.large[np.minimum(np.searchsorted(self.large, node), len(self.large) - 1)] == node

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each word, and whether it is a leaf that is too large."""
        nodes = paths(vectors)
        home, crowded = nodes[:, -1].copy(), self.large_nodes(nodes[:, -1])
        open_ = np.ones(len(vectors), dtype=bool)
        for d in range(vectors.shape[1]):
            stops = open_ & ~self.large_nodes(nodes[:, d])
            home[stops] = nodes[stops, d]
            open_ &= ~stops
        return home, crowded & open_

    def visits(self, vectors: np.ndarray, shorter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, bucket and whether that is a crowded leaf, for all buckets that may hold words near to each word and
        ``shorter`` letters (0 or 1) shorter."""
        word = np.arange(len(vectors))
        node = below(np.full(len(word), ROOT), vectors[:, 0] - shorter)
        surplus, deficit = np.full(len(word), 1), np.full(len(word), 1 - shorter)
        out = []
        for d in range(1, vectors.shape[1] + 1):
            goes_on = self.large_nodes(node)
            out.append((word[~goes_on], node[~goes_on], np.zeros(int((~goes_on).sum()), dtype=bool)))
            word, node, surplus, deficit = word[goes_on], node[goes_on], surplus[goes_on], deficit[goes_on]
            if d == vectors.shape[1] or not len(word):
                break
            count = vectors[word, d]
            less, more = (surplus > 0) & (count > 0), deficit > 0
            node = np.concatenate([below(node, count), below(node[less], count[less] - 1), below(node[more], count[more] + 1)])
            surplus, deficit, word = (
                np.concatenate([surplus, surplus[less] - 1, surplus[more]]),
                np.concatenate([deficit, deficit[less], deficit[more] - 1]),
                np.concatenate([word, word[less], word[more]]),
            )
        if len(word):
            # Leaves of the trunk: what is left of the budget must be spent together.
            even = (surplus == 0) & (deficit == 0) if shorter else surplus == deficit
            out.append((word[even], node[even], np.ones(int(even.sum()), dtype=bool)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


STORED, SAME, LONGER = 0, 1, 2


def keyed(bucket: int, kind: int, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, seed=(bucket + kind) & 0xFFFFFFFFFFFFFFFF)


def shortened(word: bytes) -> list[bytes]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


def placements(words: Words, trunk: Trunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, bucket and role of every row that is sent to a bucket."""
    vectors = words.vectors()
    home, crowded = trunk.homes(vectors)
    found = [(np.flatnonzero(~crowded), home[~crowded], STORED)]
    extra: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(crowded).tolist():
        # Words of equal length that differ in letter k are equal without it; a word that lacks a letter is what is left.
        word, bucket = words.bytes(i), int(home[i])
        extra += [(i, keyed(bucket, 1 + k, rest), STORED) for k, rest in enumerate(shortened(word))]
        extra.append((i, keyed(bucket, 0, word), STORED))
    for shorter, role in ((0, SAME), (1, LONGER)):
        word, bucket, full = trunk.visits(vectors, shorter)
        found.append((word[~full], bucket[~full], role))
        for i, b in zip(word[full].tolist(), bucket[full].tolist(), strict=True):
            rests = shortened(words.bytes(i))
            if shorter:
                extra += [(i, keyed(b, 0, rest), role) for rest in set(rests)]
            else:
                extra += [(i, keyed(b, 1 + k, rest), role) for k, rest in enumerate(rests)]
    who = [w for w, _, _ in found] + [np.array([e[0] for e in extra], dtype=np.int64)]
    where = [b for _, b, _ in found] + [np.array([e[1] for e in extra], dtype=np.uint64)]
    role = [np.full(len(w), r) for w, _, r in found] + [np.array([e[2] for e in extra], dtype=np.int64)]
    return np.concatenate(who), np.concatenate(where), np.concatenate(role)


class Trie:
    """Words of one length sorted by their vectors. Nodes of a depth are numbered in order; each knows its parent and number."""

    def __init__(self, words: Words, which: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort(vectors.T[::-1])
        self.which, sorted_ = which[order], vectors[order]
        n, depth = sorted_.shape
        self.length = int(sorted_[0, 0])
        self.letters = words.rows(self.which, self.length)
        self.width = int(sorted_[:, 1:].max()) + 3
        new = np.zeros(n, dtype=bool)
        new[0] = True
        self.first, self.keys, self.values = [], [], []
        parent = np.zeros(n, dtype=np.int64)
        for d in range(1, depth):
            new = new.copy()
            new[1:] |= sorted_[1:, d] != sorted_[:-1, d]
            starts = np.flatnonzero(new)
            value = sorted_[starts, d]
            self.first.append(starts)
            self.values.append(value)
            self.keys.append(parent[starts] * self.width + value + 1)
            parent = np.cumsum(new) - 1
        self.ends = np.r_[self.first[-1][1:], n]
        # Children of node i of a depth: from child[i] up to child[i + 1] of the next.
        self.child = [np.array([0, len(self.first[0])])]
        for above, under in zip(self.first[:-1], self.first[1:], strict=True):
            self.child.append(np.r_[np.searchsorted(under, above), len(under)])

    def find(self, d: int, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the searches for a child of ``node`` with ``value`` find one, and the child."""
        wanted = node * self.width + value + 1
        at = np.minimum(np.searchsorted(self.keys[d], wanted), len(self.keys[d]) - 1)
        hit = (self.keys[d][at] == wanted) & (value >= 0) & (value < self.width - 1)
        return np.flatnonzero(hit), at[hit]


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: the number of the range, and the value, of every value in them."""
    size = last - first
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def leaf_pairs(visitors: Trie, stored: Trie):
    """Blocks of pairs of leaves that the budget connects, by walking both tries together, depth first."""
    zero = np.zeros(1, dtype=np.int64)
    longer = visitors.length - stored.length
    stack = [(0, zero, zero, zero + 1, zero + 1 - longer)]
    depth = len(stored.keys)
    while stack:
        d, v, s, surplus, deficit = stack.pop()
        if d == depth:
            yield v, s
            continue
        if len(v) > BLOCK:
            half = len(v) // 2
            stack += [(d, v[half:], s[half:], surplus[half:], deficit[half:]), (d, v[:half], s[:half], surplus[:half], deficit[:half])]
            continue
        pair, child = spread(visitors.child[d][v], visitors.child[d][v + 1])
        value, s, surplus, deficit = visitors.values[d][child], s[pair], surplus[pair], deficit[pair]
        parts = []
        for step in (0, 1, -1):
            may = np.flatnonzero(surplus > 0 if step == 1 else deficit > 0) if step else np.arange(len(s))
            hit, at = stored.find(d, s[may], value[may] - step)
            hit = may[hit]
            parts.append((child[hit], at, surplus[hit] - (step == 1), deficit[hit] - (step == -1)))
        v, s, surplus, deficit = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(v):
            stack.append((d + 1, v, s, surplus, deficit))


def near_pairs(visitors: Trie, stored: Trie):
    """Blocks of pairs (numbers of words) that exactly one letter parts."""
    m, longer = stored.length, visitors.length - stored.length
    limit = max(1, COMPARED // visitors.length)
    for v, s in leaf_pairs(visitors, stored):
        pair, left = spread(visitors.first[-1][v], visitors.ends[v])
        leaf = s[pair]
        blocks = np.cumsum(stored.ends[leaf] - stored.first[-1][leaf]) // limit
        for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(blocks)) + 1):
            again, y = spread(stored.first[-1][leaf[part]], stored.ends[leaf[part]])
            x = left[part][again]
            one, other = visitors.letters[x], stored.letters[y]
            unlike = one[:, :m] != other
            if longer:
                # Up to the first difference as they are, from there on moved by one.
                near = ~(np.logical_or.accumulate(unlike, axis=1) & (one[:, 1:] != other)).any(axis=1)
            else:
                near = unlike.sum(axis=1) == 1
            if near.any():
                yield visitors.which[x[near]], stored.which[y[near]]


def by_length(words: Words) -> dict[int, Trie]:
    vectors = words.vectors()
    return {int(k): Trie(words, which := np.flatnonzero(words.sizes == k), vectors[which]) for k in np.unique(words.sizes)}


class Search:
    """One bucket: its words come first, then its visitors in batches."""

    def __init__(self) -> None:
        self.stored: list[tuple[pa.Array, pa.Array]] = []
        self.tries: dict[int, Trie] | None = None

    def add(self, words: pa.Array, counts: pa.Array) -> None:
        self.stored.append((words, counts))

    def meet(self, words: pa.Array, counts: pa.Array, role: int):
        """``word, other, other_n`` of every near pair, for both words where only one of them searches."""
        if not self.stored:
            return
        if self.tries is None:
            self.names = pa.concat_arrays([w for w, _ in self.stored])
            self.counts = pa.concat_arrays([n for _, n in self.stored])
            self.tries = by_length(Words.of(raw_texts(self.names)))
        for length, visitors in by_length(Words.of(raw_texts(words))).items():
            stored = self.tries.get(length - (role == LONGER))
            if stored is None:
                continue
            for x, y in near_pairs(visitors, stored):
                x, y = pa.array(x), pa.array(y)
                yield words.take(x), self.names.take(y), self.counts.take(y)
                if role == LONGER:
                    yield self.names.take(y), words.take(x), counts.take(x)


def searched(batches):
    """Near pairs of rows ``bucket, part, role, word, n`` that are sorted by the first three."""
    at, search = None, Search()
    names = ["word", "other", "other_n"]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        for a, b in zip(np.r_[0, changes].tolist(), np.r_[changes, batch.num_rows].tolist(), strict=True):
            here = (keys[0][a], keys[1][a])
            if here != at:
                at, search = here, Search()
            words, counts = batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a)
            if keys[2][a] == STORED:
                search.add(words, counts)
                continue
            for columns in search.meet(words, counts, int(keys[2][a])):
                for i in range(0, len(columns[0]), BATCH_ROWS * 10):
                    yield pa.RecordBatch.from_arrays([c.slice(i, BATCH_ROWS * 10) for c in columns], names=names)


def per_batch(function, names: list[str]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(function(batch), names=names)

    return run


def tallied(nodes: np.ndarray) -> list[pa.Array]:
    found, times = np.unique(nodes, return_counts=True)
    return [pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))]


def frequent(tally: DataFrame, above: int) -> dict[int, int]:
    """Keys whose tally is more than ``above``: fewer than the sum of all tallies divided by ``above``."""
    found = tally.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > above)
    return {r["node"]: r["n"] for r in found.collect()}


def near_words(words: DataFrame) -> DataFrame:
    """``word, other, other_n`` for every two words of ``words`` (columns ``word``, ``n``, no word twice, no nulls) that exactly one
    inserted, deleted or replaced letter parts, in both directions. Letters are those below U+0100.

    The driver learns the large nodes of the trie and the buckets with many visitors, at most ``NODES`` per level of the trie
    and ``NODES`` buckets. A word is sent to as many buckets as its budget reaches in the trunk, whatever the other words are.
    """
    spark = words.sparkSession
    total = words.count()
    node_words = max(NODE_WORDS, -(-total // NODES))
    rows = words.select("word", "n")

    nodes = rows.select("word").mapInArrow(per_batch(lambda b: tallied(paths(Words.of(raw_texts(b.column(0))).vectors()).ravel()), ["node", "n"]), "node long, n long")
    trunk = Trunk(np.array(list(frequent(nodes, node_words)), dtype=np.int64).view(np.uint64))

    def place(batch: pa.RecordBatch):
        return placements(Words.of(raw_texts(batch.column(0))), trunk)

    def visited(batch: pa.RecordBatch) -> list[pa.Array]:
        _, bucket, role = place(batch)
        return tallied(bucket[role != STORED])

    visits = rows.select("word").mapInArrow(per_batch(visited, ["node", "n"]), "node long, n long")
    visits = materialise(visits.groupBy("node").agg(F.sum("n").alias("n")), "visits")
    all_visits = visits.agg(F.sum("n")).first()[0] or 0
    share = max(BUCKET_VISITORS, -(-all_visits // NODES))
    busy = frequent(visits, share)
    busy_keys = np.array(sorted(busy), dtype=np.int64)
    busy_parts = np.array([-(-busy[k] // share) for k in busy_keys.tolist()], dtype=np.int64)

    def send(batch: pa.RecordBatch) -> list[pa.Array]:
        who, bucket, role = place(batch)
        bucket = bucket.view(np.int64)
        parts = np.ones(len(bucket), dtype=np.int64)
        if len(busy_keys):
            at = np.minimum(np.searchsorted(busy_keys, bucket), len(busy_keys) - 1)
            parts = np.where(busy_keys[at] == bucket, busy_parts[at], 1)
        # Words of a busy bucket go to all its parts, a visitor to one.
        mixed = (scrambled(bucket.view(np.uint64) + (who + 1).astype(np.uint64)) >> np.uint64(11)).astype(np.int64)
        first = np.where(role == STORED, 0, mixed % parts)
        last = np.where(role == STORED, parts, first + 1)
        row, part = spread(first, last)
        taken = pa.array(who[row])
        return [pa.array(bucket[row]), pa.array(part, pa.int32()), pa.array(role[row], pa.int32()), batch.column(0).take(taken), batch.column(1).take(taken)]

    sent = rows.mapInArrow(per_batch(send, ["bucket", "part", "role", "word", "n"]), "bucket long, part int, role int, word string, n long")
    ordered = sent.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "role", "word")
    return ordered.mapInArrow(searched, "word string, other string, other_n long")


def followed(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: the last of the chain of forms. Chains end, since counts at least double. In every
    round a word comes to point to where its target points, so a chain takes the logarithm of its length in rounds."""
    chains = materialise(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        ahead = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialise(chains.join(ahead, "root", "left").select("word", "root", "next"), "chains")
        chains = stepped.select("word", F.coalesce("next", "root").alias("root"))
        if stepped.where("next is not null").isEmpty():
            return chains


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``word_counts``. ``form`` is the near word with the largest count
    (of equal ones the first in code-point order) if that is at least twice the word's; else null. ``root`` follows forms to the
    last one. Words without near words have ``n_near`` 0 and are their own root. Repeated documents count as often as they are
    there; empty tables give no rows; columns besides the two are not read.
    """
    words = materialise(word_counts(docs, id_col, text_col), "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best")
    )
    is_form = -F.col("best.less") >= 2 * F.col("n")
    found = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    found = materialise(found, "forms")
    roots = followed(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
