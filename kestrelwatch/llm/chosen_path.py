"""Similarity join of documents by the Jaccard similarity of their word n-grams, along chosen paths.

Texts with the same set of shingles are one class, and only classes are joined. In every run each set draws shingles: a
shingle is drawn by all sets that hold it or by none of equal size, with a chance of 1/(threshold * size), so that two
similar sets draw on average one in common. Sets that drew the same shingle form a bucket. Buckets that are still large are
split again by shingles drawn for that path; small ones are compared by brute force, and so are those that the deepest
level leaves, block against block. Runs are repeated until pairs at the threshold are met with the target recall.

The brute force in a bucket compares sketches, which never judge: it hands on a spanning forest of the pairs whose sketches
do not rule them out, so a bucket of n sets gives less than n rows. Connected sets then come together once, and there all
of them are compared exactly, in blocks of bounded size. That gives the number of links of every set, again without a row
per pair, and a forest of true links, whose components are the near-duplicate groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelwatch.llm.arrow import WordHashes, hashed_words, id_and_text, map_batches, raw_texts, rolling, scrambled, slices
from kestrelwatch.llm.components import components
from kestrelwatch.session import materialise

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
SMALL = 1024
DEPTH = 2
#: No more paths than this are large: the size that counts as large grows with the number of rows where need be.
LARGE_PATHS = 1_000_000
SKETCH_BITS = 128
BLOCK = 512
BROADCAST_ROWS = 300_000


def runs_needed(recall: float, depth: int) -> int:
    """A pair at the threshold shares one drawn shingle per level on average (Poisson); the chance that its path has died out
    after ``depth`` levels follows from that of one level less."""
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(lost - 1)
    return math.ceil(math.log(1 - recall) / math.log(lost))


def shingle_sets(texts: list[bytes], size: int, known: WordHashes) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text. A text of fewer words, but not none, is one shingle."""
    _, flat, starts = hashed_words(texts, known)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield np.unique(rolling(flat[a:b], min(size, int(b - a)))) if b > a else np.zeros(0, np.uint64)


def drawn(tokens: np.ndarray, path: int, threshold: float) -> np.ndarray:
    """The children of a path that a set takes: a key for each shingle that it draws there."""
    key = scrambled(tokens ^ scrambled(np.array([path], dtype=np.uint64)))
    chance = min(1.0, 1.0 / (threshold * max(1, len(tokens))))
    return key[key <= np.uint64(int(chance * (2**64 - 1)))] if chance < 1 else key


FACTORS = scrambled(np.arange(1, SKETCH_BITS + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(tokens: np.ndarray) -> tuple[int, int]:
    """One bit of each of 128 minimum hashes. Two sets agree in a share of (1 + similarity) / 2 of the bits."""
    low = np.full(SKETCH_BITS, np.uint64(2**64 - 1))
    for i in range(0, len(tokens), 256):
        low = np.minimum(low, (tokens[i : i + 256, None] * FACTORS).min(axis=0))
    bits = np.packbits((scrambled(low) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return int(bits[0]), int(bits[1])


def most_unequal(threshold: float) -> int:
    """Bits in which similar sets may differ; five standard deviations beyond what is expected at the threshold."""
    p = (1 - threshold) / 2
    return math.ceil(SKETCH_BITS * p + 5 * math.sqrt(SKETCH_BITS * p * (1 - p)))


def classes(docs: DataFrame, size: int, threshold: float, runs: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``doc_id, text_key`` (of the text), ``same`` (of its set of shingles), ``size`` of the set, ``s1,
    s2`` its sketch and ``paths`` the children of the first level of all runs."""
    known = WordHashes()

    def run(batch: pa.RecordBatch):
        raw = raw_texts(batch.column(1))
        for a, b in slices([len(t) for t in raw]):
            rows = []
            seen: dict[bytes, tuple] = {}
            for text, tokens in zip(raw[a:b], shingle_sets(raw[a:b], size, known), strict=True):
                same = hashlib.md5(tokens.tobytes()).digest()
                if same not in seen:
                    paths = np.concatenate([drawn(tokens, r, threshold) for r in range(runs)]) if len(tokens) else tokens
                    seen[same] = (same, len(tokens), *sketch(tokens), paths.view(np.int64))
                rows.append((hashlib.md5(text).digest(), *seen[same]))
            yield [batch.column(0).slice(a, b - a), *(list(c) for c in zip(*rows, strict=True))]

    schema = "doc_id long, text_key binary, same binary, size long, s1 long, s2 long, paths array<long>"
    return map_batches(id_and_text(docs, id_col, text_col), run, schema, known)


def forest(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Joins the given pairs into the union-find ``parent`` and returns those that connected something."""
    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def pairs_by_sketch(size: np.ndarray, s1: np.ndarray, s2: np.ndarray, threshold: float, unequal: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and sketches do not rule out."""
    n = len(size)
    parent, out = np.arange(n), []
    for at in range(0, n, BLOCK):
        rows = slice(at, min(n, at + BLOCK))
        apart = np.bitwise_count(s1[rows, None] ^ s1[None]).astype(np.int16) + np.bitwise_count(s2[rows, None] ^ s2[None])
        close = (apart <= unequal) & (np.minimum(size[rows, None], size[None]) >= threshold * np.maximum(size[rows, None], size[None]) - 1e-9)
        left, right = np.nonzero(close)
        left = left + at
        # Pairs that are connected already need no look.
        new = (left < right) & (parent[left] != parent[right])
        out += forest(parent, left[new], right[new])
    return out


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 2) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each group of at least ``least`` rows, from batches that are sorted by ``keys``; a group may reach over
    several batches."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        rows = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        if held:
            rows = {name: np.concatenate([held[name], rows[name]]) for name in rows}
        n = len(rows[keys[0]])
        if not n:
            continue
        new = np.zeros(n, dtype=bool)
        for key in keys:
            new[1:] |= rows[key][1:] != rows[key][:-1]
        cuts = np.r_[0, np.flatnonzero(new)]
        full = np.flatnonzero(np.diff(cuts) >= least)
        for a, b in zip(cuts[full].tolist(), cuts[full + 1].tolist(), strict=True):
            yield {name: column[a:b] for name, column in rows.items()}
        held = {name: column[cuts[-1] :] for name, column in rows.items()}
    if held and len(held[keys[0]]) >= least:
        yield held


def in_blocks(rows: DataFrame, key: str, n: str, limit: int, by: str) -> DataFrame:
    """Every row once for each pair of blocks it belongs to: ``block1 <= block2``, and ``own`` the block of the row. Groups of at
    most ``limit`` rows are one block; larger ones have blocks of about that size, and each row meets all of them."""
    blocks = F.ceil(F.col(n) / limit).cast("int")
    own = F.pmod(F.xxhash64(by, F.lit(5)), blocks).cast("int")
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.withColumn("block1", F.least("own", "other")).withColumn("block2", F.greatest("own", "other")).drop("other")


def candidate_edges(level: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` for the members of each bucket (``path, n, node, size, s1, s2``)."""
    unequal = most_unequal(threshold)
    rows = in_blocks(level, "path", "n", SMALL, "node").repartition("path", "block1", "block2").sortWithinPartitions("path", "block1", "block2", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for group in groups_of(batches, ["path", "block1", "block2"]):
            node, s1, s2 = group["node"], group["s1"].view(np.uint64), group["s2"].view(np.uint64)
            for a, b in pairs_by_sketch(group["size"], s1, s2, threshold, unequal):
                out_a.append(node[a])
                out_b.append(node[b])
            if len(out_a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    return rows.select("path", "block1", "block2", "node", "size", "s1", "s2").mapInArrow(compare, "a binary, b binary")


def large_paths(level: DataFrame, small: int) -> DataFrame:
    """``path, n`` of the buckets of more than ``small`` sets, ``LARGE_PATHS`` at most."""
    sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small)
    found = materialise(sizes, "large-paths")
    limit = -(-(found.agg(F.sum("n")).first()[0] or 0) // LARGE_PATHS)
    return found.where(F.col("n") > limit) if limit > small else found


def members_with_sets(docs: DataFrame, members: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``members`` (with ``text_key`` and ``node``) with ``tokens``: the sorted shingles of the text, cut anew from it."""
    few = members.count() <= BROADCAST_ROWS
    wanted = members.select("text_key", "node").distinct()
    keyed = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_key", F.unhex(F.md5("text")))
    texts = keyed.join(F.broadcast(wanted) if few else wanted, "text_key").groupBy("text_key").agg(F.first("text").alias("text"), F.first("node").alias("node"))
    known = WordHashes()

    def run(batch: pa.RecordBatch):
        raw = raw_texts(batch.column(1))
        for a, b in slices([len(t) for t in raw]):
            yield batch.column(0).slice(a, b - a), [s.tobytes() for s in shingle_sets(raw[a:b], size, known)]

    return map_batches(texts.select("node", "text"), run, "node binary, tokens binary", known)


def children(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The next level: the members of buckets (``path, node, size, s1, s2``) under the children that they draw."""
    held = rows.join(sets, "node")

    def run(batch: pa.RecordBatch):
        path, tokens = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        taken = [drawn(np.frombuffer(t, np.uint64), int(np.uint64(p & 0xFFFFFFFFFFFFFFFF)) ^ 0x5851F42D4C957F2D, threshold).view(np.int64) for p, t in zip(path.tolist(), tokens, strict=True)]
        yield taken, *(batch.column(i) for i in range(2, 6))

    found = map_batches(held.select("path", "tokens", "node", "size", "s1", "s2"), run, "paths array<long>, node binary, size long, s1 long, s2 long")
    return found.select(F.explode("paths").alias("path"), "node", "size", "s1", "s2")


def split(level: DataFrame, sets_of, threshold: float, small: int) -> list[DataFrame]:
    """Edges from all buckets of ``level`` and, where they are large, of those below. ``sets_of`` gives the shingles of ``node``s."""
    edges = []
    for at in range(1, DEPTH + 1):
        large = large_paths(level, small)
        some = not large.isEmpty()
        marked = level.join(F.broadcast(large), "path", "left") if some else level.withColumn("n", F.lit(1))
        last = at == DEPTH or not some
        here = marked if last else marked.where("n is null")
        edges.append(materialise(candidate_edges(here.withColumn("n", F.coalesce("n", F.lit(1))), threshold), "candidate-edges"))
        if last:
            break
        rows = marked.where("n is not null").drop("n")
        sets = sets_of(rows.select("node").distinct())
        level = materialise(children(rows, sets, threshold), f"level-{at + 1}")
    return edges


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share. Shingles of a single set are left out, the others are counted in slabs."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.r_[0, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    often = np.bincount(column, minlength=1) if len(column) else np.zeros(1, np.int64)
    kept = np.cumsum(often > 1) - 1
    shared = often[column] > 1
    column, owner = kept[column[shared]], owner[shared]
    out = np.zeros((n, n), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        here = slice(*np.searchsorted(column, [at, at + 4096]))
        slab = np.zeros((n, 4096), np.float32)
        slab[owner[here], column[here] - at] = 1
        out += slab @ slab.T
    return out


def verified(groups: DataFrame, threshold: float) -> DataFrame:
    """All pairs of each group, exactly. Rows ``node, links`` (copies of the other texts that are similar enough, as far as one
    block pair sees them) and rows ``node, other`` (a forest of links)."""
    rows = in_blocks(groups, "grp", "n", BLOCK, "node").repartition("grp", "block1", "block2").sortWithinPartitions("grp", "block1", "block2", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["grp", "block1", "block2"]):
            node, own = group["node"], group["own"]
            sets = [np.frombuffer(t, np.uint64) for t in group["tokens"]]
            size = np.array([len(s) for s in sets], dtype=np.float64)
            common = overlaps(sets)
            # The same double-precision quotient as in a plain comparison of two sets.
            similar = common / (size[:, None] + size[None] - common) >= threshold
            np.fill_diagonal(similar, False)
            if group["block1"][0] != group["block2"][0]:
                similar &= own[:, None] != own[None]
            links = similar @ group["copies"]
            tree = forest(np.arange(len(node)), *np.nonzero(np.triu(similar)))
            some = np.flatnonzero(links)
            nodes = [*node[some], *(node[a] for a, _ in tree)]
            others = [*[None] * len(some), *(node[b] for _, b in tree)]
            counts = [*links[some].tolist(), *[0] * len(tree)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(others, pa.binary()), pa.array(counts, pa.int64())], ["node", "other", "links"])

    found = rows.select("grp", "block1", "block2", "own", "node", "copies", "tokens")
    return found.mapInArrow(compare, "node binary, other binary, links long")


def similarity_join(docs: DataFrame, words: int = WORDS, threshold: float = SIMILARITY, recall: float = RECALL, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (one text for all documents that links lead to, and for no others; never
    null), ``first_id`` (the smallest id among them), ``n_links`` (documents with a similarity of at least ``threshold``, itself
    not counted), ``same_id`` (the smallest id with the same set of shingles), ``n_shingles``.

    Words: A-Z lower-cased, ASCII letters, digits and non-ASCII characters. A text of fewer than ``words`` words is a single
    shingle. Null, empty and wordless texts have no shingles, no links and are each a class of their own. Repeated rows are
    documents of their own with the same id; null ids are no smallest ids. ``class_id`` follows from the texts, so that neither
    null nor repeated ids make two groups one. Links within a group are exact; a link between two texts that nothing else
    connects is missed with a chance of at most 1 - ``recall`` at the threshold, far less above.
    """
    runs = runs_needed(recall, DEPTH)
    every = materialise(classes(docs, words, threshold, runs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "shingle-classes")
    held = every.where("size > 0")
    # One text stands for all with the same shingles.
    nodes = materialise(
        held.groupBy(F.col("same").alias("node")).agg(
            F.count(F.lit(1)).alias("copies"), F.min("text_key").alias("text_key"), F.min("doc_id").alias("least"),
            F.first("size").alias("size"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("paths").alias("paths"),
        ),
        "nodes",
    )
    text_keys = nodes.select("node", "text_key")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return members_with_sets(docs, wanted.join(text_keys, "node"), words, id_col, text_col)

    edges = split(nodes.select(F.explode("paths").alias("path"), "node", "size", "s1", "s2"), sets_of, threshold, small)
    found = edges[0]
    for more in edges[1:]:
        found = found.union(more)
    joined = materialise(components(found), "candidate-groups").withColumnRenamed("component", "grp")
    members = joined.join(nodes.select("node", "copies", "text_key"), "node")
    sizes = joined.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    members = materialise(members.join(sizes, "grp"), "members")
    sets = members_with_sets(docs, members, words, id_col, text_col)
    true = materialise(verified(members.join(sets, "node"), threshold), "verified")
    links = true.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(true.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    located = nodes.select("node", "copies", "least").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = located.groupBy("component").agg(F.min("least").alias("first_id"))
    info = located.join(smallest, "component").join(links, "node", "left").select(
        F.col("node").alias("same"), F.lower(F.hex("component")).alias("class_id"), "first_id", F.col("least").alias("same_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    alone = F.col("size") == 0
    return every.select("doc_id", "same", "size", "row").join(info, "same", "left").select(
        "doc_id",
        F.when(alone, F.concat(F.lit("row-"), F.col("row").cast("string"))).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("first_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("same_id")).alias("same_id"),
        F.col("size").alias("n_shingles"),
    )
