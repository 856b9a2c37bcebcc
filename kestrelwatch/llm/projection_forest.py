"""Approximate nearest neighbours with a forest of random-projection trees.

A tree splits by the direction between two random vectors of a node at the median projection, down to leaves. The forest is
fitted on a bounded sample and is a small model; every row is filed under its leaf in every tree. A query walks all trees
through one priority queue whose priority is the smallest margin on the way to a node, and collects leaves until they hold
enough rows. The rows of these leaves are then compared exactly.

How many rows are enough is measured: the true neighbours of a bounded number of queries, found by comparing these with all
rows in blocks, say after how many rows of its queue a query meets them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrelwatch.session import materialise

TREES = 8
LEAF_ROWS = 256
MAX_LEAVES = 2048
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
PROBES = 64
RECALL = 0.97
PACK_BYTES = 128 << 10
LEAF_PART = 8192
HELD_QUERIES = 50_000
PACK_TYPES = (pa.int32(), pa.int64(), pa.binary(), pa.binary())


@dataclass
class Forest:
    """Nodes of all trees in one table. ``below`` holds the two children of a node, negative numbers are leaves (-1 - leaf)."""

    normal: np.ndarray
    border: np.ndarray
    below: np.ndarray
    roots: list[int]
    leaves: int

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(vectors), root)
            while (moving := np.flatnonzero(at >= 0)).size:
                node = at[moving]
                right = np.einsum("ij,ij->i", vectors[moving], self.normal[node]) > self.border[node]
                at[moving] = self.below[node, right.astype(np.int64)]
            out[:, t] = -1 - at
        return out

    def queue(self, vector: np.ndarray, sizes: list[int], enough: float) -> Iterator[int]:
        """Leaves by falling priority, from one queue for all trees, until they hold ``enough`` rows."""
        margins = (self.normal @ vector - self.border).tolist()
        below, have = self.below, 0
        heap = [(-np.inf, root) for root in self.roots]
        heapq.heapify(heap)
        while heap and have < enough:
            priority, node = heapq.heappop(heap)
            if node < 0:
                have += sizes[-1 - node]
                yield -1 - node
                continue
            margin = margins[node]
            heapq.heappush(heap, (max(priority, margin), int(below[node, 0])))
            heapq.heappush(heap, (max(priority, -margin), int(below[node, 1])))


def fit(sample: np.ndarray, trees: int, leaf_rows: int, seed: int = 3) -> Forest:
    """Trees over the sample whose leaves hold at most ``leaf_rows`` of its rows, unless these are all equal."""
    rng = np.random.default_rng(seed)
    normal, border, below, roots, leaves = [], [], [], [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        for _ in range(5 if len(rows) > leaf_rows else 0):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            length = np.linalg.norm(a - b)
            if length == 0:
                continue
            direction = (a - b) / length
            place = sample[rows] @ direction
            middle = float(np.median(place))
            right = place > middle
            if right.any() and not right.all():
                at = len(normal)
                normal.append(direction)
                border.append(middle)
                below.append((0, 0))
                below[at] = (grow(rows[~right]), grow(rows[right]))
                return at
        leaves += 1
        return -leaves

    for _ in range(trees):
        roots.append(grow(np.arange(len(sample))))
    dim = sample.shape[1]
    return Forest(np.array(normal).reshape(-1, dim), np.array(border), np.array(below, dtype=np.int64).reshape(-1, 2), roots, leaves)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part: with an id, and a vector that is not zero, without null and non-finite
    components, and of the most frequent length (of equally frequent ones the smallest)."""
    v = F.col("v")
    kept = (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull())
        .where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    )
    length = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.where(F.size("v") == (length["n"] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def per_pack(dim: int) -> int:
    """Vectors of one pack."""
    return max(1, min(1024, PACK_BYTES // (4 * dim)))


def filed(vectors: DataFrame, forest) -> DataFrame:
    """``leaf, n, ids, vecs``: the rows of each batch, packed by leaf, once for every tree."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            leaves = forest.value.leaf(x.astype(np.float64))
            packs = []
            for t in range(leaves.shape[1]):
                order = np.argsort(leaves[:, t], kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(leaves[order, t])) + 1):
                    n = per_pack(x.shape[1])
                    packs += [(int(leaves[some[0], t]), len(some), ids[some].tobytes(), x[some].tobytes()) for some in np.split(rows, range(n, len(rows), n))]
            for at in range(0, len(packs), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*packs[at : at + 256], strict=True), PACK_TYPES, strict=True)], ["leaf", "n", "ids", "vecs"])

    return vectors.select("vec_id", "v").mapInArrow(run, "leaf int, n long, ids binary, vecs binary")


def merged(packs: DataFrame, sizes: list[int], dim: int) -> DataFrame:
    """The small packs of many tasks, put together by leaf. A leaf of very many rows is dealt to several tasks."""
    parts = [(leaf, -(-n // LEAF_PART)) for leaf, n in enumerate(sizes) if n]
    parts = packs.sparkSession.createDataFrame(parts, "leaf int, parts int")
    dealt = packs.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("ids"), "parts"))
    most = per_pack(dim)

    def run(batches):
        leaf, held, n = None, [], 0

        def pack():
            columns = ([leaf], [n], [b"".join(i for _, i, _ in held)], [b"".join(v for _, _, v in held)])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, PACK_TYPES, strict=True)], ["leaf", "n", "ids", "vecs"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (row[0] != leaf or n + row[1] > most):
                    yield pack()
                    held, n = [], 0
                leaf, n = row[0], n + row[1]
                held.append(row[1:])
        if held:
            yield pack()

    return dealt.repartition("leaf", "part").sortWithinPartitions("leaf").select("leaf", "n", "ids", "vecs").mapInArrow(run, "leaf int, n long, ids binary, vecs binary")


def best(ids: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of rows that may repeat."""
    order = np.lexsort((ids, distances))
    first = np.zeros(len(order), dtype=bool)
    first[np.unique(ids[order], return_index=True)[1]] = True
    order = order[first][:k]
    return ids[order], distances[order]


def nearest(ids: np.ndarray, x: np.ndarray, square: np.ndarray, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k ids nearest to q by distance and then id, and the distances in double precision; an id that repeats counts once, at
    its smallest distance. The expanded square picks what can be among them, with a margin for its rounding; differences decide."""
    other = ids != own
    if not other.all():
        ids, x, square = ids[other], x[other], square[other]
    if len(ids) > k:
        norm = float(q @ q)
        rough = square + norm - 2 * (x @ q)
        limit, most = np.partition(rough, k - 1)[k - 1], k
        # Rows that repeat ids take the cut further out, until k ids are within.
        while most < len(ids) and len(set(ids[rough <= limit].tolist())) < k:
            most = min(len(ids), 2 * most)
            limit = np.partition(rough, most - 1)[most - 1]
        some = rough <= limit + 1e-6 * (1 + norm + np.abs(square))
        ids, x = ids[some], x[some]
    return best(ids, np.sqrt(((x.astype(np.float64) - q) ** 2).sum(axis=1)), k)


ROW = "query_id long, vec_id long, score double"


def flushed(found: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    queries = np.repeat(np.array(list(found), dtype=np.int64), [len(i) for i, _ in found.values()])
    ids = np.concatenate([i for i, _ in found.values()]) if found else np.zeros(0, np.int64)
    far = np.concatenate([d for _, d in found.values()]) if found else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(ids, pa.int64()), pa.array(far, pa.float64())], ["query_id", "vec_id", "score"])


def compared(pairs: DataFrame, kind: str, dim: int, k: int) -> DataFrame:
    """Each pack of queries against the rows packed beside it. A task keeps the k best of a query over all it sees, for at most
    ``HELD_QUERIES`` queries at a time."""

    def run(batches):
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for ids, vecs, q_ids, q_vecs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows = np.frombuffer(ids, np.int64)
                x = np.frombuffer(vecs, kind).reshape(-1, dim).astype(np.float64)
                square = np.einsum("ij,ij->i", x, x)
                for own, q in zip(np.frombuffer(q_ids, np.int64).tolist(), np.frombuffer(q_vecs, kind).reshape(-1, dim).astype(np.float64), strict=True):
                    new = nearest(rows, x, square, own, q, k)
                    if own in found:
                        new = best(np.concatenate([found[own][0], new[0]]), np.concatenate([found[own][1], new[1]]), k)
                    found[own] = new
                if len(found) >= HELD_QUERIES:
                    yield flushed(found)
                    found = {}
        yield flushed(found)

    return pairs.select("ids", "vecs", "q_ids", "q_vecs").mapInArrow(run, ROW)


def top(found: DataFrame, k: int) -> DataFrame:
    near = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``queries`` its ``k`` nearest rows of ``vectors`` by Euclidean distance,
    a row with the query's own id left out; ties go to the smaller id. ``recall`` is what the probes must reach.

    Rows without id, with a null or zero vector, null or non-finite components or of another length than most take no part
    on either side. An id that comes several times is one neighbour, at its smallest distance, and one query. Other columns
    are not read. Equal vectors share their leaf in every tree, whose rows are packed apart, so that no group meets in one
    task; a pack has at most ``PACK_BYTES``. Recall is approximate by design: leaves that are never visited
    may hide a neighbour; up to ``leaf_rows`` rows everything is visited.
    """
    spark = vectors.sparkSession
    kept, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    # The length of the searched vectors holds for the queries too.
    shape = kept.agg(F.count(F.lit(1)).alias("rows"), F.first(F.size("v")).alias("dim")).first()
    rows, dim = shape["rows"], shape["dim"]
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.where(F.size("v") == dim)
    kind = "<f4" if dict(kept.dtypes)["v"] == "array<float>" else "<f8"
    if kind == "<f8":
        kept, asked = (x.withColumn("v", F.col("v").cast("array<double>")) for x in (kept, asked))
    draw = F.xxhash64("vec_id", F.lit(17))
    bound = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    drawn = kept.orderBy(draw, "vec_id").limit(bound).select("v").toArrow().column("v").combine_chunks()
    sample = matrix(drawn).astype(np.float64)
    leaves = min(MAX_LEAVES, -(-rows // leaf_rows))
    forest = fit(sample, trees, max(1, -(-len(sample) // leaves)))
    shared = spark.sparkContext.broadcast(forest)
    packs = materialise(filed(kept, shared), "forest-leaves")
    sizes = [0] * forest.leaves
    for row in packs.groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[row["leaf"]] = row["n"]
    packs = materialise(merged(packs, sizes, dim), "forest-packs")

    # Probes against all rows, in blocks.
    probes = asked.orderBy(draw, "vec_id").limit(PROBES).select("vec_id", "v").toArrow().combine_chunks()
    probe_ids, probe_vecs = probes.column("vec_id").to_numpy(), [np.array(v.as_py(), kind) for v in probes.column("v")]
    one_tree = packs.where(F.col("leaf") < max(1, tree_leaves(forest)))
    beside = one_tree.withColumn("q_ids", F.lit(probe_ids.astype(np.int64).tobytes())).withColumn("q_vecs", F.lit(b"".join(v.tobytes() for v in probe_vecs)))
    truth = top(compared(beside, kind, dim, k), k).select("query_id", "vec_id").collect() if len(probe_ids) else []
    wanted = {r["vec_id"] for r in truth}
    near = kept.join(F.broadcast(spark.createDataFrame([(i,) for i in wanted], "vec_id long")), "vec_id").select("vec_id", "v").toArrow() if wanted else None
    place = {}
    if near is not None and near.num_rows:
        for i, leaf in zip(near.column("vec_id").to_pylist(), forest.leaf(matrix(near.column("v").combine_chunks()).astype(np.float64)), strict=True):
            place.setdefault(i, set()).update(leaf.tolist())
    needed = []
    for own, q in zip(probe_ids.tolist(), probe_vecs, strict=True):
        have, reached = 0, {}
        for leaf in forest.queue(q.astype(np.float64), sizes, np.inf):
            reached[leaf] = have
            have += sizes[leaf]
        needed += [min(reached[leaf] for leaf in place[r["vec_id"]]) for r in truth if r["query_id"] == own and r["vec_id"] in place]
    enough = float(np.quantile(needed, recall, method="higher")) + 1 if needed else np.inf
    total = float(sum(sizes))

    def walk(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            visits: dict[int, list[int]] = {}
            for i, q in enumerate(x.astype(np.float64)):
                for leaf in shared.value.queue(q, sizes, min(enough, total)):
                    visits.setdefault(leaf, []).append(i)
            out = [(leaf, ids[some].tobytes(), x[some].tobytes()) for leaf, which in visits.items() for some in np.split(np.array(which), range(per_pack(dim), len(which), per_pack(dim)))]
            for at in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 256], strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["leaf", "q_ids", "q_vecs"])

    visits = asked.select("vec_id", "v").mapInArrow(walk, "leaf int, q_ids binary, q_vecs binary")
    return top(compared(packs.join(visits, "leaf"), kind, dim, k), k)


def tree_leaves(forest: Forest) -> int:
    """Leaves of the first tree; they are numbered first."""
    below, todo = 0, [forest.roots[0]]
    while todo:
        node = todo.pop()
        if node < 0:
            below += 1
        else:
            todo += forest.below[node].tolist()
    return below
