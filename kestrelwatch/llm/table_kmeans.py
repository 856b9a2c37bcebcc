"""Centroid clustering of integer vectors with tables in place of arithmetic.

A component takes few integer values, so the squared difference of every value that occurs in a dimension to every centroid
is worked out once a round. The distances of a vector are then gathers from these tables and sums: one row of ``k`` numbers
per component. A task works the tables out for the values that it meets and extends them when new ones turn up.

All of it is exact integer arithmetic, and the order of rows decides nothing: sums are sums of integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelwatch.session import materialise

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
#: Components reach this at most, so that a squared distance over 64 components fits into 63 bits.
LARGEST = 1 << 27
#: Rows that are gathered at once, and values of a dimension that a task's tables hold before they are begun anew.
BLOCK = 4096
REMEMBERED = 1 << 16


class Tables:
    """For each dimension the values met so far, sorted, and their squared differences to all centroids."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.values = [np.empty(0, dtype=np.int64)] * centroids.shape[1]
        self.squares = [np.empty((0, len(centroids)), dtype=np.int64)] * centroids.shape[1]

    def places(self, d: int, column: np.ndarray) -> np.ndarray:
        """Where the values stand in the table of dimension ``d``, which afterwards has all of them."""
        known = self.values[d]
        at = np.searchsorted(known, column)
        if len(known):
            new = known[np.minimum(at, len(known) - 1)] != column
            if not new.any():
                return at
            column_new = column[new]
        else:
            column_new = column
        fresh = np.unique(column_new)
        known = np.union1d(known, fresh) if len(known) + len(fresh) <= REMEMBERED else np.unique(column)
        self.values[d] = known
        self.squares[d] = (known[:, None] - self.centroids[None, :, d]) ** 2
        return np.searchsorted(known, column)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        total = np.zeros((len(vectors), len(self.centroids)), dtype=np.int64)
        for d in range(vectors.shape[1]):
            at = self.places(d, vectors[:, d])
            total += self.squares[d][at]
        return total

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller of equals) and the squared distance to it."""
        numbers, squared = np.empty(len(vectors), dtype=np.int64), np.empty(len(vectors), dtype=np.int64)
        for a in range(0, len(vectors), BLOCK):
            found = self.distances(vectors[a : a + BLOCK])
            numbers[a : a + BLOCK] = found.argmin(axis=1)
            squared[a : a + BLOCK] = found.min(axis=1)
        return numbers, squared


def integers(column: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and ``floor(scale * x)`` of their components."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = sizes == dimensions
    flat = column.filter(pa.array(fits)).flatten()
    found = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    with np.errstate(over="ignore", invalid="ignore"):
        found = np.floor(found * scale)
        good = (np.abs(found) <= LARGEST).all(axis=1)
    fits[fits] = good
    return fits, found[good].astype(np.int64)


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the vectors that take part, as integers."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))

    def run(batches):
        for batch in batches:
            fits, found = integers(batch.column(1), dimensions, scale)
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * dimensions)
            lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fits)), lists], names=["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v array<int>")


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:vec_id``, in that order; null ids last, equal ids by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(order.alias("order"), "v").orderBy(F.col("order").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in found], dtype=np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. Every task adds up its own vectors; what is shuffled is one row of sums per task and
    centroid, and one row per centroid comes back to the driver."""
    k, dimensions = centroids.shape

    def run(batches):
        tables = Tables(centroids)
        count, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
        for batch in batches:
            found = matrix(batch.column(0), dimensions)
            numbers, _ = tables.nearest(found)
            count += np.bincount(numbers, minlength=k)
            for c in np.unique(numbers):
                sums[c] += found[numbers == c].sum(axis=0)
        met = np.flatnonzero(count)
        columns = [pa.array(met, pa.int32()), pa.array(count[met]), *(pa.array(sums[met, d]) for d in range(dimensions))]
        yield pa.RecordBatch.from_arrays(columns, names=["c", "n", *(f"s{d}" for d in range(dimensions))])

    names = [f"s{d}" for d in range(dimensions)]
    partial = rows.select("v").mapInArrow(run, ", ".join(["c int", "n long", *(f"{s} long" for s in names)]))
    out = centroids.copy()
    for row in partial.groupBy("c").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names)).collect():
        out[row["c"]] = [row[s] // row["n"] for s in names]
    return out


def cluster(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid`` for every vector that takes part:
    those with ``dimensions`` components, none null or non-finite. Components become ``floor(scale * x)``; vectors with one
    beyond ``LARGEST`` take no part either, since their distances do not fit into a long.

    Equal distances go to the smaller number. A centroid without vectors stays where it is. Repeated rows and ids each count
    as a vector; null ids take part, but begin a centroid only if there are too few others. With fewer vectors than
    ``clusters`` there are as many centroids; without any, no rows come out. Other columns are not read.

    The integers are written once, in a fraction of the size of the vectors; each round reads them in one pass without moving
    a row. The driver holds ``clusters`` rows, and the table that is broadcast has as many.
    """
    spark = vectors.sparkSession
    rows = materialise(kept(vectors, id_col, vector_col, dimensions, scale), "integers")
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(rows, centroids)

    def assign(batches):
        tables = Tables(centroids)
        for batch in batches:
            numbers, squared = tables.nearest(matrix(batch.column(1), dimensions))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32()), pa.array(squared)], names=["vec_id", "cluster", "distance"])

    assigned = materialise(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(i, n, sum(inertia.values()), digest[i], centroids[i].tolist()) for i, n in inertia.items()]
    names = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    return assigned.join(F.broadcast(spark.createDataFrame(facts, names)), "cluster").select(*(f.split()[0] for f in schema.split(", ")))
