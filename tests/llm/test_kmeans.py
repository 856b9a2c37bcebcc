import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kestrelwatch.llm import queries, table_kmeans

SMALL = "/root/testdata/sf0.001"


def brute(rows, k=16, rounds=3, dimensions=64):
    """Rows of (vec_id, components); the answer in plain integers."""
    kept = []
    for i, x in rows:
        if x is None or len(x) != dimensions or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(64 * float(c)) for c in x]
        if max(map(abs, v)) <= table_kmeans.LARGEST:
            kept.append((i, v))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for c, vs in members.items():
            centroids[c] = [sum(column) // len(vs) for column in zip(*vs)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, q, c in found:
        inertia[c] += q
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, q, inertia[c], sum(inertia.values()), digest[c]) for i, q, c in found), key=repr)


def answer(frame):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def awkward(rng, n):
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) + i % 5 for _ in range(64)]) for i in range(n)]
    rows += [rows[3]] * 4 + [(3, rows[5][1]), (None, rows[6][1]), (None, rows[7][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [math.nan] + [0.0] * 63)]
    return rows + [(906, [math.inf] + [0.0] * 63), (907, [-math.inf] * 64), (908, [0.0] * 64), (909, [1e300] + [0.0] * 63), (910, [-2.0**21] + [0.0] * 63)]


@pytest.mark.parametrize("n", [3, 20, 150])
def test_against_plain_integers(spark, n, monkeypatch):
    monkeypatch.setattr(table_kmeans, "BLOCK", 32)
    rows = awkward(random.Random(n), n if n > 7 else 8)
    frame = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<double>, cluster string, v double").repartition(5)
    assert answer(table_kmeans.cluster(frame)) == brute(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-1.0] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert answer(table_kmeans.cluster(frame)) == brute(rows)
    assert table_kmeans.cluster(frame.where("false")).collect() == []
    assert table_kmeans.cluster(frame, dimensions=5).collect() == []


def test_query_against_plain_integers(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert answer(queries.op12_clusters(spark, SMALL)) == brute(rows)


@pytest.mark.parametrize("remembered", [1 << 16, 7])
def test_tables_give_squared_distances(monkeypatch, remembered):
    monkeypatch.setattr(table_kmeans, "REMEMBERED", remembered)
    rng = np.random.default_rng(2)
    centroids = rng.integers(-40, 40, (6, 9))
    tables = table_kmeans.Tables(centroids)
    for _ in range(5):
        v = rng.integers(-60, 60, (30, 9))
        assert np.array_equal(tables.distances(v), ((v[:, None] - centroids) ** 2).sum(axis=2))


def test_integers_are_floors():
    column = pa.array([[0.0, -0.001], [1 / 64, 0.999], None, [1.0], [None, 2.0]], pa.list_(pa.float32()))
    fits, found = table_kmeans.integers(column, 2, 64)
    assert fits.tolist() == [True, True, False, False, False] and found.tolist() == [[0, -1], [1, 63]]
