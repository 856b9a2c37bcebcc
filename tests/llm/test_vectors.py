import numpy as np
import pytest

from kestrelwatch.llm import projection_forest, queries


def brute(rows, asked, k=10):
    out = {}
    for q, v in asked:
        far = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q)
        out[q] = far[:k]
    return out


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_recall_on_vectors_without_structure(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 24)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = by_query(projection_forest.search(table, table.where("vec_id % 50 = 0"), leaf_rows=64))
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    hits = sum(len({i for _, i in found[q]} & {i for _, i in far}) for q, far in want.items())
    assert hits / (10 * len(want)) >= 0.9
    known = dict(rows)
    for q, far in found.items():
        assert far == sorted(far) and len(far) == 10
        assert all(abs(d - np.linalg.norm(np.array(known[i]) - np.array(known[q]))) < 1e-12 for d, i in far)


def test_small_tables_are_exact(spark):
    found = by_query(queries.op1_nearest(spark, "/root/testdata/sf0.001"))
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0])
    hits = sum(len({i for _, i in found[q]} & {i for _, i in far}) for q, far in want.items())
    assert found.keys() == want.keys() and hits / sum(map(len, want.values())) >= 0.9


def test_a_third_of_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.integers(0, 3, 4).astype(float).tolist()) for i in range(1200)]
    rows = [(i, v) for i, v in rows if any(v)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    found = by_query(projection_forest.search(table, table.where("vec_id % 100 = 0"), leaf_rows=32, recall=1.0))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0])
    for q in want:
        if q % 3 == 0:  # equal vectors share every leaf, so these are found whatever the effort
            assert found[q] == want[q]


def test_rows_that_take_no_part(spark):
    good = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [9.0, 9.0])]
    bad = [(5, None), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, []), (11, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame([(*r, "x") for r in good + bad], "vec_id long, embedding array<double>, score string")
    found = by_query(projection_forest.search(table, table))
    assert found == {q: far for q, far in brute([good[0], good[1], good[2], good[4]], [good[0], good[1], good[2], good[4]]).items()}
    assert projection_forest.search(table.where("false"), table).collect() == [] == projection_forest.search(table, table.where("false")).collect()


def test_repeated_rows_are_one_neighbour(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((100, 6)))]
    # Every row twice, one of them 300 times, and an id with two vectors.
    more = rows * 2 + [rows[7]] * 298 + [(8, rows[9][1])]
    table = spark.createDataFrame(more, "vec_id long, embedding array<double>").repartition(2)
    found = by_query(projection_forest.search(table, spark.createDataFrame([r for r in rows if r[0] != 8], "vec_id long, embedding array<double>"), leaf_rows=10_000))
    for q, v in rows:
        far = {i: min(float(np.linalg.norm(np.array(w) - np.array(v))) for j, w in more if j == i) for i in range(100) if i != q}
        if q != 8:
            assert [i for _, i in found[q]] == sorted(far, key=lambda i: (far[i], i))[:10]


def test_median_split_needs_two_sides():
    forest = projection_forest.fit(np.ones((50, 3)), 2, 4)
    assert forest.leaves == 2 and forest.leaf(np.ones((5, 3))).tolist() == [[0, 1]] * 5


@pytest.mark.parametrize("enough", [1, 100, np.inf])
def test_queue_meets_leaves_by_margin(enough):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 6))
    forest = projection_forest.fit(x, 3, 20)
    leaves = forest.leaf(x)
    sizes = np.bincount(leaves.ravel(), minlength=forest.leaves).tolist()
    met = list(forest.queue(x[0], sizes, enough))
    assert len(set(met)) == len(met) and set(leaves[0]) <= set(met) | (set(leaves[0]) if enough == 1 else set())
    assert sum(sizes[i] for i in met) >= min(enough, 1500)
