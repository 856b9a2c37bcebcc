import random

import helpers
import numpy as np
import pytest

from kestrelwatch.llm import chosen_path
from kestrelwatch.llm.components import components


def brute(docs, threshold=0.8):
    """``(doc_id, first_id, n_links, same_id, n_shingles)`` for unique ids."""
    sets = [(i, frozenset(helpers.shingles(t))) for i, t in docs]
    links = {i: set() for i, _ in sets}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and len(a & b) / len(a | b) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, a in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        same = min([j for j, b in sets if b == a and a] or [i])
        out.append((i, min(seen), len(links[i]), same, len(a)))
    return sorted(out)


def rows(found):
    """Also asserts that a class has one key and a key stands for one class."""
    found = found.collect()
    keys = {(r.class_id, r.first_id) for r in found}
    assert None not in {r.class_id for r in found} and len(keys) == len({k for k, _ in keys}) == len({i for _, i in keys})
    return sorted((r.doc_id, r.first_id, r.n_links, r.same_id, r.n_shingles) for r in found)


def near_copies(texts, rng, vocabulary=("zz", "yy", "xx")):
    out = []
    for text in texts:
        w = text.split()
        for share in (0.0, 0.01, 0.02, 0.04, 0.08):
            out.append(" ".join(rng.choice(vocabulary) if rng.random() < share else x for x in w))
    return out


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(4)

    class Any:
        pass

    texts = helpers.corpus(Any, [0, 1, 2, 4, 5, 6, 12, 40, 90, 300] * 4)
    passage = helpers.corpus(Any, [60], seed=9)[0]
    texts += near_copies(texts[-8:], rng) + [texts[12].upper() + "!"] * 5 + [f"{t} {passage}" for t in texts[:40]]
    hot = helpers.corpus(Any, [120], seed=10)[0]
    texts += [hot] * 40 + near_copies([hot] * 25, rng)
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("small, block, few", [(1024, 512, 300_000), (8, 16, 0)])
def test_against_brute_force(spark, monkeypatch, documents, small, block, few):
    """Also with tiny buckets and blocks, so that splitting, block pairs and joins without broadcast take part."""
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    monkeypatch.setattr(chosen_path, "BROADCAST_ROWS", few)
    found = chosen_path.similarity_join(spark.createDataFrame(documents, "doc_id long, text string").repartition(3), small=small)
    assert rows(found) == brute(documents)


def test_awkward_tables(spark):
    found = {(r.doc_id, r.n_shingles): r for r in chosen_path.similarity_join(helpers.awkward(spark)).collect()}
    assert chosen_path.similarity_join(helpers.awkward(spark)).count() == 10
    assert found[1, 5].n_links == 1 and found[1, 5].first_id == 1
    assert found[2, 0].first_id == 2 and found[2, 0].n_links == 0
    assert chosen_path.similarity_join(helpers.empty(spark)).collect() == []
    nulls = spark.createDataFrame([(None, "one two three four five six"), (7, "one two three four five six"), (8, None)], "doc_id long, text string")
    assert {(r.doc_id, r.first_id, r.n_links) for r in chosen_path.similarity_join(nulls).collect()} == {(None, 7, 1), (7, 7, 1), (8, 8, 0)}


def test_null_and_repeated_ids_do_not_make_groups_one(spark):
    one, other = "a first text of some six words", "and here are quite other words again"
    third, fourth = "this text stands alone among all others", "two rows have this text and one id is taken"
    texts = [(None, one), (1, one), (None, other), (2, other), (4, third), (4, fourth), (5, fourth), (None, None), (None, "")]
    found = chosen_path.similarity_join(spark.createDataFrame(texts, "doc_id long, text string"))
    members = {}
    for r in found.collect():
        members.setdefault(r.class_id, []).append((r.doc_id, r.first_id, r.n_links))
    want = [[(1, 1, 1), (None, 1, 1)], [(2, 2, 1), (None, 2, 1)], [(4, 4, 0)], [(4, 4, 1), (5, 4, 1)], [(None, None, 0)], [(None, None, 0)]]
    assert sorted((sorted(m, key=repr) for m in members.values()), key=repr) == sorted(want, key=repr) and None not in members


def test_runs_follow_from_the_recall():
    assert chosen_path.runs_needed(0.999, 1) == 7 and chosen_path.runs_needed(0.999, 2) > chosen_path.runs_needed(0.9, 2)


def test_sketches_agree_as_expected():
    rng = np.random.default_rng(3)
    far = []
    for _ in range(300):
        a = rng.integers(0, 2**63, 900).astype(np.uint64)
        b = np.r_[a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)]
        x, y = chosen_path.sketch(a), chosen_path.sketch(b)
        far.append(sum(int(np.bitwise_count(np.array(p ^ q, np.int64).view(np.uint64))) for p, q in zip(x, y)))
    assert max(far) <= chosen_path.most_unequal(0.8) and abs(np.mean(far) - 128 * 0.1) < 1 and abs(np.std(far) - 3.4) < 0.6


def test_components(spark):
    rng = random.Random(2)
    chain = [(f"{i:04d}", f"{i + 1:04d}") for i in range(60)]
    star = [("9000", f"8{i:03d}") for i in range(200)]
    loose = [(f"5{rng.randrange(200):03d}", f"5{rng.randrange(200):03d}") for _ in range(150)]
    edges = chain + star + loose + [("7000", "7000"), chain[3], chain[3][::-1]]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []
