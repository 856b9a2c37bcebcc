import helpers
import numpy as np
import pytest

from kestrelwatch.llm import decontaminate


def brute(docs, items, window=10):
    found = {}
    for item_id, text in items:
        w = helpers.words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            found.setdefault(tuple(w[i : i + n]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, which = helpers.words(text), set(), set()
        for window_words, ids in found.items():
            n = len(window_words)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window_words:
                    hit.update(range(i, i + n))
                    which |= ids
        out.append((doc_id, len(w), len(hit), sorted(str(i) for i in which if i is not None)))
    return sorted(out, key=repr)


def rows(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found.collect()), key=repr)


def planted(spark):
    texts = helpers.corpus(spark, [0, 1, 3, 9, 10, 11, 30, 80, 200] * 6)
    items = helpers.corpus(spark, [1, 2, 4, 5, 6, 9, 10, 11, 25, 40], seed=8)
    for k, item in enumerate(items):
        w = item.split()
        texts += [f"before {item} after", item.upper().replace(" ", ", "), " ".join(w[:-1]), " ".join(w[3:]) + " x", f"{item} {item}", " ".join(w[: len(w) // 2] + ["gap"] + w[len(w) // 2 :])]
    docs = [*enumerate(texts), (None, items[8]), (3, items[8]), (3, items[8]), (900, None)]
    bench = [*enumerate(items), (77, items[8]), (None, items[9]), (78, None), (79, "..."), (5, "a second text of item five with ten words in it")]
    return docs, bench


@pytest.mark.parametrize("bits", [24, 8])
def test_against_brute_force(spark, bits, monkeypatch):
    """With a bitmap of 256 bits nearly everything passes it, and the result is the same."""
    monkeypatch.setattr(decontaminate.bitmap, "__defaults__", (bits,))
    docs, bench = planted(spark)
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string"))
    assert rows(found) == brute(docs, bench)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.item_ids) for r in found.collect())


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    docs, bench = planted(spark)
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert rows(found) == brute(docs, bench)


def test_awkward_tables(spark):
    docs = helpers.awkward(spark)
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", "x"), (2, "12 34", "x")], "item_id long, text string, n_hit string")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert rows(decontaminate.decontaminate(docs, bench)) == want
    nothing = decontaminate.decontaminate(docs, bench.where("false"))
    assert nothing.count() == docs.count() and nothing.where("contaminated or n_hit > 0 or n_items > 0").isEmpty()
    assert decontaminate.decontaminate(helpers.empty(spark), bench).isEmpty()


def test_bitmap_holds_what_it_was_given(spark):
    values = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    held = decontaminate.bitmap(spark.createDataFrame([(int(v),) for v in values], "hash long"), 14)
    assert decontaminate.in_bitmap(values.view(np.uint64), held).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000).view(np.uint64)
    assert decontaminate.in_bitmap(others, held).mean() < 0.05
