import hashlib
import random

import helpers
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

A, B, C, D = "a b c d e f g h", "one two three four five six seven", "the item of the benchmark is a row of twelve plain words here", "nothing else is like this text at all"
BENCHMARK = [(1, C), (2, "short item")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], helpers.SCHEMA).repartition(3)


def texts(found):
    assert found.columns == list(corpus_pipeline.COLUMNS)
    return sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("written, bound", [(False, 0), (True, 1_000_000)])
def test_rows_go_by_themselves(spark, folder, monkeypatch, written, bound):
    """Null ids are judged like others, and a repeated id does not take a row along."""
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", bound)

    def kept(stage, rows):
        docs = table(spark, rows)
        if written:
            docs.write.mode("overwrite").parquet(f"{folder}/rows.parquet")
            docs = spark.read.parquet(f"{folder}/rows.parquet")
        return texts(stage(spark, docs, folder))

    def want(rows):
        return sorted(rows, key=repr)

    assert kept(corpus_pipeline.language, [(1, A), (1, "12 34"), (None, "..."), (None, B), (3, None)]) == want([(1, A), (None, B)])
    copies = [(i, A) for i in range(5, 30)] + [(None, A), (None, A), (7, A), (7, B), (None, D), (None, D), (8, "!!")]
    assert kept(corpus_pipeline.near_duplicates, copies) == want([(5, A), (7, B), (None, D), (8, "!!")])
    assert kept(corpus_pipeline.benchmark_passages, [(None, f"x {C} y"), (None, A), (4, C), (4, B), (5, D)]) == want([(None, A), (4, B), (5, D)])


def test_row_numbers(spark, folder):
    docs = table(spark, [(None, A)] * 40 + [(1, B)] * 40)
    docs.write.parquet(f"{folder}/rows.parquet")
    read = spark.read.parquet(f"{folder}/rows.parquet")
    for rows in (corpus_pipeline.numbered(docs), corpus_pipeline.numbered(read), corpus_pipeline.numbered(read.where("true").union(read))):
        first = [r.row for r in rows.orderBy("row").collect()]
        assert len(set(first)) == rows.count() and first == [r.row for r in rows.repartition(5).select("row").orderBy("row").collect()]


def test_language_judges_by_its_scores(spark, folder):
    rng = random.Random(8)
    sounds = {"en": ["the", "and", "with", "house", "street", "window", "thing"], "de": ["und", "nicht", "schule", "zwischen", "straße", "über", "auch"]}
    texts = [(lang, " ".join(rng.choice(sounds[lang]) for _ in range(60))) for _ in range(120) for lang in sounds]
    clean = [(None, t) for _, t in texts[:20]]
    junk = [(None, "".join(rng.choice("jqxzvkpwy") + rng.choice(["", " "]) for _ in range(280))) for _ in range(20)]
    short = [(None, "Ok")]
    rows = [(i, t, lang, "s", 1) for i, (lang, t) in enumerate(texts + clean + junk + short + [("en", "jqxz " * 60), ("en", "12"), (None, "")])]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(rows, helpers.SCHEMA).repartition(3), folder)
    gone = {t for _, t in junk} | {"12", ""}
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows if r[1] not in gone]


def test_nothing_to_learn_from(spark, folder):
    rows = [(1, A, None, "s", 1), (2, "12 34", None, "s", 1), (3, None, None, "s", 1), (None, "漢字", None, "s", 1)]
    assert texts(corpus_pipeline.language(spark, spark.createDataFrame(rows, helpers.SCHEMA), folder)) == [(1, A), (None, "漢字")]


def test_run_against_plain_python(spark, folder):
    """All four stages on nulls, repeated ids, copies and planted passages."""
    plain = helpers.corpus(spark, [30, 40, 50, 60, 70, 80], seed=3)
    rows = [(i, t) for i, t in enumerate(plain)] + [(None, plain[0]), (40, plain[1].upper()), (2, plain[2]), (None, plain[3] + " more")]
    rows += [(2, A), (None, B), (None, None), (7, "12 !!"), (None, "..."), (8, f"{plain[4]} {C}"), (None, f"x {C.upper()}"), (4, D), (None, "a short item here")]
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    sets = [helpers.shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for (i, t), g in sorted(zip(rows, group), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        best.setdefault(g, (i, t))
    items = [helpers.words(t) for _, t in BENCHMARK]
    windows = {" ".join(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9))}
    kept = [(i, t) for i, t in best.values() if not any(f" {w} " in f" {' '.join(helpers.words(t))} " for w in windows)]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = [(i, library.encode(t, add_special_tokens=False).ids, hashlib.sha256(t.encode()).hexdigest()) for i, t in kept]
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r.doc_id, r.ids, r.decoded_sha256) for r in found), key=repr) == sorted(want, key=repr)
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in found)
