import math
import re
import zlib

import helpers
import numpy as np
import pytest

from kestrelwatch.llm import byte_gru, chat_snapshots, noise_lm, queries, tag_ratio

SMALL = "/root/testdata/sf0.001"


# op2


def plain_tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", helpers.lower(text)) if w] + [None]


def check_base(found, docs):
    counts = {}
    for doc_id, text in docs:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            for w in plain_tokens(text):
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (doc_id if doc_id is not None else -1, len(t), sum(counts.get(w, 0) > 0 for w in t), total, round(sum(math.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in t), 5))
        for doc_id, t in ((i, plain_tokens(t)) for i, t in docs)
    )
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found)
    assert got == want


@pytest.mark.parametrize("frequent", [200_000, 50])
def test_counts_and_base_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(noise_lm.Vocabulary.of.__func__, "__defaults__", (frequent,))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = noise_lm.score_documents(docs).collect()
    check_base(found, [(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and math.isfinite(r.score) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    frequencies = rng.random(noise_lm.CLASSES)
    model = noise_lm.LogBilinear.new(frequencies / frequencies.sum())
    one, two, norm = model.tables()
    for a, b in rng.integers(0, noise_lm.CLASSES, (20, 2)):
        assert abs(np.exp(one[a] + two[b] - norm[a, b]).sum() - 1) < 1e-9


def test_words_of_a_class_share_its_probability(spark):
    words = [(f"w{i}x", i % 7 + 1) for i in range(900)]
    counts = spark.createDataFrame(words, "word string, n long")
    v = noise_lm.Vocabulary.of(counts, 10)
    kinds = dict(zip(v.frequent, v.classes()))
    share = {}
    for word, n in words:
        k = kinds[word.encode()]
        share[k] = share.get(k, 0) + (n + 1) / v.class_totals[k]
    for k in range(1, noise_lm.CLASSES):
        rest = 1 / v.class_totals[k] if k > noise_lm.OWN_CLASSES else 0  # the words that were never counted
        if k in share:
            assert abs(share[k] + rest - 1) < 1e-9
    assert v.class_totals[noise_lm.END] == 11 and v.tokens == sum(n for _, n in words) + 10 and v.distinct == 901


def test_gradients_of_the_contrast():
    rng = np.random.default_rng(2)
    frequencies = np.full(6, 1 / 6)
    model = noise_lm.LogBilinear.new(frequencies)
    model = noise_lm.LogBilinear(*(p.astype(np.float64) for p in model.parts()))
    two, one, word, noise = rng.integers(0, 6, (4, 30))
    rest = np.log(len(noise) * frequencies)

    def loss():
        context = model.before[0][one] + model.before[1][two]
        s = lambda w: model.bias[w] + (context * model.after[w]).sum(axis=-1) - rest[w]
        out = np.log1p(np.exp(-s(word))).sum()
        for k in noise:
            out += np.log1p(np.exp(s(np.full(len(word), k)))).sum()
        return out / len(word)

    grads = model.gradients(two, one, word, noise, rest)
    for p, g in zip(model.parts(), grads):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in p.shape)
            kept, e = p[at], 1e-4
            p[at] = kept + e
            up = loss()
            p[at] = kept - e
            down = loss()
            p[at] = kept
            assert abs((up - down) / (2 * e) - g[at]) < 1e-3


@pytest.mark.parametrize("frequent", [200_000, 40])
def test_scores_are_sums_of_the_models_logarithms(spark, frequent):
    """Every token's class from a softmax over all classes, then the word's share of its class, one token at a time."""
    rng = np.random.default_rng(8)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).select("doc_id", "text").unionByName(helpers.awkward(spark).where("doc_id <> 5 or doc_id is null").select("doc_id", "text"))
    counts = noise_lm.word_counts(docs.where("doc_id % 2 = 0")).persist()
    v = noise_lm.Vocabulary.of(counts, docs.where("doc_id % 2 = 0").count(), frequent)
    model = noise_lm.LogBilinear.new(v.frequencies())
    model = model.filled(model.flat() + 0.3 * rng.standard_normal(len(model.flat())))
    table = {r["word"].encode(): r["n"] for r in counts.collect()}
    own = {w: k for k, w in enumerate(v.frequent[: noise_lm.OWN_CLASSES], 1)}

    def plain(text):
        words = (text or "").encode().translate(noise_lm.LOWER).split()
        kinds = [own.get(w) or noise_lm.shared_class(w) for w in words] + [noise_lm.END]
        shares = [table.get(w, 0) + 1 for w in words] + [v.ends + 1]
        total, before = 0.0, [noise_lm.END, noise_lm.END]
        for k, share in zip(kinds, shares):
            s = (model.before[0][before[1]] + model.before[1][before[0]]).astype(np.float64) @ model.after.T.astype(np.float64) + model.bias
            total += (s[k] - np.log(np.exp(s - s.max()).sum()) - s.max()) / math.log(10) + math.log10(share / v.class_totals[k])
            before = [before[1], k]
        return total

    want = sorted((r.doc_id if r.doc_id is not None else -1, plain(r.text)) for r in docs.collect())
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in noise_lm.score(docs, counts, v, model).collect())
    assert [i for i, _ in found] == [i for i, _ in want]
    assert all(abs(a - b) <= 1e-4 * (1 + abs(b)) for (_, a), (_, b) in zip(found, want))


def test_replicas_are_added_in_steps(spark):
    import pyarrow as pa

    rows = [(i, [float(i), 1.0, -i / 2], i + 1) for i in range(30)]
    frame = spark.createDataFrame(rows, noise_lm.REPLICA).repartition(4)
    (found,) = frame.mapInArrow(noise_lm.added, noise_lm.REPLICA).repartition(1).mapInArrow(noise_lm.added, noise_lm.REPLICA).collect()
    assert found["sums"] == [435.0, 30.0, -217.5] and found["tokens"] == 465
    assert list(noise_lm.added(iter([pa.RecordBatch.from_pylist([], schema=noise_lm.summed_row(0, np.zeros(1), 1).schema)]))) == []


def test_scores_of_awkward_tables(spark):
    docs = helpers.awkward(spark)
    check_base(noise_lm.score_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert noise_lm.score_documents(helpers.empty(spark)).collect() == []
    only_held = spark.createDataFrame([(i, "a b") for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in noise_lm.score_documents(only_held).collect())


# op3


def brute_chats(rows):
    chats = {}
    for k, (conv, turn, role, text) in enumerate(sorted(set(rows), key=repr)):
        chats.setdefault(conv if conv is not None else ("alone", k), []).append((turn is not None, turn or 0, role or "unknown", text or ""))
    chats = {c: tuple((r, t) for _, _, r, t in sorted(set(ts))) for c, ts in chats.items()}
    begun = {ts[:k] for ts in chats.values() for k in range(1, len(ts))}
    out = {}
    for c, ts in chats.items():
        if ts not in begun:
            out.setdefault(ts, []).append(c if isinstance(c, int) else math.inf)
    mark = lambda x: x.replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")
    return sorted((min(cs), len(ts), len(cs), "".join(f"<|im_start|>{mark(r)}\n{mark(t)}<|im_end|>\n" for r, t in ts)) for ts, cs in out.items())


def test_snapshots_collapse(spark):
    rows = []
    base = [("user", "hi"), ("assistant", "hello"), ("user", "what <|im_start|> is"), ("assistant", "that")]
    for conv in range(60):
        turns = base[: 1 + conv % 4] + ([("user", f"own {conv}")] if conv % 7 == 0 else [])
        rows += [(conv, k, *t) for k, t in enumerate(turns)]
    rows += [rows[0], (70, None, None, None), (70, 1, "user", "x"), (None, 0, "user", "hi"), (None, 3, "user", "lost"), (None, 3, "user", "lost")]
    rows += [(71, 5, "user", "b"), (71, 5, "user", "a"), (72, 0, "assistant", "hi"), (73, 0, "user", "")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(4)
    found = chat_snapshots.maximal_chats(table)
    got = sorted((r.conv_id if r.conv_id is not None else math.inf, r.n_turns, r.n_copies, r.chat) for r in found.collect())
    assert got == brute_chats(rows)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert chat_snapshots.maximal_chats(table.where("false")).collect() == []


# op8

SITE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div id="cookie-notice">We use cookies on this long site to do all sorts of things for you and for others.</div>{}
<div class="sidebar"><ul><li><a href=1>Other story one</a><li><a href=2>Other story two</a></ul></div>
<section id=comments><p>Great post, I like it very much and will tell all my friends about it!</p></section>
<form><label>Mail</label><input><p>Subscribe to our letter now, it comes every day</p></form><footer>&copy; 2024 All rights reserved by this company</footer></body></html>"""
BODY = """<h2>Title &amp; more</h2><p>First paragraph with a
 reasonable amount of <b>text</b> in it, really.<p>Second, with a <a href=x>link</a> in the middle of it all.<div class="ad">Buy this thing now</div><p>Short.<p>And a longer closing paragraph that says quite a few things about it."""
TEXT = "Title & more First paragraph with a reasonable amount of text in it, really. Second, with a link in the middle of it all. Short. And a longer closing paragraph that says quite a few things about it."


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<div><div><article><section>{}</section></article></div></div>"])
def test_main_text(around):
    assert tag_ratio.main_text(SITE.format(around.format(BODY))) == TEXT


def test_names_that_surround_and_names_that_do_not():
    body = "<p>" + "Some words of the article stand here, one after the other. " * 3
    page = '<body><div class="site-header">Site name and motto</div><main><h1>Title</h1><div class="content has-sidebar"><article><div class="entry-header"><h2>Inner</h2></div>'
    page += body + '</article></div><ul class="commentlist"><li>A comment that is as long as a paragraph of the article, or longer</ul><div class="mainMenu">x</div></main></body>'
    assert tag_ratio.main_text(page) == " ".join(["Title", "Inner", *["Some words of the article stand here, one after the other."] * 3])


FRAME = "<body><nav><a href=/>Home</a> <a href=/n>News</a></nav>{}<div class='related-stories'><a href=1>Other</a> <a href=2>Another</a></div><footer>All rights reserved</footer></body>"


@pytest.mark.parametrize("lengths", [[300] * 20 + [50_000] + [300] * 15, [5, 8, 6, *[400] * 10, 7, 5, 9, 4, 6, 8, 5], [9] * 8 + [900] + [9] * 8])
@pytest.mark.parametrize("paragraph", ["<p>{}</p>", "<div>{}</div>", "<ul><li>{}</ul>"])
def test_long_and_short_lines_without_landmarks(lengths, paragraph):
    texts = [f"{i} " + "word " * (n // 5) + "end." for i, n in enumerate(lengths)]
    page = FRAME.format("<div class=text>" + "".join(paragraph.format(t) for t in texts) + "</div>")
    assert tag_ratio.main_text(page) == " ".join(texts)


def test_all_regions_that_are_content():
    story = ["The first part of the story is told in these words here. " * 3, "The second part of it is told in these other words. " * 3, "What stands in no article is told in a third row of words. " * 4]
    page = FRAME.format(f"<article><p>{story[0]}</p><p>Yes.</p></article><article><p>{story[1]}</p><p>No.</p></article><div class=more><p>{story[2]}</p></div>")
    assert tag_ratio.main_text(page) == " ".join(f"{story[0]}Yes. {story[1]}No. {story[2]}".split())


@pytest.mark.parametrize("begin", ["<article class='post tag-search category-social'>", "<div class='post-with-comments-off'>", "<div id=widget>", "<section class=banner>"])
def test_names_that_do_not_silence_the_text(begin):
    text = "The story is told in these words here and in no others. " * 3
    page = FRAME.format(f"{begin}<p>{text}</p><section id=discussion><p>{text}</p></section></{begin[1:].split()[0]}>")
    assert tag_ratio.main_text(page) == " ".join((text + text).split())


def test_odd_pages(spark):
    assert tag_ratio.main_text(None) == tag_ratio.main_text("") == tag_ratio.main_text("<html><body></body></html>") == ""
    assert tag_ratio.main_text("plain text") == "plain text" and tag_ratio.main_text("<p>a &lt;b&gt; &#233;") == "a <b> é"
    assert tag_ratio.main_text("<article><p>" + "word " * 50_000 + "</article>").count("word") == 50_000
    assert tag_ratio.main_text("<article>" + "<b>" * 3000 + "deep</article>") == "deep"
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, n_chars string")
    found = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in tag_ratio.extract(pages).collect()), key=repr)
    assert found == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (0, None, "", 0), (2, "v", "", 0)], key=repr)
    assert tag_ratio.extract(pages.where("false")).collect() == []


def test_articles_of_the_given_pages(spark):
    import html

    for row in queries.op8_main_text(spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", row.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == " ".join(b for b in blocks if b) and row.n_chars == len(row.text)


# op10


def test_backpropagation_through_time():
    rng = np.random.default_rng(0)
    net = byte_gru.Gru(*(p.astype(np.float64) for p in byte_gru.Gru.new(3, 4, 1).parts()))
    letters, lang = rng.integers(97, 101, (5, 4)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.gradients(letters, lang)
    for p, g in zip(net.parts(), grads):
        for _ in range(6):
            at = [int(rng.integers(0, s)) for s in p.shape]
            if p.shape[1:2] == (256,):
                at[1] = 97 + at[1] % 4
            at = tuple(at)
            kept = p[at]
            p[at] = kept + 1e-3
            up, _ = net.gradients(letters, lang)
            p[at] = kept - 1e-3
            down, _ = net.gradients(letters, lang)
            p[at] = kept
            assert abs((up - down) / 2e-3 - g[at]) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_prediction_pools_all_positions(spark):
    samples = {"aa": [(b"abab", 3), (b"baba", 2), (b"aabb", 1)], "xx": [(b"xyxy", 3), (b"yxyx", 2), (b"xxyy", 1)]}
    model = byte_gru.fit(samples, steps=80, batch=32)
    texts = ["abab abab", "XYXY xx yy", "abab xyxyxyxyxyxyxy", None, "", "12 !!", "ab" * 40_000]
    found = {r.doc_id: r for r in byte_gru.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        parts = [w[k : k + byte_gru.SEGMENT] for w in helpers.words(text) if any(c.isalpha() for c in w) for k in range(0, len(w), byte_gru.SEGMENT)]
        if not parts:
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        p = np.concatenate([model.gru.labels(np.frombuffer(w.encode(), np.uint8)[None])[:, 0] for w in parts]).astype(np.float64).mean(axis=0)
        assert found[i].lang_pred == model.languages[int(p.argmax())] and abs(found[i].score - p.max()) < 1e-5


def test_languages_of_awkward_tables(spark):
    docs = helpers.awkward(spark)
    found = byte_gru.predict(docs, byte_gru.train(docs)).collect()
    assert len(found) == 10 and {r.doc_id for r in found if r.lang_pred == "und"} == {2, 3, 4, 6}
    nothing = byte_gru.train(helpers.empty(spark))
    assert {r.lang_pred for r in byte_gru.predict(docs, nothing).collect()} == {"und"}
    assert byte_gru.predict(helpers.empty(spark), nothing).collect() == []
