import hashlib
import random

import helpers
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from kestrelwatch.llm import queries, row_bpe

PATH = public_tokenizers.path(queries.RANKS)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=row_bpe.ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return row_bpe.Encoder(*row_bpe.vocabulary(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(11)
    tokens = [w.decode("utf-8", "replace") for w in row_bpe.ranks(PATH)]
    out = ["", "<|endoftext|>", "a" * 3000, "!" * 257, "!" * 999 + "?" * 333, " \n\n \t x", "ab" * 2000, "don't I'll 123४५ ½²", "漢字" * 400, "\x1c\x1d\x85᠎​ 　x"]
    for _ in range(1500):
        kind = rng.random()
        if kind < 0.3:
            out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(1, 60))))
        elif kind < 0.6:
            out.append("".join(rng.choice("aeinst hr'\n  ") for _ in range(rng.randrange(1, 80))))
        else:
            out.append("".join(rng.choice(tokens) for _ in range(rng.randrange(1, 12))))
    return out


def ids(encoder, texts):
    flat, bounds = encoder.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_ids_are_those_of_the_library(encoder, library, odd_texts):
    want = [library.encode_ordinary(t) for t in odd_texts]
    assert ids(encoder, odd_texts) == want
    flat, bounds = encoder.encode(odd_texts)
    assert row_bpe.Decoder(row_bpe.ranks(PATH)).decode(flat, bounds).to_pylist() == [t.encode() for t in odd_texts] == [library.decode_bytes(w) for w in want]


def test_memory_may_be_forgotten_and_matrices_be_small(library, odd_texts, monkeypatch):
    monkeypatch.setattr(row_bpe, "REMEMBERED", 10)
    monkeypatch.setattr(row_bpe, "CELLS", 64)
    encoder = row_bpe.Encoder(*row_bpe.vocabulary(PATH), public_tokenizers.PATTERN)
    for text in odd_texts[:60]:
        assert ids(encoder, [text]) == [library.encode_ordinary(text)]


def plain(word, ranks):
    """Leftmost pair of minimum rank, one at a time."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_rows_and_long_rows_merge_alike_for_any_ranks():
    rng = random.Random(4)
    for _ in range(30):
        tokens = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(60)}
        order = list(tokens)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        encoder = row_bpe.Encoder({t: i for t, i in ranks.items() if len(t) == 1}, row_bpe.mergeable(ranks), ".+")
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(40)]
        flat, sizes = encoder.matrix(words, 32)
        got = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
        assert got == [plain(w, ranks) for w in words] == [encoder.long_row(w).tolist() for w in words]


def test_pairs_are_found_and_others_not():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 300, (5000, 2)), axis=0)
    table = row_bpe.Pairs(np.c_[pairs, np.arange(len(pairs))])
    left, right = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(-1, 300), np.arange(-1, 300)))
    known = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    assert table(left, right).tolist() == [known.get(p, int(row_bpe.NEVER)) for p in zip(left.tolist(), right.tolist(), strict=True)]
    assert row_bpe.Pairs(np.empty((0, 3), np.int64))(left[:5], right[:5]).tolist() == [int(row_bpe.NEVER)] * 5


def test_query(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op13_byte_bpe(spark, SMALL).collect()}
    assert len(found) == len(docs)
    for doc in docs:
        want = library.encode_ordinary(doc.text or "")
        row = found[doc.doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(library.decode_bytes(want)).hexdigest() == hashlib.sha256((doc.text or "").encode()).hexdigest()


def test_awkward_documents(spark):
    docs = helpers.awkward(spark)
    texts = sorted((r.doc_id or -1, (r.text or "").encode()) for r in docs.collect())
    both = row_bpe.encode(docs, PATH, public_tokenizers.PATTERN, decoded=True)
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in both.collect()) == texts
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in row_bpe.decode(both.drop("decoded"), PATH).collect()) == texts
    assert row_bpe.encode(helpers.empty(spark), PATH, public_tokenizers.PATTERN, decoded=True).collect() == []


def test_ids_without_token_add_nothing(spark):
    rows = spark.createDataFrame([([97, -5, 99_999_999, None],), (None,), ([],)], "ids array<int>")
    got = [None if r.decoded is None else bytes(r.decoded) for r in row_bpe.decode(rows, PATH).collect()]
    token = {i: t for t, i in row_bpe.ranks(PATH).items()}
    assert got == [token[97], None, b""]


def test_files_without_single_bytes_are_refused(tmp_path):
    (tmp_path / "r").write_bytes(b"YQ== 0\n\n")
    with pytest.raises(ValueError):
        row_bpe.ranks(str(tmp_path / "r"))
