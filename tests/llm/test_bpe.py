import hashlib
import random

import helpers
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kestrelwatch.llm import byte_bpe, queries, token_counts, token_shards, trie_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    bpe = byte_bpe.load(PATH)
    spelled = [w.decode("utf-8", "replace") for w in bpe.spelled.values()]
    out = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  c", "a" * 3000, "!" * 999 + "?" * 333, " \n\n \t x", "ab" * 2000, "\x1c\x1d\x85᠎​ 　x", "don't I'll 123४५ ½²"]
    for _ in range(1500):
        kind = rng.random()
        if kind < 0.3:
            out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(1, 60))))
        elif kind < 0.6:
            out.append("".join(rng.choice("aeinst hr'\n  ") for _ in range(rng.randrange(1, 80))))
        else:
            out.append("".join(rng.choice(spelled) for _ in range(rng.randrange(1, 12))))
    return out


def test_ids_and_counts_are_those_of_the_library(library, odd_texts):
    bpe = byte_bpe.load(PATH)
    want = [e.ids for e in library.encode_batch(odd_texts, add_special_tokens=False)]
    flat, bounds = trie_bpe.Encoder(bpe).encode(odd_texts)
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert token_counts.Counter(bpe).count(odd_texts) == [len(w) for w in want]
    spelled = trie_bpe.Speller(bpe.spelled).texts(flat, bounds)
    assert spelled == [library.decode(w, skip_special_tokens=False) for w in want]


def test_memories_may_be_forgotten(library, monkeypatch, odd_texts):
    monkeypatch.setattr(trie_bpe, "REMEMBERED", 10)
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    bpe = byte_bpe.load(PATH)
    encoder, counter = trie_bpe.Encoder(bpe), token_counts.Counter(bpe)
    for text in odd_texts[:40]:
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode([text])[0].tolist() == want
        assert counter.count([text]) == [len(want)]


def test_bytes_are_read_once_whatever_the_lengths_of_tokens(library):
    """New words that lead through known states look up no token; before, every byte tried every length that could end there."""

    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    rng = random.Random(8)
    words = ["".join(rng.choices("aeinrst", k=12)) for _ in range(6000)]
    encoder = trie_bpe.Encoder(byte_bpe.load(PATH))
    encoder.encode(words[:5000])
    encoder.token = Counted(encoder.token)
    if hasattr(encoder, "endings"):
        encoder.endings.token = encoder.token
    flat, bounds = encoder.encode(words[5000:])
    assert encoder.token.asked < 500
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.ids for e in library.encode_batch(words[5000:], add_special_tokens=False)]


def test_both_patterns_cut_alike():
    import regex

    rng, plain = random.Random(3), regex.compile(byte_bpe.PIECES)
    ascii_ = [chr(i) for i in range(128)]
    some = list("'srtvelmd  \n\t\x0b\x0c\x1c\x1f aZ09_!")
    for alphabet in (ascii_, some, [*some, *"éß½４　᠎​\x85 中"]):
        for _ in range(5000):
            text = "".join(rng.choices(alphabet, k=rng.randrange(14)))
            assert byte_bpe.pieces(text, ("<|endoftext|>",)) == plain.findall(text)


def test_pairs_may_be_forgotten(library, monkeypatch, odd_texts):
    monkeypatch.setattr(trie_bpe, "PAIRS", 10)
    flat, _ = trie_bpe.Encoder(byte_bpe.load(PATH)).encode(odd_texts[:300])
    assert flat.tolist() == [i for e in library.encode_batch(odd_texts[:300], add_special_tokens=False) for i in e.ids]


def test_every_token_is_reached():
    bpe = byte_bpe.load(PATH)
    encoder = trie_bpe.Encoder(bpe)
    plain = {i: w for i, w in bpe.spelled.items() if i not in bpe.special.values()}
    assert set(encoder.token.values()) == set(plain)


def test_queries(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op6_bpe(spark, SMALL).collect()}
    counted = {r.doc_id: r for r in queries.op4_token_counts(spark, SMALL).collect()}
    assert len(found) == len(counted) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        row = found[doc.doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        row = counted[doc.doc_id]
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((doc.text or "").encode()), len(ids), len(ids) > 1024)


def test_awkward_documents(spark, library):
    docs = helpers.awkward(spark)
    texts = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    tokens = trie_bpe.decode(trie_bpe.encode(docs, PATH), PATH)
    assert sorted((r.doc_id or -1, r.decoded) for r in tokens.collect()) == texts
    assert sorted((r.doc_id or -1, r.n_bytes) for r in token_counts.token_counts(docs, PATH).collect()) == sorted((i, len(t.encode())) for i, t in texts)
    assert trie_bpe.encode(helpers.empty(spark), PATH).collect() == [] == token_counts.token_counts(helpers.empty(spark), PATH).collect()


def test_decoding_of_ids_that_are_none(spark):
    rows = spark.createDataFrame([([257, -5, 99_999_999, None, 50256],), (None,), ([],), ([136],)], "ids array<int>")
    texts = [r.decoded for r in trie_bpe.decode(rows, PATH).collect()]
    assert texts[0].endswith("<|endoftext|>") and texts[1:3] == [None, ""] and texts[3] == "�"


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.load(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation_is_a_bijection(size):
    slots = token_shards.Permutation(size, 9).slots(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    if size > 100:
        assert slots.tolist() != token_shards.Permutation(size, 10).slots(np.arange(size)).tolist()


def stored(found):
    """The documents' ids as the shards' sequences hold them: the stream of each task, cut at the end tokens' places."""
    out = []
    for _, rows in found.orderBy("part", "number").toPandas().groupby("part"):
        stream = np.concatenate([np.frombuffer(i, "<u2")[:n] for i, n in zip(rows.ids, rows.n)])
        length = len(rows.ids.iloc[0]) // 2
        begun = [(d["doc_id"], k * length + d["at"]) for k, row in enumerate(rows.docs) for d in row]
        out += [(doc, stream[at : nxt - 1].tolist()) for (doc, at), nxt in zip(begun, [at for _, at in begun[1:]] + [len(stream)])]
    return out


@pytest.mark.parametrize("docs", ["table", "awkward"])
def test_shards_hold_every_sequence_in_its_slot(spark, tmp_path, docs):
    import tiktoken

    path = public_tokenizers.path(queries.RANKS)
    docs = helpers.awkward(spark) if docs == "awkward" else spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    found = token_shards.materialise_order(docs, path, str(tmp_path / "s"), 5, 64, 50)
    rows = token_shards.read_shards(spark, str(tmp_path / "s"), length=64).orderBy("slot").collect()
    ordered = found.orderBy("part", "number").collect()
    assert [r.slot for r in rows] == list(range(len(ordered)))
    slots = token_shards.Permutation(len(ordered), 5).slots(np.arange(len(ordered)))
    assert all(rows[slot].ids == row.ids and rows[slot].n_tokens == row.n for slot, row in zip(slots, ordered))
    encoding = tiktoken.Encoding("t", pat_str=byte_bpe.PIECES, mergeable_ranks=token_shards.ranks(path), special_tokens={})
    want = [(r.doc_id, encoding.encode_ordinary(r.text or "")) for r in docs.collect()]
    assert sorted(stored(found), key=repr) == sorted(want, key=repr)
    later = token_shards.read_shards(spark, str(tmp_path / "s"), first_slot=len(rows) - 7, length=64).collect()
    assert sorted(r.slot for r in later) == list(range(len(rows) - 7, len(rows)))


def test_damage_is_noticed_and_nothing_gives_nothing(spark, tmp_path):
    path = public_tokenizers.path(queries.RANKS)
    assert token_shards.materialise_order(helpers.empty(spark), path, str(tmp_path / "e"), 5).count() == 0
    assert token_shards.read_shards(spark, str(tmp_path / "e")).count() == 0
    token_shards.materialise_order(helpers.awkward(spark), path, str(tmp_path / "s"), 5, 64, 50)
    shard = tmp_path / "s" / "shard-00000000.bin"
    raw = bytearray(shard.read_bytes())
    raw[20] ^= 1
    shard.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        token_shards.read_shards(spark, str(tmp_path / "s"), length=64).collect()
