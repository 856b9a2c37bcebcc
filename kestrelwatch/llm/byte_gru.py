"""Language identification with a bidirectional gated recurrent network over bytes, trained by backpropagation through time.

A text is read word by word (A-Z lower-cased; letters, digits and non-ASCII characters form words), both directions start
anew at every word, words beyond ``SEGMENT`` bytes at every ``SEGMENT`` bytes. Every byte position gets a probability for
each language from the two states that meet there. A document's probabilities are the mean over all positions of all its
words that have a letter. Since states do not cross words, a word's positions are labelled once per task and its sums are
looked up wherever the word stands again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kestrelwatch.llm.arrow import WORD_BYTES, id_and_text, map_batches, raw_texts, slices

HIDDEN = 16
SEGMENT = 24
STEPS = 700
BATCH = 256
DOCS_PER_LANG = 300
WORDS_PER_LANG = 20_000
REMEMBERED = 200_000
UNDETERMINED = "und"


@dataclass
class Gru:
    """``x``: input weights per byte, ``u``: recurrent weights, both for update gate, reset gate and candidate; index 0 reads
    forwards and 1 backwards. ``out``, ``bias``: from both states to the languages."""

    x: np.ndarray
    u: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: int, hidden: int, seed: int) -> Gru:
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(
            normal(2, 256, 3 * hidden, scale=0.3),
            normal(2, hidden, 3 * hidden, scale=hidden**-0.5),
            normal(2 * hidden, languages, scale=hidden**-0.5),
            np.zeros(languages, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.x, self.u, self.out, self.bias]

    def states(self, letters: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """The state after each byte, in the order of the bytes, for words of one length: (length, words, hidden)."""
        n, length = letters.shape
        hidden = self.u.shape[1]
        h = np.zeros((n, hidden), np.float32)
        out = np.empty((length, n, hidden), np.float32)
        for t in range(length) if way == 0 else range(length - 1, -1, -1):
            inner = self.x[way][letters[:, t]]
            turn = h @ self.u[way]
            gates = np.tanh((inner[:, : 2 * hidden] + turn[:, : 2 * hidden]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            update, reset = gates[:, :hidden], gates[:, hidden:]
            fresh = np.tanh(inner[:, 2 * hidden :] + reset * turn[:, 2 * hidden :])
            if keep is not None:
                keep.append((t, h, update, reset, turn[:, 2 * hidden :], fresh))
            h = fresh + update * (h - fresh)
            out[t] = h
        return out

    def labels(self, letters: np.ndarray) -> np.ndarray:
        """Probabilities at every position: (length, words, languages)."""
        return softmax(np.concatenate([self.states(letters, 0), self.states(letters, 1)], axis=2) @ self.out + self.bias)

    def gradients(self, letters: np.ndarray, lang: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss per position, and the gradients of all parts by backpropagation through time."""
        n, length = letters.shape
        hidden = self.u.shape[1]
        kept: tuple[list, list] = ([], [])
        both = np.concatenate([self.states(letters, way, kept[way]) for way in (0, 1)], axis=2)
        p = softmax(both @ self.out + self.bias)
        picked = p[:, np.arange(n), lang]
        error = p
        error[:, np.arange(n), lang] -= 1
        error /= np.float32(n * length)
        flat = error.reshape(n * length, -1)
        d_out, d_bias = both.reshape(n * length, -1).T @ flat, flat.sum(0)
        back = error @ self.out.T
        d_x, d_u = np.zeros_like(self.x), np.zeros_like(self.u)
        for way in (0, 1):
            carry = np.zeros((n, hidden), np.float32)
            for t, h, update, reset, turn, fresh in reversed(kept[way]):
                d_h = back[t][:, way * hidden : (way + 1) * hidden] + carry
                d_fresh = d_h * (1 - update) * (1 - fresh * fresh)
                d_update = d_h * (h - fresh) * update * (1 - update)
                d_reset = d_fresh * turn * reset * (1 - reset)
                d_turn = np.concatenate([d_update, d_reset, d_fresh * reset], axis=1)
                d_u[way] += h.T @ d_turn
                np.add.at(d_x[way], letters[:, t], np.concatenate([d_update, d_reset, d_fresh], axis=1))
                carry = d_h * update + d_turn @ self.u[way].T
        return float(-np.log(np.maximum(picked, 1e-30)).mean()), [d_x, d_u, d_out, d_bias]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def cut(word: bytes) -> list[bytes]:
    return [word[i : i + SEGMENT] for i in range(0, len(word), SEGMENT)]


def has_letter(word: bytes) -> bool:
    return any(c.isalpha() for c in word.decode("utf-8", "replace"))


def by_length(words: list[bytes]) -> dict[int, np.ndarray]:
    """Positions in ``words`` for each length."""
    lengths = np.array([len(w) for w in words])
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


@dataclass
class LanguageModel:
    languages: list[str]
    gru: Gru | None

    def sums(self, words: list[bytes]) -> np.ndarray:
        """For each word the probabilities summed over its positions, and in the last column the number of positions. A word
        without a letter has zeros."""
        out = np.zeros((len(words), len(self.languages) + 1))
        owner, parts = [], []
        for i, word in enumerate(words):
            if has_letter(word):
                for part in cut(word):
                    owner.append(i)
                    parts.append(part)
        owners = np.array(owner, dtype=np.int64)
        for length, which in by_length(parts).items() if parts else ():
            for some in np.array_split(which, max(1, len(which) * length // 100_000)):
                letters = np.frombuffer(b"".join(parts[i] for i in some), dtype=np.uint8).reshape(len(some), length)
                np.add.at(out[:, :-1], owners[some], self.gru.labels(letters).sum(axis=0, dtype=np.float64))
                np.add.at(out[:, -1], owners[some], length)
        return out


def fit(samples: dict[str, list[tuple[bytes, int]]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> LanguageModel:
    """Adam over batches of words of one length. ``samples``: for each language, words and how often they were seen; every
    language is drawn equally often."""
    languages = sorted(lang for lang, words in samples.items() if words)
    if not languages:
        return LanguageModel([], None)
    gru = Gru.new(len(languages), hidden, seed)
    parts, lang, weight = [], [], []
    for k, name in enumerate(languages):
        total = sum(n for _, n in samples[name])
        for word, n in sorted(samples[name]):
            for part in cut(word):
                parts.append(part)
                lang.append(k)
                weight.append(n / total)
    lang, weight = np.array(lang), np.array(weight)
    groups = list(by_length(parts).items())
    letters = {n: np.frombuffer(b"".join(parts[i] for i in which), dtype=np.uint8).reshape(len(which), n) for n, which in groups}
    # A length is drawn by the positions it covers.
    share = np.array([weight[which].sum() * n for n, which in groups])
    share /= share.sum()
    odds = {n: np.cumsum(weight[which]) / weight[which].sum() for n, which in groups}
    rng = np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in gru.parts()], [np.zeros_like(p) for p in gru.parts()]
    for step in range(1, steps + 1):
        n, which = groups[rng.choice(len(groups), p=share)]
        some = np.minimum(np.searchsorted(odds[n], rng.random(batch), side="right"), len(which) - 1)
        _, grads = gru.gradients(letters[n][some], lang[which][some])
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        rate = 0.02 * min(1.0, 3 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(gru.parts(), grads, first, second, strict=True):
            g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            p -= np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return LanguageModel(languages, gru)


def training_words(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs: int = DOCS_PER_LANG, words: int = WORDS_PER_LANG) -> dict[str, list[tuple[bytes, int]]]:
    """The bounded sample that the network learns from: of each language at most ``docs`` documents, drawn by a hash of their
    id, and of these the ``words`` most frequent words. Rows without language or text teach nothing."""
    known = labelled.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit(11)).alias("draw")
    )
    sizes = known.groupBy("lang").count()
    # A draw below the limit keeps about three times what is needed, so that the window below sees a bounded number of rows.
    limit = F.least(F.lit(1.0), F.lit(3.0 * docs) / F.col("count"))
    drawn = known.join(F.broadcast(sizes), "lang").where(F.pmod("draw", F.lit(1_000_000)) < limit * 1_000_000)
    ranked = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))).where(F.col("place") <= docs)

    def count(batch: pa.RecordBatch):
        found: dict[tuple[str, bytes], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            for word in text.translate(WORD_BYTES).split():
                found[lang, word] = found.get((lang, word), 0) + 1
        kept = [(lang, word.decode(), n) for (lang, word), n in found.items() if has_letter(word)]
        if kept:
            yield [list(c) for c in zip(*kept, strict=True)]

    counts = map_batches(ranked.select("lang", "text"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= words)
    out: dict[str, list[tuple[bytes, int]]] = {}
    for row in top.select("lang", "word", "n").toLocalIterator():
        out.setdefault(row["lang"], []).append((row["word"].encode(), row["n"]))
    return out


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; ``score`` is the pooled probability of the predicted language.

    Null texts, empty ones and those without a letter, and all texts if nothing was learned, are ``und`` with score 0. Equal
    probabilities go to the language that sorts first. Whole texts are read. Null ids and repeated rows are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: dict[str, object] = {}

    def run(batch: pa.RecordBatch):
        fitted: LanguageModel = shared.value
        raw = raw_texts(batch.column(1))
        for a, b in slices([len(t) for t in raw]):
            words = [t.translate(WORD_BYTES).split() for t in raw[a:b]]
            if not held or len(held["known"]) > REMEMBERED:
                held["known"], held["table"] = {}, np.zeros((0, len(fitted.languages) + 1))
            known, table = held["known"], held["table"]
            fresh = list(set().union(*words).difference(known))
            known.update(zip(fresh, range(len(table), len(table) + len(fresh)), strict=True))
            if fresh and fitted.languages:
                table = held["table"] = np.concatenate([table, fitted.sums(fresh)])
            lang, score = [], []
            for own in words:
                total = table[np.fromiter(map(known.__getitem__, own), np.int64, len(own))].sum(axis=0) if len(table) else None
                if total is None or total[-1] == 0:
                    lang.append(UNDETERMINED)
                    score.append(0.0)
                else:
                    best = int(total[:-1].argmax())
                    lang.append(fitted.languages[best])
                    score.append(min(1.0, float(total[best] / total[-1])))
            yield batch.column(0).slice(a, b - a), lang, score

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double", held)


def held_out(id_col: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 modulo 4. A null id is none of them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast(T.BinaryType())) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The network for the languages in ``lang_col``, from documents that are not held out."""
    return fit(training_words(docs.where(~held_out(F.col(f"`{id_col}`"))), id_col, text_col, lang_col))
