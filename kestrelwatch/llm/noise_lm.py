"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

A word is predicted in two steps, its class and then the word in its class. The most frequent words are classes of their
own, all others share a class with the words of the same ending; a word's share of its class is its count plus one, and
every shared class keeps one more for words that were never counted. The class is predicted from the classes of the two
words before by the log-bilinear model: both have a vector, their sum times the vector of the class, plus a bias.

Training contrasts every training token with classes drawn from the class frequencies. Each task trains a replica on its
own documents, and replicas are averaged by their tokens, as arrays and in three steps, so that no task adds up all of them. For
scoring the model is normalised in full: batched matrix products give the sum over all classes for every pair of classes
before. That table is what bounds the number of classes: it has one number for each pair of classes before, and so do the two
tables of scores, in every worker (see the README for figures).
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelwatch.llm.arrow import LOWER, id_and_text, map_batches, raw_texts, release, slices
from kestrelwatch.session import materialise

OWN_CLASSES = 767
SHARED_CLASSES = 256
CLASSES = 1 + OWN_CLASSES + SHARED_CLASSES
END = 0
DIM = 16
NOISE = 48
BATCH = 2048
RATE = 0.02
FREQUENT = 200_000
ENDING = 3
HELD_WORDS = 200_000
#: Sums that the last task of the averaging adds up.
LAST_SUMS = 8


def held_out(id_col: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 modulo 7. A null id is none of them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def shared_class(word: bytes) -> int:
    return 1 + OWN_CLASSES + zlib.crc32(word[-ENDING:]) % SHARED_CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over the whole texts. A task counts what it reads and hands on partial counts before they grow too many."""

    def run(batches):
        found: dict[bytes, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in raw_texts(batch.column(0)):
                for word in words_of(text):
                    found[word] = found.get(word, 0) + 1
                if len(found) > HELD_WORDS:
                    yield out()
                    found.clear()
        if found:
            yield out()
        release(found)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The frequent words (a bounded number) with their counts, most frequent first, and what all words add up to."""

    frequent: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int
    class_totals: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, docs: int, limit: int = FREQUENT) -> Vocabulary:
        # The lowest count that no more than ``limit`` words reach; a table of counts is small beside one of words.
        least, reached = 1 << 62, 0
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("words")).first()
        for row in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
            if reached + row["count"] > limit:
                break
            least, reached = row["n"], reached + row["count"]
        rows = sorted(((r["word"].encode(), r["n"]) for r in counts.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))
        ending = F.substring(F.col("word").cast("binary"), -ENDING, ENDING)
        share = 1 + OWN_CLASSES + F.crc32(F.when(F.octet_length("word") > ENDING, ending).otherwise(F.col("word").cast("binary"))) % SHARED_CLASSES
        totals = np.ones(CLASSES)
        totals[END] = docs + 1
        for row in counts.groupBy(share.alias("k")).agg(F.sum(F.col("n") + 1).alias("n")).collect():
            totals[row["k"]] += row["n"]
        for k, (word, n) in enumerate(rows[:OWN_CLASSES], 1):
            totals[k] = n + 1
            totals[shared_class(word)] -= n + 1
        return cls([w for w, _ in rows], np.array([n for _, n in rows], dtype=np.int64), total["n"] + docs, total["words"] + (docs > 0), docs, totals)

    def classes(self) -> np.ndarray:
        return np.array([k if k <= OWN_CLASSES else shared_class(w) for k, w in enumerate(self.frequent, 1)], dtype=np.int64)

    def frequencies(self) -> np.ndarray:
        return self.class_totals / self.class_totals.sum()


class Places(dict):
    """The place of a frequent word, and -1 - class of any other."""

    def __init__(self, frequent: list[bytes]) -> None:
        super().__init__(zip(frequent, range(len(frequent)), strict=True))
        self.fixed = len(frequent)

    def __missing__(self, word: bytes) -> int:
        found = -1 - shared_class(word)
        if len(self) < self.fixed + HELD_WORDS:
            self[word] = found
        return found


def class_stream(texts: list[bytes], places: Places, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[bytes]], np.ndarray]:
    """Classes of all tokens with two ends before each text and one behind, where each text's tokens begin in it, the words and
    their places."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    place = np.fromiter((places[w] for ws in words for w in ws), dtype=np.int64, count=int(sizes.sum()))
    kinds = np.where(place >= 0, classes[np.maximum(place, 0)] if len(classes) else END, -1 - place)
    starts = np.cumsum(sizes + 3) - (sizes + 3) + 2
    stream = np.full(int((sizes + 3).sum()), END, dtype=np.int64)
    stream[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(place))] = kinds
    return stream, starts, words, place


@dataclass
class LogBilinear:
    """``before``: vectors of the classes one and two places before, ``after``: vectors of the class that follows, ``bias``."""

    before: np.ndarray
    after: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, frequencies: np.ndarray, seed: int = 5) -> LogBilinear:
        rng = np.random.default_rng(seed)
        k = len(frequencies)
        return cls(
            (0.1 * rng.standard_normal((2, k, DIM))).astype(np.float32), (0.1 * rng.standard_normal((k, DIM))).astype(np.float32), np.log(frequencies).astype(np.float32)
        )

    def parts(self) -> list[np.ndarray]:
        return [self.before, self.after, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> LogBilinear:
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        return LogBilinear(*(f.reshape(p.shape).astype(np.float32) for f, p in zip(np.split(flat, cuts), self.parts(), strict=True)))

    def gradients(self, two: np.ndarray, one: np.ndarray, word: np.ndarray, noise: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
        """Noise-contrastive estimation: tell each word from the noise that stands beside it. ``rest``: log of the expected number
        of each class among the noise."""
        m = np.float32(1 / len(word))
        context = self.before[0][one] + self.before[1][two]
        target = self.after[word]
        true = (1 / (1 + np.exp(rest[word] - self.bias[word] - np.einsum("ij,ij->i", context, target))) - 1) * m
        others = self.after[noise]
        false = m / (1 + np.exp((rest - self.bias)[noise] - context @ others.T))
        d_context = true[:, None] * target + false @ others
        d_before, d_after, d_bias = np.zeros_like(self.before), np.zeros_like(self.after), np.zeros_like(self.bias)
        for out, which, rows in ((d_before[0], one, d_context), (d_before[1], two, d_context), (d_after, word, true[:, None] * context)):
            order = np.argsort(which, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(which[order]) != 0])
            out[which[order[first]]] = np.add.reduceat(rows[order], first)
        np.add.at(d_after, noise, false.T @ context)
        d_bias += np.bincount(word, true, len(d_bias)).astype(np.float32)
        np.add.at(d_bias, noise, false.sum(axis=0))
        return [d_before, d_after, d_bias]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the following class by the class one before (with the bias) and two before, and the log of the sum of the
        exponentials over all classes for each pair (one, two)."""
        one = (self.before[0] @ self.after.T + self.bias).astype(np.float64)
        two = (self.before[1] @ self.after.T).astype(np.float64)
        # exp(one + two) summed over classes is a matrix product of the exponentials; subtracting each row's maximum keeps it in range.
        top_one, top_two = one.max(axis=1), two.max(axis=1)
        return one, two, np.log(np.exp(one - top_one[:, None]) @ np.exp(two - top_two[:, None]).T) + top_one[:, None] + top_two


class Trainer:
    """Adam over batches of tokens."""

    def __init__(self, model: LogBilinear, frequencies: np.ndarray, seed: int) -> None:
        self.model = model.filled(model.flat())
        self.rng = np.random.default_rng(seed)
        self.odds = np.cumsum(frequencies)
        self.rest = np.log(NOISE * frequencies).astype(np.float32)
        self.first = [np.zeros_like(p) for p in self.model.parts()]
        self.second = [np.zeros_like(p) for p in self.model.parts()]
        self.steps = self.tokens = 0

    def learn(self, stream: np.ndarray, starts: np.ndarray) -> None:
        # Every position but the two ends before a text is a token to learn.
        ahead = np.zeros(len(stream), dtype=bool)
        ahead[starts - 1] = ahead[starts - 2] = True
        where = np.flatnonzero(~ahead)
        for at in range(0, len(where), BATCH):
            i = where[at : at + BATCH]
            noise = np.minimum(np.searchsorted(self.odds, self.rng.random(NOISE), side="right"), len(self.odds) - 1)
            grads = self.model.gradients(stream[i - 2], stream[i - 1], stream[i], noise, self.rest)
            self.steps += 1
            self.tokens += len(i)
            rate = np.float32(RATE / math.sqrt(1 + self.steps / 200))
            for p, g, a, b in zip(self.model.parts(), grads, self.first, self.second, strict=True):
                a += np.float32(0.1) * (g - a)
                b += np.float32(0.001) * (g * g - b)
                p -= rate * (a / np.float32(1 - 0.9**self.steps)) / (np.sqrt(b / np.float32(1 - 0.999**self.steps)) + np.float32(1e-6))


def train(docs: DataFrame, vocabulary: Vocabulary) -> LogBilinear:
    """One replica per task over all its tokens, averaged by tokens. Parameters are averaged by their position in Spark."""
    start = LogBilinear.new(vocabulary.frequencies())
    shared = docs.sparkSession.sparkContext.broadcast((start, vocabulary.frequent, vocabulary.classes(), vocabulary.frequencies()))

    def run(batches):
        from pyspark import TaskContext

        model, frequent, classes, frequencies = shared.value
        trainer, places = Trainer(model, frequencies, 1000 + TaskContext.get().partitionId()), Places(frequent)
        for batch in batches:
            raw = raw_texts(batch.column(0))
            for a, b in slices([len(t) for t in raw]):
                stream, starts, _, _ = class_stream(raw[a:b], places, classes)
                trainer.learn(stream, starts)
        if trainer.tokens:
            yield summed_row(TaskContext.get().partitionId(), trainer.model.flat() * np.float64(trainer.tokens), trainer.tokens)
        release(places)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    replicas = docs.select("text").mapInArrow(run, REPLICA)
    for width in (parts, min(parts, LAST_SUMS), 1):
        replicas = replicas.repartition(width, F.col("task") % width).mapInArrow(added, REPLICA)
    found = replicas.collect()
    return start.filled(np.array(found[0]["sums"]) / found[0]["tokens"]) if found else start


REPLICA = "task int, sums array<double>, tokens long"


def summed_row(task: int, sums: np.ndarray, tokens: int) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(sums)], pa.int32()), pa.array(sums))
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), lists, pa.array([tokens], pa.int64())], ["task", "sums", "tokens"])


def added(batches):
    """One row with the sums of all; at no time are two of them held besides the sum."""
    total, tokens, task = None, 0, 0
    for batch in batches:
        for i in range(batch.num_rows):
            own = batch.column(1).slice(i, 1).flatten().to_numpy()
            total = own.copy() if total is None else total + own
            tokens, task = tokens + batch.column(2)[i].as_py(), batch.column(0)[i].as_py()
    if total is not None:
        yield summed_row(task, total, tokens)


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: LogBilinear) -> DataFrame:
    """``row, doc_id, n_tokens, n_known, count_score`` (sum of log10(count + 1)) and ``score`` for every row."""
    spark = docs.sparkSession
    one, two, norm = model.tables()
    shared = spark.sparkContext.broadcast((vocabulary.frequent, vocabulary.classes(), np.log10(vocabulary.counts + 1.0), *((t / math.log(10)).astype(np.float32) for t in (one, two, norm)), np.log10(vocabulary.class_totals), vocabulary.ends))
    held: dict[str, Places] = {}

    def run(batch: pa.RecordBatch):
        frequent, classes, log_counts, one, two, norm, log_totals, ends = shared.value
        places = held.get("places") or held.setdefault("places", Places(frequent))
        raw = raw_texts(batch.column(1))
        for a, b in slices([len(t) for t in raw]):
            stream, starts, words, place = class_stream(raw[a:b], places, classes)
            i = np.flatnonzero(np.arange(len(stream)) >= 2)
            c, c1, c2 = stream[i], stream[i - 1], stream[i - 2]
            steps = np.zeros(len(stream))
            steps[i] = one[c1, c].astype(np.float64) + two[c2, c] - norm[c1, c2] - log_totals[c]
            steps[starts - 1] = steps[starts - 2] = 0
            predicted = np.add.reduceat(steps, starts - 2)
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            bounds = np.r_[0, np.cumsum(sizes)]
            known = place >= 0
            own = np.r_[0, np.cumsum(np.where(known, log_counts[np.maximum(place, 0)], 0.0) if len(log_counts) else np.zeros(len(place)))]
            n_known = np.r_[0, np.cumsum(known)]
            rare = []
            for k, ws in enumerate(words):
                found: dict[bytes, int] = {}
                for at in np.flatnonzero(~known[bounds[k] : bounds[k + 1]]).tolist():
                    found[ws[at]] = found.get(ws[at], 0) + 1
                rare.append([{"word": w.decode(), "n": n} for w, n in found.items()])
            end = math.log10(ends + 1)
            yield [
                batch.column(0).slice(a, b - a), sizes + 1, n_known[bounds[1:]] - n_known[bounds[:-1]] + (ends > 0), own[bounds[1:]] - own[bounds[:-1]] + end, predicted, rare,
            ]

    schema = "doc_id long, n_tokens long, n_known long, count_score double, score double, rare array<struct<word:string,n:long>>"
    # The rows are written with a number each, so that rare words find back to their row even if ids repeat.
    main = materialise(map_batches(docs, run, schema, held).withColumn("row", F.monotonically_increasing_id()), "lm-documents")
    fewest = int(vocabulary.counts.min()) if len(vocabulary.counts) else 1 << 62
    others = counts.where(F.col("n") < fewest).withColumnRenamed("n", "c")
    # A word that was never counted adds log10(0 + 1), which is nothing.
    found = main.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(others, "word")
    sums = found.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_score"))
    more, rare = F.coalesce("more", F.lit(0)), F.coalesce("rare_score", F.lit(0.0))
    return main.drop("rare").join(sums, "row", "left").select(
        "row", "doc_id", "n_tokens", (F.col("n_known") + more).alias("n_known"), (F.col("count_score") + rare).alias("count_score"), (F.col("score") + F.col("count_score") + rare).alias("score")
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row: log10 probabilities of the whole
    text, ``base_score`` by single-token counts plus one and ``score`` by the model. Counts and training cover all documents
    that are not held out.

    Null and empty texts are one token, the end. Null ids are learned from; repeated rows are kept and learned from as often.
    If nothing can be learned every class is equally likely and the base is 0. Other columns are not read.
    """
    texts = id_and_text(docs, id_col, text_col)
    learned = texts.where(~held_out(F.col("doc_id")))
    counts = materialise(word_counts(learned), "word-counts")
    vocabulary = Vocabulary.of(counts, learned.count())
    scored = score(texts, counts, vocabulary, train(learned, vocabulary))
    base = F.col("count_score") - F.col("n_tokens") * F.log10(F.lit(float(vocabulary.tokens + vocabulary.distinct + 1)))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
