"""Benchmark decontamination as a prefix-filtered set join.

An item is a row of overlapping windows of ``window`` words (an item of fewer words is one window), a window is the set of
its word shingles. A document contains a window only if it contains all of its shingles, so one necessary shingle is
enough to find it: the prefix of the set, ordered by rarity over all documents, has length one. Per occurrence of that
shingle the place in the window says where the window would begin, the bounds of the text say whether it fits there, and
the words themselves decide.

The documents are read once. A bitmap of fixed size over the shingles of all items lets a task see which of a document's
shingles can matter; only runs of such shingles that are long enough for a window are kept, with their words. A bitmap
that is too full for a very large benchmark lets more runs through and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelwatch.llm.arrow import WordHashes, hashed_words, id_and_text, map_batches, raw_texts, rolling, slices
from kestrelwatch.session import materialise

WINDOW = 10
SHINGLE = 5
BITMAP_BITS = 24
BROADCAST_WINDOWS = 200_000


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, words`` (the words of one window, a space between), ``n`` (how many), ``shingles`` (their hashes)."""
    known = WordHashes()

    def cut(batch: pa.RecordBatch):
        raw = raw_texts(batch.column(1))
        ids = batch.column(0).to_pylist()
        for a, b in slices([len(t) for t in raw]):
            words, flat, starts = hashed_words(raw[a:b], known)
            out = []
            for i, own in enumerate(words):
                n = min(window, len(own))
                for at in range(len(own) - n + 1 if own else 0):
                    first = starts[i] + at
                    found = rolling(flat[first : first + n], min(shingle, n)).view(np.int64)
                    out.append((ids[a + i], b" ".join(own[at : at + n]).decode(), n, found))
            if out:
                yield [list(c) for c in zip(*out, strict=True)]

    return map_batches(id_and_text(items, id_col, text_col), cut, "item_id long, words string, n int, shingles array<long>", known)


def bitmap(hashes: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A set of hashes (column ``hash``) as 2^bits bits. At most 2^(bits-6) rows reach the driver, whatever their number."""
    slot = F.col("hash").bitwiseAND((1 << bits) - 1)
    rows = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(hash & 63 as int))")).alias("set")
    ).collect()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    for row in rows:
        out[row["word"]] = row["set"]
    return out.view(np.uint64)


def in_bitmap(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(held) * 64 - 1)
    return (held[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def document_runs(docs: DataFrame, held: np.ndarray, least: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs``: runs of words all of whose shingles of one size may be shingles of items. ``least``: for
    each shingle size the words of the shortest window that is made of such shingles."""
    bits = docs.sparkSession.sparkContext.broadcast(held)
    known = WordHashes()

    def cut(batch: pa.RecordBatch):
        raw = raw_texts(batch.column(1))
        for a, b in slices([len(t) for t in raw]):
            words, flat, starts = hashed_words(raw[a:b], known)
            found: list[list[tuple]] = [[] for _ in words]
            for size, fewest in least.items():
                if len(flat) < size:
                    continue
                hashes = rolling(flat, size)
                hit = in_bitmap(hashes, bits.value)
                # Shingles that reach into the next text are none.
                for end in range(1, size):
                    across = starts[1:-1] - end
                    hit[across[(across >= 0) & (across < len(hit))]] = False
                # A run also ends where a text begins.
                edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                firsts, lasts = edge[0::2], edge[1::2]
                if size == 1:
                    inner = starts[1:-1]
                    inner = inner[(inner > 0) & (inner < len(hit))]
                    inner = np.unique(inner[hit[inner] & hit[inner - 1]])
                    firsts, lasts = np.sort(np.r_[firsts, inner]), np.sort(np.r_[lasts, inner])
                long = lasts - firsts + size - 1 >= fewest
                for first, last in zip(firsts[long].tolist(), lasts[long].tolist(), strict=True):
                    doc = int(np.searchsorted(starts, first, side="right")) - 1
                    at = first - int(starts[doc])
                    text = b" ".join(words[doc][at : at + last - first + size - 1]).decode()
                    found[doc].append({"size": size, "start": at, "words": text, "shingles": hashes[first:last].view(np.int64).tolist()})
            yield batch.column(0).slice(a, b - a), np.diff(starts), found

    schema = "doc_id long, n_words long, runs array<struct<size:int,start:int,words:string,shingles:array<long>>>"
    return map_batches(id_and_text(docs, id_col, text_col), cut, schema, known)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit`` (words inside any occurrence of any window), ``n_items`` (items
    with occurring windows), ``item_ids`` (sorted as strings), ``spans`` (hit stretches as start and end in words) and
    ``contaminated``.

    Words: A-Z lower-cased, ASCII letters, digits and all non-ASCII characters. Null and empty texts have no words and no
    hits; items without words have no windows; with no items nothing is hit. A null item id still hits words but is not
    listed. Repeated documents and null ids keep their rows; repeated items count once per id. Other columns are not read.
    """
    spark = docs.sparkSession
    windows = materialise(item_windows(items, window, shingle, item_id, item_text), "item-windows")
    distinct = materialise(
        windows.groupBy("words").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")).withColumn("size", F.least("n", F.lit(shingle))), "windows"
    )
    lengths = {r["size"]: r["n"] for r in distinct.groupBy("size").agg(F.min("n").alias("n")).collect()}
    held = bitmap(distinct.select(F.explode("shingles").alias("hash")))
    found = materialise(document_runs(docs, held, lengths, doc_id, doc_text).withColumn("row", F.monotonically_increasing_id()), "document-runs")

    runs = found.select("row", F.explode("runs").alias("run")).select("row", "run.*")
    seen = runs.select("row", "start", "words", F.posexplode("shingles").alias("at", "hash"))
    # Rarity: in how many documents each shingle of a window stands.
    frequency = seen.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    ordered = distinct.select("words", "n", F.posexplode("shingles").alias("offset", "hash")).join(frequency, "hash", "left")
    prefix = materialise(
        ordered.groupBy("words", "n").agg(F.min_by(F.struct("hash", "offset"), F.struct(F.coalesce("df", F.lit(0)), "offset")).alias("p"), F.min(F.coalesce("df", F.lit(0))).alias("df"))
        .where("df > 0")
        .select(F.col("words").alias("window"), "n", "p.hash", "p.offset"),
        "prefix",
    )
    if prefix.count() <= BROADCAST_WINDOWS:
        prefix = F.broadcast(prefix)
    begin = F.col("at") - F.col("offset")
    matches = (
        seen.join(prefix, "hash")
        .where((begin >= 0) & (F.size(F.split("words", " ")) >= begin + F.col("n")))
        .where(F.array_join(F.slice(F.split("words", " "), begin + 1, F.col("n")), " ") == F.col("window"))
        .select("row", (F.col("start") + begin).alias("first"), (F.col("start") + begin + F.col("n")).alias("end"), "window")
    )
    matches = materialise(matches, "window-matches")
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("until"))
    spans = matches.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda acc, x: F.struct(
            (acc["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["until"], x["first"])).cast("long")).alias("hit"),
            F.greatest(acc["until"], x["end"]).alias("until"),
        ),
    )["hit"]
    spans = spans.select("row", "spans", covered.alias("n_hit"))
    # Windows shared by several items stand for all of them; a document meets each pair of window and item once.
    listed = windows.where("item_id is not null").select(F.col("words").alias("window"), "item_id").distinct()
    which = (
        matches.select("row", "window").distinct().join(listed, "window").groupBy("row")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    none = F.array().cast("array<string>")
    return (
        found.select("row", "doc_id", "n_words").join(spans, "row", "left").join(which, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", none).alias("item_ids"),
            F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>")).alias("spans"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )
