"""Texts of Arrow batches as raw UTF-8, cut into slices of bounded size, for the operators that work on batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
# Rows of an Arrow batch, unless the session sets another number than Spark's default: texts are whole and can be long, and
# a batch is held in the JVM, in the worker and once more as objects.
BATCH_ROWS = 1000
_ROWS, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

# Upper case to lower case for A-Z; every other byte stands for itself.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# The same, and everything that is neither an ASCII letter or digit nor part of a non-ASCII character becomes a space.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 of every row; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer text stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


class WordHashes(dict):
    """64-bit hash of each word, remembered."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def hashed_words(texts: list[bytes], known: WordHashes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words (lower-case letters, digits and non-ASCII characters) of each text, the hashes of all of them one after
    the other, and the position at which each text begins, closed by the total."""
    words = [t.translate(WORD_BYTES).split() for t in texts]
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    flat = np.fromiter((known[w] for ws in words for w in ws), dtype=np.uint64, count=int(starts[-1]))
    return words, flat, starts


MIX = np.uint64(0x9E3779B97F4A7C15)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values without visible structure (the finaliser known as splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbours: one value less than ``size`` fewer. The order within the run counts."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = (out + hashes[i : i + n]) * MIX
    return scrambled(out + np.uint64(size))


def release(*caches) -> None:
    """Empties a task's memories and hands what the worker no longer needs back to the system: Spark keeps workers for later
    tasks, and many idle ones side by side would hold on to it."""
    for cache in caches:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    system = ctypes.CDLL(None)
    if hasattr(system, "malloc_trim"):
        system.malloc_trim(0)


def map_batches(frame: DataFrame, function, schema: str, *caches) -> DataFrame:
    """``mapInArrow`` for a function from one record batch to an iterator of lists of columns in the order of ``schema``.
    ``caches`` are what the function remembers from batch to batch; they are emptied when a task ends."""
    spark = frame.sparkSession
    empty = spark.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty.schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in function(batch):
                    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)
        release(*caches)

    return frame.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, so that others, whatever their names, cannot clash with its output."""
    if docs.sparkSession.conf.get(_ROWS) == _DEFAULT_ROWS:
        docs.sparkSession.conf.set(_ROWS, BATCH_ROWS)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
