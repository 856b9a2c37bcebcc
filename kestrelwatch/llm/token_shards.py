"""Token ids as binary shards in training order.

Every task tokenises its documents, ends each with the end token and packs them into sequences of fixed length. A keyed
Feistel permutation with cycle-walking sends the running number of a sequence to its global slot: a bijection that needs no
sort and no table, so any sequence can be found and the order be changed by another key. Slots are cut into ranges, one file
per range; every record has the same stride, so slot s starts at byte (s mod range) * stride of its file and a reader can
begin anywhere.
"""

from __future__ import annotations

import base64
import math
import posixpath
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelwatch.llm.arrow import id_and_text, raw_texts, scrambled, slices
from kestrelwatch.llm.byte_bpe import PIECES
from kestrelwatch.session import work_dir

LENGTH = 1024
SHARD_SEQUENCES = 8192
ROUNDS = 8
HEADER = np.dtype([("n", "<u4"), ("crc", "<u4")])


@dataclass(frozen=True)
class Permutation:
    """A bijection of 0 .. size-1."""

    size: int
    key: int

    @property
    def half(self) -> int:
        return max(1, math.ceil(math.log2(max(2, self.size)) / 2))

    def _network(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        half = np.uint64(self.half)
        mask = np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (scrambled(right ^ k) & mask)
        return (left << half) | right

    def slots(self, index: np.ndarray) -> np.ndarray:
        """Where each index goes. A value outside goes through the network again until it is inside; its cycle leads back, so
        this ends, and the domain is less than four times the size."""
        keys = list(scrambled(np.uint64(self.key) + np.arange(1, ROUNDS + 1, dtype=np.uint64)))
        out = self._network(index.astype(np.uint64), keys)
        while (outside := np.flatnonzero(out >= self.size)).size:
            out[outside] = self._network(out[outside], keys)
        return out.astype(np.int64)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def sequences(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, number, n, ids, docs``: the sequences of each task in order, ``ids`` as 16-bit little-endian numbers, the last one
    of a task filled up with the end token beyond ``n``; ``docs`` has the id, and the place of the first token, of each
    document that begins in the sequence. Null and empty texts are an end token alone; null ids are kept as null."""
    tables = docs.sparkSession.sparkContext.broadcast(ranks(path))
    if max(tables.value.values()) >= 0xFFFF:
        raise ValueError("16-bit numbers cannot hold this vocabulary")
    end = max(tables.value.values()) + 1
    place = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32())]))
    schema = pa.schema([("part", pa.int32()), ("number", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("docs", place)])

    def run(batches):
        import tiktoken

        encoding = tiktoken.Encoding("shards", pat_str=PIECES, mergeable_ranks=tables.value, special_tokens={})
        part, number = TaskContext.get().partitionId(), 0
        held, begun = np.zeros(0, "<u2"), []

        def cut(last: bool):
            nonlocal number, held, begun
            whole = len(held) // length * length
            if last and len(held) > whole:
                n_last = len(held) - whole
                held = np.concatenate([held, np.full(length - n_last, end, "<u2")])
                whole = len(held)
            else:
                n_last = length
            rows, docs_of = whole // length, [[] for _ in range(whole // length)]
            rest = []
            for doc, at in begun:
                if at < whole:
                    docs_of[at // length].append({"doc_id": doc, "at": at % length})
                else:
                    rest.append((doc, at - whole))
            n = [length] * rows
            if rows:
                n[-1] = n_last
            ids = [held[i * length : (i + 1) * length].tobytes() for i in range(rows)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * rows, pa.int32()), pa.array(range(number, number + rows), pa.int64()), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array(docs_of, place)], schema=schema
            )
            number, held, begun = number + rows, held[whole:], rest
            return out

        for batch in batches:
            raw, ids = raw_texts(batch.column(1)), batch.column(0).to_pylist()
            for a, b in slices([len(t) for t in raw]):
                found, at = [held], len(held)
                for doc, text in zip(ids[a:b], raw[a:b], strict=True):
                    begun.append((doc, at))
                    tokens = encoding.encode_ordinary(text.decode())
                    tokens.append(end)
                    found.append(np.array(tokens, dtype="<u2"))
                    at += len(tokens)
                held = np.concatenate(found)
                yield cut(last=False)
        if len(held):
            yield cut(last=True)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "part int, number long, n int, ids binary, docs array<struct<doc_id:long,at:int>>")


def write_shards(found: DataFrame, folder: str, key: int, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """Writes written sequences (a table as ``sequences`` gives it, read from storage, so that it cannot change) as shards into
    ``folder``, which all executors reach, and returns the manifest: ``shard, file, first_slot, n_sequences, n_tokens``.

    A record is the number of its tokens and the CRC-32 of its ids (32 bits each) and then the ids. Within a task the sequences
    of one shard travel together, compressed. A shard is put together in memory, whose size its range fixes, written under
    another name and moved into place: a task that is run again writes the same bytes. No sequences: no files.
    """
    spark = found.sparkSession
    counts = {r["part"]: r["n"] for r in found.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, before = 0, {}
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    order = Permutation(total, key)
    stride = HEADER.itemsize + 2 * length
    offsets = spark.sparkContext.broadcast(before)

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            if not batch.num_rows:
                continue
            part, number, n = (batch.column(i).to_numpy() for i in range(3))
            index = np.array([offsets.value[p] for p in part.tolist()], dtype=np.int64) + number
            slot = order.slots(index)
            records = np.zeros(len(slot), dtype=[("slot", "<i8"), ("head", HEADER), ("ids", f"V{2 * length}")])
            ids = batch.column(3).to_pylist()
            records["slot"], records["head"]["n"] = slot, n
            records["head"]["crc"] = [zlib.crc32(i) for i in ids]
            records["ids"] = np.frombuffer(b"".join(ids), dtype=f"V{2 * length}")
            shard = slot // shard_sequences
            by = np.argsort(shard, kind="stable")
            groups = np.split(by, np.flatnonzero(np.diff(shard[by])) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(shard[g[0]]) for g in groups], pa.int64()), pa.array([pack(records[g].tobytes()) for g in groups], pa.binary())], ["shard", "records"]
            )

    def write(batches):
        store, base = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        kind = np.dtype([("slot", "<i8"), ("head", HEADER), ("ids", f"V{2 * length}")])
        record = np.dtype([("head", HEADER), ("ids", f"V{2 * length}")])
        at, buffer = None, None

        def close():
            first = at * shard_sequences
            name = f"shard-{at:08d}.bin"
            temporary = posixpath.join(base, f".{name}-{uuid.uuid4().hex}")
            with store.open_output_stream(temporary) as out:
                out.write(buffer.tobytes())
            store.move(temporary, posixpath.join(base, name))
            row = (at, name, first, len(buffer), int(buffer["head"]["n"].sum(dtype=np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["shard", "file", "first_slot", "n_sequences", "n_tokens"])

        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != at:
                    if at is not None:
                        yield close()
                    at, buffer = shard, np.zeros(min(shard_sequences, total - shard * shard_sequences), dtype=record)
                rows = np.frombuffer(unpack(blob), dtype=kind)
                where = rows["slot"] - at * shard_sequences
                buffer["head"][where], buffer["ids"][where] = rows["head"], rows["ids"]
        if at is not None:
            yield close()

    assert record_size(length) == stride
    shards = -(-total // shard_sequences)
    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # The partitions are ranges of slots: consecutive shards, each whole.
    dealt = found.select("part", "number", "n", "ids").mapInArrow(deal, "shard long, records binary")
    dealt = dealt.repartitionById(tasks, (F.col("shard") * tasks / max(1, shards)).cast("int")).sortWithinPartitions("shard")
    manifest = dealt.mapInArrow(write, "shard long, file string, first_slot long, n_sequences long, n_tokens long")
    hadoop_mkdirs(spark, folder)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def record_size(length: int) -> int:
    return HEADER.itemsize + 2 * length


def hadoop_mkdirs(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def read_shards(spark: SparkSession, folder: str, first_slot: int = 0, length: int = LENGTH, chunk: int = 1024) -> DataFrame:
    """``slot, shard, n_tokens, ids`` (the 16-bit numbers) from ``first_slot`` on. Only files that reach it are opened, from its
    byte on. A record whose checksum does not fit is an error."""
    manifest = spark.read.parquet(f"{folder}/manifest").where(F.col("first_slot") + F.col("n_sequences") > first_slot)
    record = np.dtype([("head", HEADER), ("ids", f"V{2 * length}")])

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, name, first, rows in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                with store.open_input_file(posixpath.join(base, name)) as file:
                    at = max(0, first_slot - first)
                    file.seek(at * record.itemsize)
                    while at < rows:
                        found = np.frombuffer(file.read(min(chunk, rows - at) * record.itemsize), dtype=record)
                        ids = [bytes(i) for i in found["ids"].tolist()]
                        if not len(found) or any(zlib.crc32(i) != c for i, c in zip(ids, found["head"]["crc"].tolist(), strict=True)):
                            raise OSError(f"{name} is damaged at record {at}")
                        n = len(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(range(first + at, first + at + n), pa.int64()), pa.array([shard] * n, pa.int64()), pa.array(found["head"]["n"].astype(np.int64)), pa.array(ids, pa.binary())],
                            ["slot", "shard", "n_tokens", "ids"],
                        )
                        at += n

    # One small row per file: dealt out, since the manifest itself is tiny.
    files = manifest.select("shard", "file", "first_slot", "n_sequences").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard")
    return files.mapInArrow(run, "slot long, shard long, n_tokens long, ids binary")


def materialise_order(docs: DataFrame, path: str, folder: str, key: int, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """Tokenises, writes and returns the table of sequences (kept beside the shards: ``part, number, n, docs`` say which documents
    begin where, and ``Permutation`` in which slot)."""
    sequences(docs, path, length).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/sequences")
    found = docs.sparkSession.read.parquet(f"{folder}/sequences")
    write_shards(found, folder, key, length, shard_sequences)
    return found


def shard_digest(spark: SparkSession, docs: DataFrame, path: str, key: int = 20240229) -> DataFrame:
    """Materialises the documents in the shared folder and reads every shard again: ``slot, shard, n_tokens, ids_sha256``."""
    folder = work_dir(spark, "token-shards")
    materialise_order(docs, path, folder, key)
    return read_shards(spark, folder).select("slot", "shard", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))
