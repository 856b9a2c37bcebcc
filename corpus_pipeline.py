"""Documents to token ids in four stages: language, near duplicates, benchmark passages, BPE.

Every stage works on all rows that the one before it kept; all but the last return the columns of ``documents``. What goes is
decided for each row by itself, whether its id is null or repeated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelwatch.llm import byte_gru, chosen_path, decontaminate, trie_bpe
from kestrelwatch.session import materialise, work_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_50k.json"


#: Rows up to this many (some 16 MB) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A file has fewer rows than 2 to this power.
FILE_ROW_BITS = 40
#: Share of the labelled texts that must score better than a text without label that goes.
CLEAN = 0.999


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, which is never null and stands for one row only: its place in its Parquet file and the number of the
    file. These are written, so that every reading finds the same. Anything but a plain Parquet table is written first."""
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    try:
        placed = docs.select(*COLUMNS, path.alias("path"), place.alias("place")) if plain else None
    except AnalysisException:
        placed = None
    if placed is None:
        placed = materialise(docs.select(*COLUMNS), "documents").select(*COLUMNS, path.alias("path"), place.alias("place"))
    files = sorted(r["path"] for r in placed.select("path").distinct().collect())
    order = docs.sparkSession.createDataFrame(list(enumerate(files)), "file long, path string")
    row = F.shiftleft("file", FILE_ROW_BITS).bitwiseOR(F.col("place"))
    return placed.join(F.broadcast(order), "path").select(*COLUMNS, row.alias("row"))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` (numbered) without the rows whose number is among ``rows`` (column ``gone``, no number twice)."""
    gone = materialise(rows, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["row"] == gone["gone"], "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language can be told go: null, without a letter, or without a label and with a pooled probability
    that ``CLEAN`` of the labelled texts of like length (in powers of two of bytes) surpass. Labelled texts with a letter stay;
    so do lengths without labelled texts, and all texts with a letter if there was nothing to learn from."""
    rows, model = numbered(docs), byte_gru.train(docs)
    if not model.languages:
        return without(rows, rows.where(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(F.col("row").alias("gone")))
    found = byte_gru.predict(rows, model, id_col="row").withColumnRenamed("doc_id", "gone")
    if rows.where("lang is null").isEmpty():
        return without(rows, found.where(F.col("lang_pred") == byte_gru.UNDETERMINED).select("gone"))
    found = materialise(found, "languages")
    told = found.where(F.col("lang_pred") != byte_gru.UNDETERMINED)
    length = F.floor(F.log2(F.octet_length("text")))
    told = materialise(told.join(rows.select(F.col("row").alias("gone"), "lang", length.alias("length")), "gone"), "scores")
    least = told.where(F.col("lang").isin(model.languages)).groupBy("length").agg(F.percentile_approx("score", 1 - CLEAN, 10_000).alias("least"))
    unlike = told.where("lang is null").join(F.broadcast(least), "length").where("score < least")
    return without(rows, found.where(F.col("lang_pred") == byte_gru.UNDETERMINED).select("gone").unionByName(unlike.select("gone")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles connect (similarity 0.8 or more) the row with the smallest id stays, null
    being the largest; of rows with the same id, one. Texts without words stay."""
    rows = numbered(docs)
    found = chosen_path.similarity_join(rows, id_col="row").where("n_links > 0")
    linked = materialise(found.select(F.col("doc_id").alias("row"), "class_id"), "ngram-classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stays = linked.join(rows.select("row", "doc_id"), "row").groupBy("class_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return without(rows, linked.join(stays, "row", "left_anti").select(F.col("row").alias("gone")))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    rows = numbered(docs)
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="row")
    return without(rows, found.where("contaminated").select(F.col("doc_id").alias("gone")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, how many, and digests of the ids and of the text that they decode to."""
    tokens = trie_bpe.encode(docs, public_tokenizers.path(TOKENIZER), decoded=True)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [("language_id", language), ("ngram_join", near_duplicates), ("decontamination", benchmark_passages), ("bpe", token_ids)]

# A network's predictions and BPE have no SQL form; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
