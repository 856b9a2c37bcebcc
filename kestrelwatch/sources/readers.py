"""Readers for raw feeds, labelled incidents, transition files, stored events and message streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kestrelwatch.functions.texts import utc_date

MESSAGE_SCHEMA = "key string, value string, headers array<struct<key: string, value: binary>>"


def _texts(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _csv(spark: SparkSession, path: str, schema: StructType, streaming: bool) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return (
        reader.schema(schema)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_feed(spark: SparkSession, path: str, objects: Sequence[str] = ("user",), streaming: bool = False) -> DataFrame:
    """Raw lines ``time, operation, object[, object]`` without a header, as ``timestamp, operation, <objects>, file,
    block``. ``file`` is the whole path: files of one name in two folders are two feeds. ``objects`` is e.g. ``("user", "device")``. ``block`` is where the row's part of the file starts."""
    raw = _csv(spark, path, _texts("time", "operation", *objects), streaming)
    return raw.select(
        F.try_to_timestamp(F.col("time")).alias("timestamp"),
        "operation",
        *objects,
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled incidents ``label, time, operation, entity``."""
    raw = _csv(spark, path, _texts("label", "time", "operation", "entity"), False)
    return raw.select("label", F.try_to_timestamp(F.col("time")).alias("timestamp"), "operation", "entity")


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    """State transitions ``state, time, action, key[, tag1[, tag2]]``; the action Login opens, any other closes."""
    raw = _csv(spark, path, _texts("state", "time", "action", "key", "tag1", "tag2"), False)
    empty = F.lit(None).cast("string")
    return raw.filter("action is not null").select(
        "key",
        F.try_to_timestamp(F.col("time")).alias("timestamp"),
        "state",
        (F.col("action") == "Login").alias("open"),
        "tag1",
        "tag2",
        empty.alias("tag3"),
        empty.alias("eventid"),
        empty.alias("streamid"),
    )


def read_events(
    spark: SparkSession,
    path: str,
    after: str | None = None,
    before: str | None = None,
    description: str | None = None,
    max_results: int | None = None,
    ties: Sequence[str | Column] = (),
) -> DataFrame:
    """Stored events (see ``store_events``) strictly between two times and of one kind. All conditions reach the scan,
    and the days outside the range are not read. ``max_results`` keeps the earliest."""
    return select_events(spark.read.parquet(path), after, before, description, max_results, ties=ties)


def select_events(
    stored: DataFrame,
    after: str | None = None,
    before: str | None = None,
    description: str | None = None,
    max_results: int | None = None,
    time: str = "idxEventTime",
    kind: str = "idxDescription",
    ties: Sequence[str | Column] = (),
) -> DataFrame:
    """``time`` is a timestamp, or ISO text in UTC as ``store_events`` writes it. A column ``date`` is the day in UTC and prunes
    folders. Of equal times, ``ties`` decide which rows are the earliest ``max_results``."""
    rows = stored
    dated = "date" in stored.columns
    texts = dict(stored.dtypes)[time] == "string"

    def bound(value: str) -> Column:
        return F.lit(value) if texts else F.lit(value).cast("timestamp")

    if after is not None:
        rows = rows.filter(F.col(time) > bound(after))
        rows = rows.filter(F.col("date") >= utc_date(F.lit(after).cast("timestamp"))) if dated else rows
    if before is not None:
        rows = rows.filter(F.col(time) < bound(before))
        rows = rows.filter(F.col("date") <= utc_date(F.lit(before).cast("timestamp"))) if dated else rows
    if description is not None:
        rows = rows.filter(F.col(kind) == description)
    if max_results is None:
        return rows
    return _until_enough(rows, time, max_results).orderBy(time, *ties).limit(max_results)


def _until_enough(rows: DataFrame, time: str, wanted: int) -> DataFrame:
    """Drop the hours that cannot hold the earliest ``wanted`` rows, so that only rows of the hours that matter are sorted
    in the end. The counts per hour, one row per hour, are summed up in time order."""
    when = F.col(time).try_cast("timestamp")
    per_hour = rows.groupBy(F.date_trunc("hour", when).alias("hour")).count()
    earlier = F.coalesce(F.sum("count").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = per_hour.withColumn("earlier", earlier).filter(F.col("earlier") < wanted).agg(F.max("hour").alias("hour")).first()["hour"]
    return rows if last is None else rows.filter((F.date_trunc("hour", when) <= F.lit(last)) | when.isNull())


def read_stream(
    spark: SparkSession, source: str = "kafka", path: str | None = None, schema: str | StructType = MESSAGE_SCHEMA, **options
) -> DataFrame:
    """A stream of messages: ``kafka`` (the connector must be on the class path) or a folder of files in any format
    with the same columns."""
    reader = spark.readStream.format(source)
    if source != "kafka":
        reader = reader.schema(schema)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path) if path else reader.load()


def kafka_options(
    servers: str, topic: str, starting: str = "latest", headers: bool = True, fail_on_data_loss: bool = False
) -> dict[str, str]:
    """Options for ``read_stream(spark, "kafka", **kafka_options(...))``."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "includeHeaders": str(headers).lower(),
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
