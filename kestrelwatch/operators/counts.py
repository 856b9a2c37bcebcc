"""Counts over calendar units and time windows. All aggregate map-side before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelwatch.functions.durations import epoch_seconds
from kestrelwatch.functions.texts import event_ref
from kestrelwatch.operators.normalise import operation

TS = "timestamp"


def weekday(ts: Column | str = TS) -> Column:
    return F.date_format(ts, "EEEE")


def counts_per_hour(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("hour", TS).alias("date")).count().sort("date")


def operation_counts_per_hour(events: DataFrame, wanted: str | None = None) -> DataFrame:
    """Counts per (operation, hour), for one operation or for all."""
    rows = events.select(operation().alias("operation"), TS)
    rows = rows.filter(F.col("operation") == wanted) if wanted else rows
    return rows.groupBy("operation", F.date_trunc("hour", TS).alias("date")).count().sort("date", "operation")


def training_counts(events: DataFrame) -> DataFrame:
    """Counts per (date, weekday name, hour, operation): what the models learn from."""
    return (
        events.groupBy(
            F.date_trunc("day", TS).alias("date"),
            weekday().alias("day"),
            F.hour(TS).alias("hour"),
            operation().alias("operation"),
        )
        .count()
        .sort("date", "hour", "operation")
    )


def tumbling_counts(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """``window, day, hour, count``; on a table or a stream."""
    return events.groupBy(F.window(TS, size), weekday().alias("day"), F.hour(TS).alias("hour")).count()


def sliding_counts(events: DataFrame, size: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    """Overlapping windows; ``slide`` must divide ``size``. A table is first counted per slide, so only those counts,
    not the events, are repeated for each window they fall into."""
    if events.isStreaming:
        return events.groupBy(F.window(TS, size, slide)).count()
    steps = events.groupBy(F.window(TS, slide).alias("step")).count()
    return steps.groupBy(F.window(F.col("step.start"), size, slide)).agg(F.sum("count").alias("count"))


def rolling_counts(events: DataFrame, by: Sequence[str], seconds: int = 3600, slice_seconds: int | None = None) -> DataFrame:
    """Per ``by`` and second with events: how many events in that second (``events``) and in the ``seconds`` up to and
    including it (``rolling``). Events are counted per second first, so a window sees at most one row per second.

    No window holds a whole key: histories are cut into slices of ``slice_seconds`` (eight frames), and a slice gets the
    seconds of a frame's length before it as a halo, which is dropped again. So a slice never has more rows than it has
    seconds, whatever the key, and only what lies in a halo is held twice.
    """
    length = slice_seconds or 8 * seconds
    second = F.col("second")
    per_second = events.groupBy(*by, epoch_seconds(F.col(TS)).alias("second")).agg(F.count(F.lit(1)).alias("events"))
    own, last = F.floor(second / length).cast("long"), F.floor((second + seconds) / length).cast("long")
    # Events without a time are a slice of their own.
    slices = F.when(second.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(own, last))
    rows = per_second.withColumn("_slice", F.explode(slices))
    w = Window.partitionBy(*by, "_slice").orderBy("second").rangeBetween(-seconds, 0)
    rows = rows.withColumn("rolling", F.sum("events").over(w))
    return rows.filter(F.col("_slice").eqNullSafe(own)).drop("_slice")


def with_rolling_count(events: DataFrame, by: Sequence[str], seconds: int = 3600, slice_seconds: int | None = None) -> DataFrame:
    """Every event with the number of events of the same ``by`` in the ``seconds`` up to and including its own."""
    counts = rolling_counts(events, by, seconds, slice_seconds).drop("events")
    counts = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "second", "rolling")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
    joined = events.join(counts, same & epoch_seconds(F.col(TS)).eqNullSafe(F.col("second")))
    return joined.drop("second", *[f"_by{i}" for i in range(len(by))])


def hourly_event_refs(failures: DataFrame) -> DataFrame:
    """One row per hour and event in it: ``window, eventref``. On a table or a stream (there without repeats, if the stream
    is de-duplicated). Events without both ids have no reference."""
    ref = event_ref(F.col("streamid"), F.col("eventid"))
    rows = failures.select(F.window(TS, "1 hour").alias("window"), ref.alias("eventref")).filter("eventref is not null")
    return rows if failures.isStreaming else rows.distinct()


def hourly_ref_counts(refs: DataFrame) -> DataFrame:
    """``window, day, hour, count`` from the rows of ``hourly_event_refs``."""
    start = F.col("window.start")
    return refs.groupBy("window").count().select("window", weekday(start).alias("day"), F.hour(start).alias("hour"), "count")


def user_operation_counts(view: str) -> str:
    """SQL over a view of a table or stream: events with both ids known, per user and operation."""
    return f"select user, operation, count(streamid, eventid) as events from {view} group by user, operation"


def oldest_event(feeds: DataFrame, margin_seconds: int = 10) -> DataFrame:
    """Start of a replay: the earliest first line of any file, not after now, less a margin. Columns of ``feeds``:
    ``feed, line, timestamp``."""
    firsts = feeds.groupBy("feed").agg(F.min_by(TS, "line").alias(TS))
    start = F.least(F.min(TS), F.current_timestamp()) - F.lit(timedelta(seconds=margin_seconds))
    return firsts.agg(start.alias("oldest"))


def state_occupancy(transitions: DataFrame, at=None) -> DataFrame:
    """How many keys are in each state (the state their last transition opened, or '-' after a close)."""
    rows = transitions.filter(F.col(TS) <= F.lit(at)) if at is not None else transitions
    now = F.when(F.col("open"), F.col("state")).otherwise(F.lit("-"))
    order = F.struct(TS, "streamid", "eventid")
    last = rows.groupBy("key").agg(F.max_by(now, order).alias("state"))
    return last.groupBy("state").agg(F.count(F.lit(1)).alias("keys"))
