"""Replay recorded feeds faster than they happened, in batches of one original hour."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelwatch.operators.scan import Spec, scan

LINES_PER_SLICE = 100_000


def accelerate(feeds: DataFrame, secs_per_hour: int, start: datetime, oldest: datetime) -> DataFrame:
    """Add ``replay_time`` and ``batch`` to rows with ``feed, line, timestamp``.

    An original hour takes ``secs_per_hour`` from ``start`` on. ``batch`` n is the n-th hour after ``oldest``; inside a
    feed it never falls, so a row that arrives late goes into the batch of the rows before it. Feeds are few and large,
    so the running batch number is always computed in slices of lines.
    """
    offset = F.expr(f"(unix_millis(timestamp) - {_millis(oldest)}) * {secs_per_hour} div 3600")
    own = F.greatest(F.lit(1), F.ceil(offset / F.lit(secs_per_hour * 1000))).cast("long")
    rows = feeds.withColumn("replay_time", F.timestamp_millis(F.lit(_millis(start)) + offset)).withColumn(
        "_slice", F.expr(f"line div {LINES_PER_SLICE}")
    )
    return scan(rows, ["feed"], ["line"], [Spec("batch", "max", own)], "_slice").drop("_slice")


def _millis(when: datetime) -> int:
    aware = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return (aware - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)


def write_batches(replay: DataFrame, path: str) -> None:
    """One folder per batch and feed, to be fed to a file stream one after the other. A large batch is written by
    several tasks: the line number spreads it."""
    spread = F.expr(f"line div {LINES_PER_SLICE}")
    replay.repartition("batch", "feed", spread).write.mode("overwrite").partitionBy("batch", "feed").parquet(path)
