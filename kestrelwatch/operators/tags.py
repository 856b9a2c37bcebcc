"""Rules on tag values: how many distinct values, how many open at once, and open counts that closes decrement."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelwatch.operators.scan import DEFAULT_SLICE_SECONDS, HotKeys, Spec, scan, split_scan, time_slice

_ROWS_PER_SLICE = 2**32


def distinct_tags(transitions: DataFrame, tag: str, size: str, slide: str | None = None) -> DataFrame:
    """Number of distinct values of a tag that a key opened in each time window: ``key, window, values``. Values are
    de-duplicated per (key, window, value) before they are counted, never collected."""
    opens = transitions.filter(F.col("open") & F.col(tag).isNotNull())
    window = F.window("timestamp", size, slide) if slide else F.window("timestamp", size)
    values = opens.groupBy("key", window.alias("window"), tag).agg(F.lit(1).alias("one"))
    return values.groupBy("key", "window").agg(F.count("one").alias("values"))


def distinct_within(
    transitions: DataFrame, tag: str, span: timedelta, hot: HotKeys = HotKeys(), slice_seconds: int = DEFAULT_SLICE_SECONDS
) -> DataFrame:
    """``key, timestamp, values`` at every time at which a key opens a value of the tag: how many distinct values it opened in
    the ``span`` that ends then (its begin not included). Any span that holds so many values is caught, not only those of
    the calendar.

    An opening covers the time up to ``span`` after it. Openings of one value that follow each other sooner cover one stretch,
    so the number of stretches that cover a time is the number of values: a running sum of their begins and ends. Openings
    without the tag or a time do not count. Hot keys are cut into time slices.
    """
    micros = span // timedelta(microseconds=1)
    opens = transitions.filter(F.col("open") & F.col(tag).isNotNull() & F.col("timestamp").isNotNull())
    rows = opens.select("key", F.col(tag).alias("_value"), F.unix_micros("timestamp").alias("_at"))
    step = F.lit(slice_seconds * 1_000_000)

    def sliced(part: DataFrame, slice_col: str | None) -> DataFrame:
        return part.withColumn(slice_col, F.floor(F.col("_at") / step).cast("long")) if slice_col else part

    def body(part: DataFrame, slice_col: str | None) -> DataFrame:
        part = sliced(part.dropDuplicates(), slice_col)
        around = [Spec("_prev", "max", F.col("_at"), "before"), Spec("_next", "min", F.col("_at"), "after")]
        part = scan(part, ["key", "_value"], ["_at"], around, slice_col, chained=True)
        begins = F.col("_prev").isNull() | (F.col("_at") - F.col("_prev") >= micros)
        ends = F.col("_next").isNull() | (F.col("_next") - F.col("_at") >= micros)
        # At one time ends come before begins, and the value stands for the order of equals.
        begin = F.struct(F.col("_at").alias("_at"), F.lit(1).alias("_kind"), begins.cast("long").alias("_change"))
        end = F.when(ends, F.struct((F.col("_at") + micros).alias("_at"), F.lit(0).alias("_kind"), F.lit(-1).cast("long").alias("_change")))
        steps = part.select("key", "_value", F.inline(F.array_compact(F.array(begin, end))))
        steps = scan(sliced(steps, slice_col), ["key"], ["_at", "_kind", "_value"], [Spec("_sum", "sum", F.col("_change"))], slice_col, chained=True)
        return steps.filter("_kind = 1").groupBy("key", "_at").agg(F.max("_sum").alias("values"))

    found = split_scan(rows, "key", hot, body, F.lit(None).cast("long"))
    return found.select("key", F.timestamp_micros("_at").alias("timestamp"), "values")


def _levels(rows: DataFrame, tag: str, slice_col: str | None) -> DataFrame:
    """``level``: opens of (key, tag value) less closes, never below zero, after each transition; ``_step``: +1 where
    the value becomes open, -1 where it stops being open."""
    part = ["key", slice_col] if slice_col else ["key"]
    order = ["timestamp", "streamid", "eventid", F.desc("open"), tag]
    base = F.col(slice_col) * F.lit(_ROWS_PER_SLICE) if slice_col else F.lit(0)
    rows = rows.repartition(*part).dropDuplicates()
    rows = rows.withColumn("_pos", (F.row_number().over(Window.partitionBy(*part).orderBy(*order)) + base).cast("long"))
    rows = rows.withColumn("_change", F.when(F.col("open"), 1).otherwise(-1).cast("long"))
    group = ["key", tag]
    rows = scan(rows, group, ["_pos"], [Spec("_sum", "sum", F.col("_change"))], slice_col)
    rows = scan(rows, group, ["_pos"], [Spec("_low", "min", F.col("_sum"), "before")], slice_col, chained=True)
    # A close that takes the running sum below its lowest point so far closed nothing; the sum is lifted by as much.
    low = F.least(F.lit(0), F.coalesce("_low", F.lit(0)))
    level = F.col("_sum") - F.least(low, F.col("_sum"))
    step = F.when(F.col("open") & (level == 1), 1).when(~F.col("open") & (level == 0) & (F.col("_sum") >= low), -1)
    return rows.withColumn("level", level).withColumn("_step", F.coalesce(step, F.lit(0)).cast("long"))


def _rows(transitions: DataFrame, state: str, tag: str) -> DataFrame:
    return transitions.filter((F.col("state") == state) & F.col(tag).isNotNull()).select(
        "key", "timestamp", "open", tag, "eventid", "streamid"
    )


def open_levels(transitions: DataFrame, state: str, tag: str, hot: HotKeys = HotKeys()) -> DataFrame:
    """Transitions of a state with ``level``, the open count of their tag value: an open adds one, a close takes one
    away, and a close without an open does nothing."""

    def body(part: DataFrame, slice_col: str | None) -> DataFrame:
        return _levels(part, tag, slice_col).select("key", "timestamp", "open", tag, "eventid", "streamid", "level")

    return split_scan(_rows(transitions, state, tag), "key", hot, body, time_slice(F.col("timestamp")))


def concurrent_tags(transitions: DataFrame, state: str, tag: str, hot: HotKeys = HotKeys()) -> DataFrame:
    """The most tag values each key had open at the same time: ``key, concurrent``."""

    def body(part: DataFrame, slice_col: str | None) -> DataFrame:
        rows = _levels(part, tag, slice_col)
        rows = scan(rows, ["key"], ["_pos"], [Spec("_open", "sum", F.col("_step"))], slice_col, chained=True)
        return rows.groupBy("key").agg(F.max("_open").alias("concurrent"))

    return split_scan(_rows(transitions, state, tag), "key", hot, body, time_slice(F.col("timestamp")))
