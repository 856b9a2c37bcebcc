"""Hourly rates on a stream: every alert once, and its event references from the stream's own rows.

Each micro-batch of de-duplicated events is written as it is counted, so what an alert refers to is what its count counted:

  refs/date=../batch=..   one row per event: entity, hour, reference
  hours/batch=..          the ledger: count of every hour that can still grow, and in which batch it was reported

The ledger of a batch is that of the batch before plus what arrived, so it has one row per entity and hour within ``keep`` of the
latest, however long the stream runs; only the last two are held. A batch that is repeated, or the first one after a restart,
starts from the ledger before it and writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kestrelwatch.functions.texts import event_ref, utc_date
from kestrelwatch.operators.counts import TS, weekday
from kestrelwatch.operators.normalise import dedup_events, operation
from kestrelwatch.session import folders, remove
from kestrelwatch.streaming.detector import FAILURE


@dataclass(frozen=True)
class HourLog:
    """The two tables below a shared folder. ``by``: columns of the entity whose hours are counted; none for all events."""

    spark: SparkSession
    path: str
    by: tuple[str, ...] = ()
    keep: timedelta = timedelta(days=2)

    def before(self, batch: int) -> DataFrame | None:
        """The ledger that a batch starts from."""
        known = [int(f[6:]) for f in folders(self.spark, f"{self.path}/hours") if int(f[6:]) < batch]
        return self.spark.read.parquet(f"{self.path}/hours/batch={max(known)}") if known else None

    def add(self, events: DataFrame, batch: int, score: Callable[[DataFrame], DataFrame], factor: float, floor: int) -> DataFrame:
        """Counts the events (``by``, ``timestamp``, ``streamid``, ``eventid``) of a batch and returns the hours to report: ``by``,
        ``window, day, hour, count, prediction``. Only hours that grew are judged."""
        rows = events.select(*self.by, F.date_trunc("hour", TS).alias("start"), event_ref(F.col("streamid"), F.col("eventid")).alias("eventref"))
        rows = rows.where("start is not null").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            dated = rows.withColumns({"date": utc_date(F.col("start")), "batch": F.lit(batch).cast("long")})
            dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(f"{self.path}/refs")
            hours = self._hours(rows.groupBy(*self.by, "start").agg(F.count(F.lit(1)).alias("fresh")), batch)
            kept = hours.columns
            unusual = (F.col("count") > F.col("prediction") * factor) & (F.col("count") > floor)
            now = F.col("reported").isNull() & F.col("grew") & F.coalesce(unusual, F.lit(False))
            judged = score(hours).withColumn("reported", F.when(now, F.lit(batch).cast("long")).otherwise(F.col("reported")))
            judged.select(*kept, "prediction").write.mode("overwrite").parquet(f"{self.path}/hours/batch={batch}")
        finally:
            rows.unpersist()
        for name in folders(self.spark, f"{self.path}/hours"):
            if int(name[6:]) < batch - 1:
                remove(self.spark, f"{self.path}/hours/{name}")
        found = self.spark.read.parquet(f"{self.path}/hours/batch={batch}").where(F.col("reported") == batch)
        return found.select(*self.by, "window", "day", "hour", "count", "prediction")

    def _hours(self, fresh: DataFrame, batch: int) -> DataFrame:
        """The ledger with what is fresh, without hours that did not grow and are older than ``keep`` before the latest."""
        old = self.before(batch)
        if old is None:
            both = fresh.withColumns({"known": F.lit(0).cast("long"), "reported": F.lit(None).cast("long")})
        else:
            old = old.select(*[F.col(c).alias(f"_{c}") for c in self.by], F.col("start").alias("_start"), F.col("count").alias("known"), "reported")
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*self.by, "start")])
            both = fresh.join(old, same, "full").select(*[F.coalesce(c, f"_{c}").alias(c) for c in (*self.by, "start")], "fresh", "known", "reported")
        latest = both.agg(F.max("start")).first()[0]
        if latest is not None:
            both = both.where(F.col("fresh").isNotNull() | (F.col("start") >= F.lit(latest) - F.lit(self.keep)))
        start = F.col("start")
        return both.select(
            *self.by, "start", F.struct(start.alias("start"), (start + F.expr("interval 1 hour")).alias("end")).alias("window"), weekday(start).alias("day"), F.hour(start).alias("hour"),
            (F.coalesce("fresh", F.lit(0)) + F.coalesce("known", F.lit(0))).alias("count"), F.col("fresh").isNotNull().alias("grew"), "reported",
        )

    def refs(self, found: DataFrame, batch: int | None = None) -> DataFrame:
        """``by``, ``window, eventref``: the events of the found hours, one row each, up to a batch. Only the days of these hours are
        read. Events without both ids have no reference."""
        rows = self.spark.read.parquet(f"{self.path}/refs").where("eventref is not null")
        if batch is not None:
            rows = rows.where(F.col("batch") <= batch)
        days = found.select(utc_date(F.col("window.start")).alias("date")).distinct()
        rows = rows.join(F.broadcast(days) if found.isStreaming is False and days.count() <= 1000 else days, "date", "left_semi")
        hours = found.select(*[F.col(c).alias(f"_{c}") for c in self.by], "window").distinct()
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.by], F.col("start") == F.col("window.start"))
        return rows.join(hours, same).select(*self.by, "window", "eventref")


def rate_alerts_once(
    events: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    log: HourLog,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    wanted: str = FAILURE,
    within: str = "30 minutes",
    factor: float = 2,
    floor: int = 10,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Reports an hour in the first batch in which its count is unusual, and never again, also after a restart.

    ``score`` adds ``prediction`` to rows with ``day``, ``hour`` and ``count``. Copies that arrive ``within`` of each other count once;
    ``log.keep`` must be longer than that, or an hour could be forgotten while it grows. ``sink(hours, batch)`` gets the hours to
    report; ``log.refs(hours, batch)`` has their events. Events without a time are not counted."""
    if events.sparkSession.sql(f"SELECT interval '{log.keep.total_seconds()}' second <= interval {within} + interval 1 hour").first()[0]:
        raise ValueError("hours must be kept for longer than copies can arrive apart")
    rows = dedup_events(events.filter(operation() == wanted), within).select(*log.by, TS, "streamid", "eventid")

    def step(batch: DataFrame, number: int) -> None:
        sink(log.add(batch, number, score, factor, floor), number)

    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
