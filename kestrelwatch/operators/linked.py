"""From alerts back to events, and an entity's events across feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelwatch.functions.texts import ref_event, ref_stream


def linked_events(alerts: DataFrame, events: DataFrame, extra: Column | str | None = None) -> DataFrame:
    """Every (alert, event it references), with the event's columns; ``extra`` is one more condition on the event.

    References and events meet on two plain columns; the filter on the events is applied before the join. Which side is
    broadcast, if any, is left to Spark, which knows the sizes in bytes.
    """
    refs = alerts.withColumn("_ref", F.explode("eventrefs")).select(
        *alerts.columns, ref_stream(F.col("_ref")).alias("_stream"), ref_event(F.col("_ref")).alias("_event")
    ).drop("eventrefs")
    wanted = events.filter(extra) if extra is not None else events
    joined = refs.join(wanted, (F.col("_stream") == wanted["streamid"]) & (F.col("_event") == wanted["eventid"]))
    return joined.drop("_stream", "_event")


def entity_timeline(feeds: dict[str, DataFrame], entity: str, operations: str = "Log%") -> DataFrame:
    """What an entity did in all feeds, in time order: rows in which any field but the time is the entity, and whose
    operation is like ``operations``."""
    parts = []
    for name, feed in feeds.items():
        fields = [c for c, t in feed.dtypes if t == "string" and c not in ("operation", "file")]
        mentions = reduce(lambda a, b: a | b, [F.col(c) == entity for c in fields])
        parts.append(feed.filter(mentions & F.col("operation").like(operations)).withColumn("feed", F.lit(name)))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.sort("timestamp", "feed")
