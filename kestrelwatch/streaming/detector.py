"""Streaming detection of hours with too many failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kestrelwatch.operators.alerts import rate_alerts
from kestrelwatch.operators.counts import hourly_event_refs, tumbling_counts, user_operation_counts
from kestrelwatch.operators.normalise import dedup_events, operation, user
from kestrelwatch.operators.outliers import outliers, predict

# Fixed value: the event kind the detector counts.
FAILURE = "Authentication Failure"


def failure_counts(
    events: DataFrame, wanted: str = FAILURE, within: str = "30 minutes", spread: int = 1
) -> DataFrame:
    """Failures per hour. The kind is filtered first, so only failures reach the de-duplication state; both states are
    dropped once the watermark has passed them. ``spread``: see ``dedup_events``."""
    failures = events.filter(operation() == wanted)
    return tumbling_counts(dedup_events(failures, within, spread))


def event_refs_of(found: DataFrame, events: DataFrame, wanted: str = FAILURE) -> DataFrame:
    """``window, eventref``: one row per failure of the found hours, looked up in stored events. Only the time between the
    first and the last of these hours is read; one row with these bounds is what the driver sees."""
    start, end = F.min("window.start"), F.max("window.end")
    span = found.agg(F.unix_micros(start).alias("start"), F.unix_micros(end).alias("end")).first()
    ts = F.col("timestamp")
    between = (ts >= F.timestamp_micros(F.lit(span["start"]))) & (ts < F.timestamp_micros(F.lit(span["end"])))
    failures = events.filter(between if span["start"] is not None else F.lit(False)).filter(operation() == wanted)
    refs = hourly_event_refs(failures.select("timestamp", "streamid", "eventid"))
    return refs.join(found.select("window").distinct(), "window", "left_semi")


def with_event_refs(found: DataFrame, events: DataFrame, wanted: str = FAILURE) -> DataFrame:
    """The found hours, one row each, with ``eventref``: all references of their failures, as an alert line lists them. Where
    an hour can have more failures than a line should hold, write ``event_refs_of`` as a table beside the alerts."""
    refs = event_refs_of(found, events, wanted).groupBy("window").agg(F.sort_array(F.collect_list("eventref")).alias("eventref"))
    return found.join(refs, "window", "left").withColumn("eventref", F.coalesce("eventref", F.array().cast("array<string>")))


def detect(scored: DataFrame, events: DataFrame | None = None, factor: float = 2, floor: int = 10) -> DataFrame:
    """One alert for every outlier among scored hours, with event references if ``events`` (a table) is given."""
    found = outliers(scored, factor, floor)
    return rate_alerts(with_event_refs(found, events) if events is not None else found)


def detect_stream(
    events: DataFrame,
    features,
    model,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    stored: DataFrame | None = None,
    mode: str = "update",
    within: str = "30 minutes",
    factor: float = 2,
    floor: int = 10,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score hourly counts of a stream and hand alerts to ``sink`` batch by batch.

    ``update`` reports an hour while it still grows, so the same hour can alert again (see ``dedup_alerts``); ``append``
    reports it once, after the watermark. ``stored`` is the table that mirrors the stream, for event references.
    """
    scored = predict(failure_counts(events, within=within), features, model)

    def step(batch: DataFrame, batch_id: int) -> None:
        sink(detect(batch, stored, factor, floor), batch_id)

    writer = scored.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def user_operations(events: DataFrame, view: str = "userops", within: str = "30 minutes") -> DataFrame:
    """Running counts per user and operation by SQL over a view; on a table or a stream."""
    rows = events.select("timestamp", "streamid", "eventid", user().alias("user"), operation().alias("operation"))
    dedup_events(rows, within if events.isStreaming else None).createOrReplaceTempView(view)
    return events.sparkSession.sql(user_operation_counts(view))
