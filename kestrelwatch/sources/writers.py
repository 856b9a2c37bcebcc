"""Writers for alerts and events. Batches are written under their id and replace what an earlier attempt left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kestrelwatch.functions.texts import iso_utc, utc_date
from kestrelwatch.operators.alerts import alert_lines
from kestrelwatch.operators.normalise import operation


def write_alert_lines(alerts: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Alerts as CSV lines. With a batch id the lines go to ``path/batch=<id>`` and a repeated batch replaces its own
    earlier lines; without one they are appended."""
    lines = alert_lines(alerts)
    if batch_id is None:
        lines.write.mode("append").text(path)
    else:
        lines.write.mode("overwrite").text(f"{path}/batch={batch_id}")


def write_alert_rows(alerts: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Alerts as a Parquet table."""
    if batch_id is None:
        alerts.write.mode("append").parquet(path)
    else:
        alerts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def fan_out(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes one batch to several places. The batch counts as done only when all
    have succeeded; otherwise all are written again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for one in writers:
                one(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def store_events(events: DataFrame, path: str) -> None:
    """Parsed events as a table that ``read_events`` searches: the event as ``json``, ``idxEventTime`` and
    ``idxDescription`` to filter by, a folder per day, sorted by time so that row groups cover short spans."""
    rows = events.select(
        "key",
        F.to_json("Event").alias("json"),
        iso_utc(F.col("timestamp")).alias("idxEventTime"),
        operation().alias("idxDescription"),
        utc_date(F.col("timestamp")).alias("date"),
    )
    rows.sortWithinPartitions("date", "idxEventTime").write.mode("append").partitionBy("date").parquet(path)


def write_messages(messages: DataFrame, servers: str, topic: str | None = None, checkpoint: str | None = None):
    """Rows of ``to_messages`` to Kafka, as a batch or, for a stream, as a started query."""
    writer = messages.writeStream if messages.isStreaming else messages.write
    writer = writer.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true")
    if topic:
        writer = writer.option("topic", topic)
    if not messages.isStreaming:
        return writer.save()
    return writer.option("checkpointLocation", checkpoint).start()


def show_stream(df: DataFrame, interval: str = "5 seconds", mode: str = "append") -> StreamingQuery:
    """Print every micro-batch to the console."""
    return df.writeStream.outputMode(mode).format("console").trigger(processingTime=interval).start()


def memory_stream(df: DataFrame, name: str, mode: str = "update") -> StreamingQuery:
    """Keep results in an in-memory table, for tests and exploration."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).start()


def run_available(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", timeout: int | None = None
) -> None:
    """Process what a stream's source holds now, then stop. How long that takes grows with the source, so there is no limit
    unless a ``timeout`` in seconds is given."""
    query = (
        df.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    finish(query, timeout)


def finish(query: StreamingQuery, timeout: int | None = None) -> None:
    """Wait until a query that processes what there is has come to its end. Its failure is raised."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream still running after {timeout} s")
