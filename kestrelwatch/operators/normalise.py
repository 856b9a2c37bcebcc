"""From messages and raw feeds to events: ``key, timestamp, streamid, eventid, Event``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kestrelwatch.functions.texts import iso_utc
from kestrelwatch.operators.scan import Spec, scan

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t if isinstance(t, StructType) else StringType()) for n, t in fields.items()])


# The event format. Every leaf is a nullable string.
EVENT_SCHEMA = _struct(
    EventDetail=_struct(
        Authenticate=_struct(Action=str, Outcome=_struct(Permitted=str, Reason=str, Success=str), User=_struct(Id=str)),
        Process=_struct(Action=str, Command=str, Type=str),
        TypeId=str,
    ),
    EventId=str,
    EventSource=_struct(
        Client=_struct(HostName=str),
        Device=_struct(HostName=str),
        Generator=str,
        System=_struct(Environment=str, Name=str),
        User=_struct(Id=str),
    ),
    EventTime=_struct(TimeCreated=str),
    StreamId=str,
)


def event_struct(values: dict[str, Column], schema: StructType = EVENT_SCHEMA, prefix: str = "") -> Column:
    """A nested event from ``{"EventSource.User.Id": column, ...}``; fields not given are null. Reading a field of it
    back costs nothing: Catalyst replaces the access by the column."""
    fields = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, StructType):
            fields.append(event_struct(values, f.dataType, path + ".").alias(f.name))
        else:
            fields.append(values.get(path, F.lit(None)).cast("string").alias(f.name))
    return F.struct(*fields)


def event_time(event: str = "Event") -> Column:
    """Null, not an error, where the text is not a time."""
    return F.try_to_timestamp(F.col(f"{event}.EventTime.TimeCreated"))


def parse_messages(messages: DataFrame, schema: StructType = EVENT_SCHEMA) -> DataFrame:
    """Decode ``key``/``value`` bytes or strings and parse the JSON; on a table or a stream. Unparsable values give
    null fields. Other columns (topic, offset, ...) are dropped, except ``headers``, which becomes a map."""
    kept = [header_map(F.col("headers")).alias("headers")] if "headers" in messages.columns else []
    parsed = messages.select(
        F.col("key").cast("string").alias("key"),
        F.from_json(F.col("value").cast("string"), schema).alias("Event"),
        *kept,
    )
    return parsed.select(
        "key",
        event_time().alias("timestamp"),
        F.col("Event.StreamId").alias("streamid"),
        F.col("Event.EventId").alias("eventid"),
        "Event",
        *(["headers"] if kept else []),
    )


def header_map(headers: Column) -> Column:
    """``array<struct<key,value binary>>`` to ``map<string,string>``; of repeated keys the last one counts."""
    named = F.filter(headers, lambda h: h["key"].isNotNull())
    last = F.filter(
        F.transform(named, lambda h, i: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value"), i.alias("i"))),
        lambda h: h["i"] == F.array_max(
            F.transform(named, lambda o, j: F.when(o["key"] == h["key"], j))
        ),
    )
    return F.map_from_entries(F.transform(last, lambda h: F.struct(h["key"], h["value"])))


def operation() -> Column:
    return F.col("Event.EventDetail.TypeId")


def user() -> Column:
    """The acting user, from whichever of two places has it."""
    return F.coalesce(F.col("Event.EventSource.User.Id"), F.col("Event.EventDetail.Authenticate.User.Id"))


def to_messages(events: DataFrame, headers: dict[str, Column] | None = None, topic: Column | None = None,
                partition: Column | None = None) -> DataFrame:
    """Rows for a message sink: ``key, value`` (the event as JSON) and, where asked for, ``headers, topic, partition``.
    The event time travels in the value; the sink has no column for it."""
    out = [F.col("key").cast("string").alias("key"), F.to_json("Event").alias("value")]
    if headers:
        out.append(
            F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value")) for k, v in headers.items()])
            .alias("headers")
        )
    if topic is not None:
        out.append(topic.alias("topic"))
    if partition is not None:
        out.append(partition.cast("int").alias("partition"))
    return events.select(*out)


def number_lines(feed: DataFrame) -> DataFrame:
    """Add ``line``, the row's number in its file, to a feed read with its ``file`` and ``block`` (see ``read_feed``).

    Lines are numbered inside each file block; blocks are then offset by the rows before them, so no task sees a whole
    file."""
    return scan(
        feed.withColumn("_seq", F.monotonically_increasing_id()),
        ["file"],
        ["_seq"],
        [Spec("line", "sum", F.lit(1).cast("long"))],
        "block",
    ).drop("_seq")


def normalise_feed(feed: DataFrame, system: str, environment: Column | None = None) -> DataFrame:
    """Raw lines ``timestamp, operation, user[, device]`` with ``file`` and ``line`` to events. The file is the stream
    id, the line number the event id, the user the key."""
    device = F.col("device") if "device" in feed.columns else F.lit(None)
    op, who = F.col("operation"), F.col("user")
    is_login = op.isin("Login", "Logout", "Authentication Failure")
    values = {
        "EventDetail.TypeId": op,
        "EventDetail.Authenticate.Action": F.when(op == "Logout", "Logoff").when(is_login, "Logon"),
        "EventDetail.Authenticate.Outcome.Success": F.when(is_login, (op != "Authentication Failure").cast("string")),
        "EventDetail.Authenticate.User.Id": F.when(is_login, who),
        "EventDetail.Process.Action": F.when(op == "Process Start", "Execute"),
        "EventId": F.col("line"),
        "EventSource.Client.HostName": device,
        "EventSource.Generator": F.lit("kestrelwatch"),
        "EventSource.System.Name": F.lit(system),
        "EventSource.System.Environment": environment if environment is not None else F.lit(None),
        "EventSource.User.Id": who,
        "EventTime.TimeCreated": iso_utc(F.col("timestamp"), ISO_MICROS),
        "StreamId": F.col("file"),
    }
    return feed.select(
        who.alias("key"),
        "timestamp",
        F.col("file").alias("streamid"),
        F.col("line").cast("string").alias("eventid"),
        event_struct(values).alias("Event"),
    )


def dedup_events(events: DataFrame, within: str | None = None, spread: int = 1) -> DataFrame:
    """One event per (stream id, event id). An event without both ids cannot be told from another and is kept; it gets an
    identity of its own for the comparison, so that such events do not meet in one task either.

    A stream needs ``within``, how far apart copies can arrive, so that its state stays bounded. A table drops copies
    map-side before it shuffles; a stream cannot, so where one event may be repeated very often,
    ``spread`` first drops copies in that many places and then what is left of them in one.
    """
    ids = ["streamid", "eventid", "_own"]
    unknown = F.col("streamid").isNull() | F.col("eventid").isNull()
    events = events.withColumn("_own", F.when(unknown, F.expr("uuid()")))
    if not events.isStreaming:
        return events.dropDuplicates(ids).drop("_own")
    if within is None:
        raise ValueError("de-duplicating a stream needs the time within which copies arrive")
    rows = events.withWatermark("timestamp", within)
    if spread > 1:
        salted = rows.withColumn("_salt", F.floor(F.rand() * spread).cast("int"))
        rows = salted.dropDuplicatesWithinWatermark([*ids, "_salt"]).drop("_salt")
    return rows.dropDuplicatesWithinWatermark(ids).drop("_own")


def unusual_logins(events: DataFrame, start_hour: int = 8, end_hour: int = 18, workdays: tuple[int, ...] = (2, 3, 4, 5, 6)) -> DataFrame:
    """Logins outside office hours. ``workdays`` counts Sunday as 1."""
    ts = F.col("timestamp")
    at_work = F.dayofweek(ts).isin(*workdays) & (F.hour(ts) >= start_hour) & (F.hour(ts) < end_hour)
    return events.filter((operation() == "Login") & ~at_work)
