"""The given tables read as security events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelwatch.functions.texts import iso_utc
from kestrelwatch.operators.normalise import ISO_MICROS, event_struct
from kestrelwatch.operators.transitions import map_transitions
from kestrelwatch.rules import RuleSet, rules_from_dict
from kestrelwatch.session import materialise, work_dir

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # With the schema given, planning needs no job that reads file footers.
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


STREAM_PARTS = 5
FILES_PER_PART = 4
ROWS_PER_FILE = 100_000


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream that arrives in time order: equal spans of time are written one after the other, and each
    becomes at least one micro-batch."""
    raw = raw_events(spark, sf_dir)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = raw.agg(F.min(micros).alias("first"), F.max(micros).alias("last")).first()
    path = work_dir(spark, "events-in-order")
    width = ((span["last"] or 0) - (span["first"] or 0)) // STREAM_PARTS + 1
    # A row without a time arrives first.
    part = F.coalesce(F.floor((micros - F.lit(span["first"] or 0)) / F.lit(width)), F.lit(0))
    files = files_per_part([r["count"] for r in raw.groupBy(part.alias("part")).count().collect()])
    for i in range(STREAM_PARTS):
        raw.where(part == i).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def files_per_part(rows: list[int]) -> int:
    """Every part has the same number of files, as a micro-batch takes so many; each is written and read by a task, so the number
    grows with the rows. A part with few rows must still fill its files, or a micro-batch would reach into the next part."""
    wanted = -(-sum(rows) // (STREAM_PARTS * ROWS_PER_FILE))
    return max(FILES_PER_PART, min(wanted, min(rows) // 1000 if len(rows) == STREAM_PARTS else 0))


def as_events(raw: DataFrame) -> DataFrame:
    """signup/view open and close the GATE, purchase/click the ledger, error is a failed ledger login. The user is
    recorded in one of two places, the domain and the device come from ``props``."""
    kind = F.col("event_type")
    who = F.concat(F.lit("User"), F.col("user_id"))
    k = F.get_json_object("props", "$.k").cast("int")
    even = F.col("event_id") % 2 == 0
    stream_id = F.date_format("ts", "yyyyMMdd")
    event_id = F.col("event_id").cast("string")
    ts = F.col("ts").cast("timestamp")
    values: dict[str, Column] = {
        "EventDetail.TypeId": F.when(kind.isin("signup", "purchase"), "Login")
        .when(kind.isin("view", "click"), "Logout")
        .when(kind == "error", "Authentication Failure"),
        "EventDetail.Authenticate.Action": F.when(kind.isin("view", "click"), "Logoff").otherwise("Logon"),
        "EventDetail.Authenticate.User.Id": F.when(~even, who),
        "EventId": event_id,
        "EventSource.Client.HostName": F.concat(F.lit("Device"), (k % 4).cast("string")),
        "EventSource.System.Name": F.when(kind.isin("signup", "view"), "GATE").otherwise("LEDGER"),
        "EventSource.System.Environment": F.concat(F.lit("Domain"), (k % 3).cast("string")),
        "EventSource.User.Id": F.when(even, who),
        "EventTime.TimeCreated": iso_utc(ts, ISO_MICROS),
        "StreamId": stream_id,
    }
    return raw.select(
        who.alias("key"),
        ts.alias("timestamp"),
        stream_id.alias("streamid"),
        event_id.alias("eventid"),
        event_struct(values).alias("Event"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(raw_events(spark, sf_dir))


def monitor_rules(strategy: str = "warn", open_tags: tuple[str, ...] = ("domain",), close_tags: tuple[str, ...] = ("domain",),
                  ledger_tags: tuple[str, ...] = ("domain",)) -> RuleSet:
    """A ledger login needs an open GATE session in the same domain."""
    definition = {"domain": "Event.EventSource.System.Environment", "device": "Event.EventSource.Client.HostName"}

    def tags(names):
        return [{"name": n, "definition": definition[n]} for n in names]

    def rule(system: str, action: str) -> str:
        return f"Event.EventSource.System.Name == '{system}' and Event.EventDetail.TypeId == '{action}'"

    return rules_from_dict(
        {
            "eventId": "Event.EventId",
            "streamId": "Event.StreamId",
            "alertingDelay": "PT6H",
            "tags": {"tag1": "domain", "tag2": "device"},
            "states": [
                {
                    "name": "ledger",
                    "maxlatency": "PT2H",
                    "open": {
                        "filter": rule("LEDGER", "Login"),
                        "timeout": "P9D",
                        "requires": ["gate"],
                        "tags": tags(ledger_tags),
                    },
                    "close": {"filter": rule("LEDGER", "Logout"), "tags": tags(close_tags)},
                },
                {
                    "name": "gate",
                    "maxlatency": "P2D",
                    "open": {"filter": rule("GATE", "Login"), "timeout": "PT8H", "tags": tags(open_tags)},
                    "close": {
                        "filter": rule("GATE", "Logout"),
                        "tags": tags(close_tags),
                        "multipleMatchStrategy": strategy,
                    },
                },
            ],
        },
        "monitor.yml",
    )


def transitions(spark: SparkSession, sf_dir: str, rules: RuleSet | None = None) -> DataFrame:
    return map_transitions(events(spark, sf_dir), rules or monitor_rules())


def stored_transitions(spark: SparkSession, sf_dir: str, rules: RuleSet) -> DataFrame:
    """The transitions as a table of their own: events are parsed and routed once, and what reads them several times
    (the profile, ordinary and hot keys, a second run) reads narrow rows."""
    return materialise(transitions(spark, sf_dir, rules), "transitions")
