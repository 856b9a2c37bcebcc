"""Event references, alert texts and CSV lines, all as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrelwatch.rules import TAG_SLOTS, RuleSet

# Fixed values of the alert format.
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
EVENT_REF = "eventref"
STATE_TITLE = "Unexpected state detected"
RATE_TITLE = "Unexpectedly High Authentication Failures Rate"
RATE_TEXT = "Unexpectedly High Number of Authentication Failures during hour starting "
QUOTE_STAND_IN = "¬"


def event_ref(stream_id: Column, event_id: Column) -> Column:
    """``StreamId:EventId``; null unless both are known."""
    return F.concat(stream_id, F.lit(":"), event_id)


def ref_stream(ref: Column) -> Column:
    """What stands before the last colon: a stream id can be a path and hold colons itself."""
    return F.substr(ref, F.lit(1), F.length(ref) - F.length(ref_event(ref)) - F.lit(1))


def ref_event(ref: Column) -> Column:
    return F.substring_index(ref, ":", -1)


def iso_utc(ts: Column, pattern: str = ISO_MILLIS) -> Column:
    """ISO-8601 text in UTC whatever the session time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), pattern)


def utc_date(ts: Column) -> Column:
    """The day of an instant in UTC whatever the session time zone; what tables are partitioned by."""
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))


def iso_now() -> Column:
    return iso_utc(F.current_timestamp())


def rate_description(hour: Column) -> Column:
    return F.concat(F.lit(RATE_TEXT), hour, F.lit("."))


def rate_detail(hour: Column, count: Column, prediction: Column) -> Column:
    return F.concat(
        F.lit(RATE_TEXT),
        hour,
        F.lit(".  Expected count:"),
        prediction.cast("long").cast("string"),
        F.lit(". Actual count:"),
        count.cast("string"),
    )


def missing_description(required: Column, key: Column, state: Column) -> Column:
    return F.concat(
        F.lit("Required state "), required, F.lit(" is missing for "), key, F.lit(" while opening state "), state
    )


def props(*pairs: tuple[Column | str, Column]) -> Column:
    """``array<struct<name,value>>`` of the pairs whose value is known."""
    rows = [
        F.when(
            value.isNotNull(),
            F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("string").alias("value")),
        )
        for name, value in pairs
    ]
    return F.filter(F.array(*rows), lambda p: p.isNotNull())


def tag_props(rules: RuleSet) -> list[tuple[str, Column]]:
    return [(name, F.col(slot)) for slot, name in zip(TAG_SLOTS, rules.tag_names) if name]


def csv_field(value: Column) -> Column:
    """Quote a field where a comma, quote or line break makes it necessary."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)


def alert_line(
    time: Column, title: Column, description: Column, detail: Column, properties: Column, refs: Column
) -> Column:
    """One CSV line: four fixed fields, the name,value pairs, then one ``eventref`` pair per referenced event."""
    head = F.array(*[csv_field(F.coalesce(c, F.lit(""))) for c in (time, title, description, detail)])
    pairs = F.flatten(F.transform(properties, lambda p: F.array(csv_field(p["name"]), csv_field(p["value"]))))
    events = F.flatten(F.transform(refs, lambda r: F.array(F.lit(EVENT_REF), csv_field(r))))
    return F.concat_ws(",", head, pairs, events)


def transition_text(rules: RuleSet, is_open: Column | None = None) -> Column:
    """A transition as a sentence, for warnings."""
    is_open = F.col("open") if is_open is None else is_open
    named = [
        F.when(F.col(slot).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(slot)))
        for slot, name in zip(TAG_SLOTS, rules.tag_names)
        if name
    ]
    tags = F.concat_ws(" ", *named) if named else F.lit("")
    return F.concat(
        F.lit("Event at "),
        iso_utc(F.col("timestamp")),
        F.lit(" state of "),
        F.col("state"),
        F.when(is_open, F.lit("-open")).otherwise(F.lit("-close")),
        F.when(tags != "", F.concat(F.lit(" ("), tags, F.lit(")"))).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit(" Associated eventid "), F.col("eventid")), F.lit("")),
        F.coalesce(F.concat(F.lit(" from streamid "), F.col("streamid")), F.lit("")),
    )


def hide_quotes(expression: Column) -> Column:
    """Expression JSON with double quotes swapped for a stand-in, so that it can be carried as plain text."""
    return F.replace(expression, F.lit('"'), F.lit(QUOTE_STAND_IN))


def restore_quotes(text: Column, quote: str = '"') -> Column:
    return F.replace(text, F.lit(QUOTE_STAND_IN), F.lit(quote))
