"""Route events to the states they open or close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelwatch.operators.state_monitor import TRANSITION_COLUMNS
from kestrelwatch.rules import TAG_SLOTS, RuleSet


def map_transitions(events: DataFrame, rules: RuleSet) -> DataFrame:
    """One row per event and matching rule, in a single pass however many rules there are; on a table or a stream.

    Rule filters and tag definitions are SQL over the columns of ``events``. A tag that a rule does not define is null,
    as are ids the rule set does not name.
    """
    cases = [(s.name, True, s.open) for s in rules.states]
    cases += [(s.name, False, s.close) for s in rules.states if s.close]
    # First everything that reads the event, as flat columns: only the fields in use are read or built, and each tag
    # definition is evaluated once however many rules share it.
    definitions = sorted({d for _, _, t in cases for d in t.tags.values()})
    fields = {d: f"_tag{i}" for i, d in enumerate(definitions)}
    event_id = F.expr(rules.event_id) if rules.event_id else F.lit(None)
    stream_id = F.expr(rules.stream_id) if rules.event_id and rules.stream_id else F.lit(None)
    flat = events.select(
        F.col("key").cast("string").alias("key"),
        "timestamp",
        event_id.cast("string").alias("eventid"),
        stream_id.cast("string").alias("streamid"),
        *[F.coalesce(F.expr(t.filter), F.lit(False)).alias(f"_rule{i}") for i, (_, _, t) in enumerate(cases)],
        *[F.expr(d).cast("string").alias(name) for d, name in fields.items()],
    )
    matched = []
    for i, (name, is_open, t) in enumerate(cases):
        tags = [
            (F.col(fields[t.tags[tag]]) if tag in t.tags else F.lit(None).cast("string")).alias(slot)
            for slot, tag in zip(TAG_SLOTS, rules.tag_names)
        ]
        row = F.struct(F.lit(name).alias("state"), F.lit(is_open).alias("open"), *tags)
        matched.append(F.when(F.col(f"_rule{i}"), row))
    # No filter before the rows are made: it would be pushed below the parsing of JSON events and parse them again.
    routed = flat.select("key", "timestamp", "eventid", "streamid", F.inline(F.array(*matched)))
    return routed.filter("state is not null").select(*TRANSITION_COLUMNS)
