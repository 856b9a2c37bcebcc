"""The registered queries. Each takes (spark, sf_dir) and returns a DataFrame over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelwatch.functions import texts
from kestrelwatch.operators import alerts as al
from kestrelwatch.operators import counts, linked, normalise, outliers, replay, scoring, tags
from kestrelwatch.operators import state_monitor as sm
from kestrelwatch.operators.scan import hot_keys
from kestrelwatch.plans import sql as S
from kestrelwatch.plans import tables
from kestrelwatch.session import materialise, work_dir
from kestrelwatch.sources.readers import read_events, read_feed
from kestrelwatch.sources.schema import discover_schema
from kestrelwatch.sources.writers import finish, run_available, store_events
from kestrelwatch.streaming import detector, keyed, monitor, rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AS_OF = "2024-01-31T00:00:00Z"
FAILURE = detector.FAILURE


def query(statement: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return register


def _failures(spark: SparkSession, sf: str) -> DataFrame:
    return tables.events(spark, sf).filter(normalise.operation() == FAILURE)


def _flat(df: DataFrame) -> DataFrame:
    """``window`` as two columns."""
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


# --------------------------------------------------------------------------------------------------- counts, windows
@query("SELECT date_trunc('hour', ts) AS date, count(*) AS count FROM events GROUP BY 1")
def hourly_counts(spark, sf):
    return counts.counts_per_hour(tables.events(spark, sf))


@query(f"WITH {S.FAIL} SELECT operation, date_trunc('hour', ts) AS date, count(*) AS count FROM fail GROUP BY ALL")
def failure_counts(spark, sf):
    return counts.operation_counts_per_hour(tables.events(spark, sf), FAILURE)


@query(f"""WITH {S.EV} SELECT date_trunc('day', ts) AS date, dayname(ts) AS day, CAST(hour(ts) AS INTEGER) AS hour,
operation, count(*) AS count FROM ev GROUP BY ALL""")
def training_counts(spark, sf):
    return counts.training_counts(tables.events(spark, sf))


@query(f"""WITH {S.FAIL} SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
dayname(ts) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count FROM fail GROUP BY ALL""")
def tumbling_failures(spark, sf):
    return _flat(counts.tumbling_counts(normalise.dedup_events(_failures(spark, sf))))


@query(f"""WITH {S.FAIL} SELECT date_trunc('hour', ts) AS window_start, dayname(ts) AS day, CAST(hour(ts) AS INTEGER) AS hour,
count(DISTINCT event_id) AS count,
array_to_string(list_sort(list(DISTINCT streamid || ':' || eventid)), ' ') AS eventref FROM fail GROUP BY ALL""")
def failure_eventrefs(spark, sf):
    refs = counts.hourly_event_refs(_failures(spark, sf))
    lists = refs.groupBy("window").agg(F.array_join(F.sort_array(F.collect_list("eventref")), " ").alias("eventref"))
    return counts.hourly_ref_counts(refs).join(lists, "window").select(
        F.col("window.start").alias("window_start"), "day", "hour", "count", "eventref"
    )


@query(f"""WITH {S.FAIL} SELECT DISTINCT date_trunc('hour', ts) AS window_start, streamid || ':' || eventid AS eventref FROM fail""")
def failure_refs(spark, sf):
    """The child table of hourly counts: one row per hour and event."""
    return counts.hourly_event_refs(_failures(spark, sf)).select(F.col("window.start").alias("window_start"), "eventref")


@query(f"""WITH {S.FAIL}, w AS (
  SELECT unnest(range(6)) AS i, time_bucket(INTERVAL 10 MINUTE, ts) AS last FROM fail)
SELECT last - i * INTERVAL 10 MINUTE AS window_start, last - i * INTERVAL 10 MINUTE + INTERVAL 1 HOUR AS window_end,
count(*) AS count FROM w GROUP BY ALL""")
def sliding_failures(spark, sf):
    return _flat(counts.sliding_counts(_failures(spark, sf)))


@query(f"""WITH {S.EV}, s AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS second FROM ev)
SELECT key, ts AS happened_at, eventid, count(*) OVER (
  PARTITION BY key ORDER BY second RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS rolling FROM s""")
def rolling_hour_counts(spark, sf):
    rows = tables.events(spark, sf).select("key", "timestamp", "eventid")
    return counts.with_rolling_count(rows, ["key"]).withColumnRenamed("timestamp", "happened_at")


@query(f"""WITH {S.EV}, s AS (SELECT key, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS events FROM ev GROUP BY ALL)
SELECT *, CAST(sum(events) OVER (PARTITION BY key ORDER BY second RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling FROM s""")
def rolling_day_counts_sliced(spark, sf):
    """Slices as short as the frame: every row is in two of them."""
    return counts.rolling_counts(tables.events(spark, sf).select("key", "timestamp"), ["key"], 86_400, 86_400)


USER_OPERATIONS = f"""WITH {S.EV} SELECT key AS user, operation,
count(*) FILTER (streamid IS NOT NULL AND eventid IS NOT NULL) AS events FROM ev GROUP BY ALL"""


@query(USER_OPERATIONS)
def user_operation_counts(spark, sf):
    return detector.user_operations(tables.events(spark, sf))


@query("SELECT count(*) AS events FROM events")
def event_count(spark, sf):
    return tables.events(spark, sf).agg(F.count(F.lit(1)).alias("events"))


def _feeds(spark, sf):
    raw = tables.raw_events(spark, sf)
    return raw.select(
        F.when(F.col("event_type").isin("signup", "view"), "GATE").otherwise("LEDGER").alias("feed"),
        F.col("event_id").alias("line"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


OLDEST = f"""firsts AS (SELECT system, arg_min(ts, event_id) AS ts FROM ev GROUP BY 1),
start AS (SELECT min(ts) - INTERVAL 10 SECOND AS oldest FROM firsts)"""


@query(f"WITH {S.EV}, {OLDEST} SELECT oldest FROM start")
def oldest_event(spark, sf):
    return counts.oldest_event(_feeds(spark, sf))


# ------------------------------------------------------------------------------------------ events and normalisation
@query("SELECT DISTINCT event_id, ts AS happened_at, event_type FROM events")
def deduped_events(spark, sf):
    raw = tables.raw_events(spark, sf)
    twice = tables.as_events(raw.unionAll(raw)).withColumn("kind", normalise.operation())
    once = normalise.dedup_events(twice)
    system, kind = F.col("Event.EventSource.System.Name"), F.col("kind")
    event_type = (
        F.when(kind == FAILURE, "error")
        .when(system == "GATE", F.when(kind == "Login", "signup").otherwise("view"))
        .otherwise(F.when(kind == "Login", "purchase").otherwise("click"))
    )
    return once.select(
        F.col("eventid").cast("long").alias("event_id"), F.col("timestamp").alias("happened_at"), event_type.alias("event_type")
    )


NORMALISED = f"""WITH {S.EV} SELECT key, ts AS happened_at, streamid, eventid, operation, system, domain, device, key AS user
FROM ev"""


def _columns(events: DataFrame) -> DataFrame:
    return events.select(
        "key",
        F.col("timestamp").alias("happened_at"),
        "streamid",
        "eventid",
        normalise.operation().alias("operation"),
        F.col("Event.EventSource.System.Name").alias("system"),
        F.col("Event.EventSource.System.Environment").alias("domain"),
        F.col("Event.EventSource.Client.HostName").alias("device"),
        normalise.user().alias("user"),
    )


@query(NORMALISED)
def normalised_events(spark, sf):
    return _columns(tables.events(spark, sf))


@query(NORMALISED)
def json_roundtrip(spark, sf):
    messages = normalise.to_messages(tables.events(spark, sf))
    return _columns(normalise.parse_messages(messages, discover_schema(messages, "value")))


@query(f"""WITH {S.EV} SELECT key, date_trunc('millisecond', ts) AS happened_at, operation, system, device, CAST(1 AS BIGINT) AS rows_of_id
FROM ev""")
def feed_roundtrip(spark, sf):
    """The events as raw feed files of equal names in two folders, read, numbered and normalised again."""
    path = work_dir(spark, "feeds")
    rows = tables.events(spark, sf).select(
        F.col("Event.EventSource.System.Name").alias("system"),
        F.concat_ws(", ", texts.iso_utc(F.col("timestamp")), normalise.operation(), "key", "Event.EventSource.Client.HostName").alias("value"),
    )
    found = []
    for system in ("GATE", "LEDGER"):
        rows.where(F.col("system") == system).select("value").write.text(f"{path}/{system}")
        feed = normalise.number_lines(read_feed(spark, f"{path}/{system}", ("user", "device")))
        found.append(normalise.normalise_feed(feed, system))
    both = found[0].unionByName(found[1])
    ids = both.groupBy("streamid", "eventid").agg(F.count(F.lit(1)).alias("rows_of_id"))
    return both.join(ids, ["streamid", "eventid"]).select(
        "key",
        F.col("timestamp").alias("happened_at"),
        normalise.operation().alias("operation"),
        F.col("Event.EventSource.System.Name").alias("system"),
        F.col("Event.EventSource.Client.HostName").alias("device"),
        "rows_of_id",
    )


@query(f"WITH {S.EV} SELECT eventid, system AS idx_system, operation AS idx_description FROM ev")
def message_headers(spark, sf):
    events = tables.events(spark, sf)
    headers = {"idxSystem": F.col("Event.EventSource.System.Name"), "idxDescription": normalise.operation()}
    parsed = normalise.parse_messages(normalise.to_messages(events, headers))
    return parsed.select(
        "eventid", F.col("headers")["idxSystem"].alias("idx_system"), F.col("headers")["idxDescription"].alias("idx_description")
    )


@query(f"""WITH {S.EV} SELECT key, ts AS happened_at, streamid || ':' || eventid AS eventref FROM ev
WHERE operation = 'Login' AND NOT (dayofweek(ts) BETWEEN 1 AND 5 AND hour(ts) >= 8 AND hour(ts) < 18)""")
def unusual_logins(spark, sf):
    found = normalise.unusual_logins(tables.events(spark, sf))
    ref = texts.event_ref(F.col("streamid"), F.col("eventid")).alias("eventref")
    return found.select("key", F.col("timestamp").alias("happened_at"), ref)


@query(f"""WITH {S.FAIL}, t AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0')
  || 'Z' AS "idxEventTime", operation AS "idxDescription", eventid FROM fail)
SELECT * FROM t WHERE "idxEventTime" > '2024-01-08T00:00:00.000Z' AND "idxEventTime" < '2024-01-24T00:00:00.000Z'
ORDER BY "idxEventTime", eventid LIMIT 300""")
def range_scan_capped(spark, sf):
    path = work_dir(spark, "stored-events")
    store_events(tables.events(spark, sf), path)
    event_id = F.get_json_object("json", "$.EventId")
    found = read_events(spark, path, "2024-01-08T00:00:00.000Z", "2024-01-24T00:00:00.000Z", FAILURE, 300, ties=[event_id])
    return found.select("idxEventTime", "idxDescription", event_id.alias("eventid"))


@query(f"""WITH {S.tr("device")} SELECT key, ts AS happened_at, state, open, tag1, tag2, eventid, streamid FROM tr""")
def transitions(spark, sf):
    rows = tables.transitions(spark, sf, tables.monitor_rules(open_tags=("domain", "device"), ledger_tags=("domain", "device")))
    return rows.drop("tag3").withColumnRenamed("timestamp", "happened_at")


# ------------------------------------------------------------------------------------------------------ state monitor
def _opened(found: DataFrame) -> DataFrame:
    return found.drop("tag3").withColumnRenamed("timestamp", "opened_at")


def _missing(spark, sf, rules):
    return sm.state_monitor(tables.stored_transitions(spark, sf, rules), rules, AS_OF)


@query(S.MISSING_CLOSE)
def state_missing_close_strategy(spark, sf):
    return _opened(_missing(spark, sf, tables.monitor_rules("close")))


@query(S.missing(S.tr() + S.POP_LEVELS, S.NOTHING_OPEN_POP))
def state_missing_pop(spark, sf):
    return _opened(_missing(spark, sf, tables.monitor_rules("pop")))


@query(S.missing(S.tr("device") + S.POP_PARTIAL, S.NOTHING_OPEN_POP_PARTIAL))
def state_missing_pop_partial_tags(spark, sf):
    both = ("domain", "device")
    return _opened(_missing(spark, sf, tables.monitor_rules("pop", both, ("domain",), both)))


@query(S.missing(S.tr() + S.WARN_SPANS, S.NOTHING_OPEN_WARN))
def state_missing_warn(spark, sf):
    return _opened(_missing(spark, sf, tables.monitor_rules("warn")))


def _mixed(spark, sf, strategy: str) -> DataFrame:
    """Closes name the device only where its number is even."""
    rules = tables.monitor_rules(strategy, ("domain", "device"), ("domain", "device"), ("domain", "device"))
    odd = ~F.col("open") & F.col("tag2").isin("Device1", "Device3")
    rows = materialise(tables.transitions(spark, sf, rules).withColumn("tag2", F.when(~odd, F.col("tag2"))), "mixed")
    return _opened(sm.state_monitor(rows, rules, AS_OF))


def _mixed_sql(strategy: str) -> str:
    named = "CASE WHEN device IN ('Device0', 'Device2') THEN device END"
    return S.missing(S.tr("device", named) + S.mixed(strategy), S.NOTHING_OPEN_MIXED).replace("WITH", "WITH RECURSIVE", 1)


@query(_mixed_sql("warn"))
def state_missing_warn_mixed_tags(spark, sf):
    return _mixed(spark, sf, "warn")


@query(_mixed_sql("pop"))
def state_missing_pop_mixed_tags(spark, sf):
    return _mixed(spark, sf, "pop")


@query(S.missing(S.tr() + S.WARN_SPANS, S.NOTHING_OPEN_WARN))
def state_missing_warn_sliced(spark, sf):
    """Every key with more than ten transitions is cut into slices of an hour."""
    rules = tables.monitor_rules("warn")
    rows = tables.stored_transitions(spark, sf, rules)
    return _opened(sm.state_monitor(rows, rules, AS_OF, profile=sm.profile_transitions(rows, rules, 10, 3600)))


@query(f"""WITH {S.tr()} {S.WARN_SPANS},
ambiguous AS (
  SELECT c.*, c.opens - k.nth + 2 AS ambiguous_opens,
         row_number() OVER (PARTITION BY c.key ORDER BY c.ts, c.event_id) AS nr
  FROM seen c JOIN stuck k USING (key, state, tag1) WHERE NOT c.open AND c.ts > k.since)
SELECT key, state, ts AS closed_at, tag1, eventid, streamid, ambiguous_opens,
  'Event at ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z state of '
  || state || '-close (domain: ' || tag1 || ') Associated eventid ' || eventid || ' from streamid ' || streamid AS message
FROM ambiguous WHERE nr = 1""")
def state_warnings(spark, sf):
    rules = tables.monitor_rules("warn")
    found = sm.state_warnings(tables.stored_transitions(spark, sf, rules), rules, AS_OF)
    message = texts.transition_text(rules, F.lit(False)).alias("message")
    return found.select(
        "key", "state", F.col("timestamp").alias("closed_at"), "tag1", "eventid", "streamid", "ambiguous_opens", message
    )


@query(f"""WITH {S.tr()} {S.WARN_SPANS},
ambiguous AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.key ORDER BY c.ts, c.event_id) AS nr
  FROM seen c JOIN stuck k USING (key, state, tag1) WHERE NOT c.open AND c.ts > k.since),
ranked AS (SELECT o.*, a.ts AS closed, k.nth FROM ambiguous a JOIN seen o USING (key, state, tag1)
  JOIN stuck k USING (key, state, tag1) WHERE a.nr = 1 AND o.open AND o.ts < a.ts)
SELECT key, ts AS opened_at, state, tag1, eventid, streamid FROM ranked WHERE opens >= nth - 1""")
def state_warning_opens(spark, sf):
    rules = tables.monitor_rules("warn")
    found = sm.ambiguous_opens(tables.stored_transitions(spark, sf, rules), rules, AS_OF)
    return _opened(found).drop("tag2")


def _judged(as_of: str) -> str:
    return f"""SELECT o.* FROM tr o WHERE o.state = 'ledger' AND o.open AND o.ts + INTERVAL 2 DAY < {as_of}
  AND {S.NOTHING_OPEN_CLOSE}"""


@query(f"""WITH {S.tr()},
later AS ({_judged("TIMESTAMP '2024-01-28 12:00:00'")}),
earlier AS ({_judged("TIMESTAMP '2024-01-20 12:00:00'")})
SELECT key, ts AS opened_at, tag1, eventid, streamid, 'gate' AS required_state,
  TIMESTAMP '2024-01-28 12:00:00' <= ts + INTERVAL 9 DAY AND TIMESTAMP '2024-01-20 12:00:00' <= ts + INTERVAL 2 DAY AS emitted
FROM later WHERE event_id NOT IN (SELECT event_id FROM earlier)""")
def state_judged_second_run(spark, sf):
    rules = tables.monitor_rules("close")
    rows = tables.stored_transitions(spark, sf, rules)
    first, second = "2024-01-20T12:00:00Z", "2024-01-28T12:00:00Z"
    found = sm.judge(rows, rules, second, last_run=first, judged_before=sm.judge(rows, rules, first))
    return _opened(found).drop("state", "tag2")


@query(f"""WITH {S.tr()}, last AS (
  SELECT key, arg_max(CASE WHEN open THEN state ELSE '-' END, (ts, event_id)) AS state FROM tr GROUP BY key)
SELECT state, count(*) AS keys FROM last GROUP BY state""")
def state_occupancy(spark, sf):
    return counts.state_occupancy(tables.transitions(spark, sf))


@query(f"""WITH {S.tr()}, v AS (
  SELECT key, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(DISTINCT tag1) AS values FROM tr WHERE open GROUP BY ALL)
SELECT * FROM v WHERE values > 2""")
def tag_distinct_limit(spark, sf):
    found = tags.distinct_tags(tables.transitions(spark, sf), "tag1", "1 day")
    return found.filter("values > 2").select("key", F.col("window.start").alias("window_start"), "values")


@query(f"""WITH {S.tr()}, moment AS (SELECT DISTINCT key, ts FROM tr WHERE open)
SELECT a.key, a.ts AS happened_at, count(DISTINCT r.tag1) AS values FROM moment a JOIN tr r ON r.key = a.key AND r.open
  AND r.ts > a.ts - INTERVAL 36 HOUR AND r.ts <= a.ts GROUP BY ALL HAVING count(DISTINCT r.tag1) > 2""")
def tag_distinct_any_span(spark, sf):
    rows = tables.stored_transitions(spark, sf, tables.monitor_rules())
    found = tags.distinct_within(rows, "tag1", timedelta(hours=36), hot_keys(rows, "key"))
    return found.filter("values > 2").withColumnRenamed("timestamp", "happened_at")


LEVELS = """,
sums AS (SELECT *, sum(CASE WHEN open THEN 1 ELSE -1 END) OVER (PARTITION BY key, tag1 ORDER BY ts, event_id) AS s
  FROM tr WHERE state = 'gate'),
levels AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY key, tag1 ORDER BY ts, event_id)) AS level FROM sums)"""


@query(f"""WITH {S.tr()} {LEVELS}
SELECT key, ts AS happened_at, open, tag1, eventid, streamid, CAST(level AS BIGINT) AS level FROM levels""")
def tag_open_levels(spark, sf):
    rows = tables.stored_transitions(spark, sf, tables.monitor_rules())
    found = tags.open_levels(rows, "gate", "tag1", hot_keys(rows, "key"))
    return found.withColumnRenamed("timestamp", "happened_at")


@query(f"""WITH {S.tr()} {LEVELS},
changes AS (SELECT *, CAST(level > 0 AS INTEGER)
  - CAST(coalesce(lag(level) OVER (PARTITION BY key, tag1 ORDER BY ts, event_id), 0) > 0 AS INTEGER) AS d FROM levels),
now AS (SELECT key, sum(d) OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM changes)
SELECT key, CAST(max(n) AS BIGINT) AS concurrent FROM now GROUP BY key""")
def tag_concurrency(spark, sf):
    rows = tables.stored_transitions(spark, sf, tables.monitor_rules())
    return tags.concurrent_tags(rows, "gate", "tag1", hot_keys(rows, "key"))


# ------------------------------------------------------------------------------------------- alerts, linking, scoring
def _state_alerts(spark, sf) -> DataFrame:
    rules = tables.monitor_rules("close")
    found = _missing(spark, sf, rules)
    return al.state_alerts(found, rules, F.lit(AS_OF).cast("timestamp"))


@query(f"""WITH m AS ({S.MISSING_CLOSE}) SELECT '2024-01-31T00:00:00.000Z,Unexpected state detected,Required state gate is missing for '
|| key || ' while opening state ledger,,analytic,StateMonitor,config,monitor.yml,key,' || key
|| ',state,ledger,requiredState,gate,domain,' || tag1 || ',eventref,' || streamid || ':' || eventid AS value FROM m""")
def alert_lines(spark, sf):
    return al.alert_lines(_state_alerts(spark, sf))


@query(f"""WITH m AS ({S.MISSING_CLOSE}), {S.EV}
SELECT m.streamid || ':' || m.eventid AS eventref, ev.key, ev.ts AS happened_at, ev.operation, ev.device
FROM m JOIN ev ON ev.streamid = m.streamid AND ev.eventid = m.eventid WHERE ev.domain = 'Domain1'""")
def linked_events(spark, sf):
    found = linked.linked_events(
        _state_alerts(spark, sf).select("title", "eventrefs"),
        tables.events(spark, sf),
        "Event.EventSource.System.Environment = 'Domain1'",
    )
    return found.select(
        texts.event_ref(F.col("streamid"), F.col("eventid")).alias("eventref"),
        "key",
        F.col("timestamp").alias("happened_at"),
        normalise.operation().alias("operation"),
        F.col("Event.EventSource.Client.HostName").alias("device"),
    )


@query(f"""WITH m AS ({S.MISSING_CLOSE}), {S.EV},
truth AS (SELECT key, ts FROM ev WHERE operation = 'Authentication Failure'),
a AS (SELECT EXISTS (SELECT 1 FROM truth t WHERE t.key = m.key AND abs(date_diff('microsecond', t.ts, m.opened_at)) <= 21600000000) AS hit FROM m),
t AS (SELECT EXISTS (SELECT 1 FROM m WHERE truth.key = m.key AND abs(date_diff('microsecond', truth.ts, m.opened_at)) <= 21600000000) AS hit FROM truth)
SELECT tp AS true_positives, fp AS false_positives, ok AS found, fn AS missed,
  tp / (tp + fp) AS precision, ok / (ok + fn) AS recall
FROM (SELECT count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp FROM a),
     (SELECT count(*) FILTER (hit) AS ok, count(*) FILTER (NOT hit) AS fn FROM t)""")
def alert_score(spark, sf):
    found = _missing(spark, sf, tables.monitor_rules("close")).select(F.col("key").alias("entity"), "timestamp")
    found = materialise(found, "found")  # scoring reads the alerts twice
    raw = tables.raw_events(spark, sf).filter("event_type = 'error'")
    truth = tables.as_events(raw).select(F.col("key").alias("entity"), "timestamp")
    return scoring.score_alerts(found, truth, timedelta(hours=6))


@query(f"""WITH {S.FAIL}, w AS (
  SELECT unnest(range(6)) AS i, time_bucket(INTERVAL 10 MINUTE, ts) AS last FROM fail),
c AS (SELECT last - i * INTERVAL 10 MINUTE AS window_start, count(*) AS count FROM w GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', window_start) ORDER BY window_start) AS nr FROM c WHERE count > 5)
SELECT 'Unexpectedly High Authentication Failures Rate' AS title, window_start, count FROM f WHERE nr = 1""")
def dedup_alerts(spark, sf):
    busy = counts.sliding_counts(_failures(spark, sf)).filter("count > 5")
    found = busy.select(F.lit(texts.RATE_TITLE).alias("title"), F.col("window.start").alias("window_start"), "count")
    return al.dedup_alerts(found, ["title"], "window_start")


@query(f"""WITH {S.EV} SELECT ts AS happened_at, operation, device, system AS feed FROM ev
WHERE key = 'User8' AND operation LIKE 'Log%'""")
def entity_timeline(spark, sf):
    rows = tables.events(spark, sf).select(
        "timestamp",
        normalise.operation().alias("operation"),
        normalise.user().alias("user"),
        F.col("Event.EventSource.Client.HostName").alias("device"),
        F.col("Event.EventSource.System.Name").alias("system"),
    )
    feeds = {name: rows.filter(F.col("system") == name).drop("system") for name in ("GATE", "LEDGER")}
    found = linked.entity_timeline(feeds, "User8")
    return found.select(F.col("timestamp").alias("happened_at"), "operation", "device", "feed")


# -------------------------------------------------------------------------------------------------------------- replay
@query(f"""WITH {S.EV}, {OLDEST},
o AS (SELECT system AS feed, event_id AS line, (epoch_us(ts) // 1000 - epoch_us(oldest) // 1000) * 60 // 3600 AS off FROM ev, start)
SELECT feed, line, epoch_ms(CAST(epoch_ms(TIMESTAMP '2030-01-01') + off AS BIGINT)) AS replay_time,
  CAST(max(greatest(1, ceil(off / 60000.0))) OVER (PARTITION BY feed ORDER BY line) AS BIGINT) AS batch FROM o""")
def accelerated_batches(spark, sf):
    feeds = _feeds(spark, sf)
    oldest = counts.oldest_event(feeds).select(F.unix_micros("oldest").alias("at")).first()["at"]
    start = datetime(1970, 1, 1) + timedelta(microseconds=oldest)
    return replay.accelerate(feeds, 60, datetime(2030, 1, 1), start).drop("timestamp")


# ------------------------------------------------------------------------------------------------------------ outliers
@query(f"""WITH {S.FAIL}, h AS (
  SELECT date_trunc('hour', ts) AS window_start, dayname(ts) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count,
         array_to_string(list_sort(list(streamid || ':' || eventid)), ' ') AS eventref FROM fail GROUP BY ALL),
m AS (SELECT *, avg(count) OVER (PARTITION BY day, hour) AS prediction FROM h)
SELECT window_start, count, round(prediction, 6) AS prediction, eventref FROM m WHERE count > prediction * 1.5 AND count > 5""")
def failure_outliers_baseline(spark, sf):
    failures = _failures(spark, sf)
    hourly = counts.tumbling_counts(normalise.dedup_events(failures))
    found = outliers.outliers(outliers.predict_mean(hourly, outliers.mean_per_hour_of_week(hourly)), 1.5, 5)
    named = detector.with_event_refs(found, failures)
    return named.select(
        F.col("window.start").alias("window_start"),
        "count",
        F.round("prediction", 6).alias("prediction"),
        F.array_join(F.array_sort("eventref"), " ").alias("eventref"),
    )


def _trained(spark, sf, kind):
    hourly = counts.tumbling_counts(normalise.dedup_events(_failures(spark, sf)))
    features, model = outliers.train(hourly, kind, invalid="keep")
    path = work_dir(spark, "models")
    outliers.save_models(features, model, path)
    return hourly, *outliers.load_models(path, kind)


HOURS = f"""{S.FAIL}, h AS (
  SELECT date_trunc('hour', ts) AS window_start, dayname(ts) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count,
         string_agg(',eventref,' || streamid || ':' || eventid, '' ORDER BY streamid || ':' || eventid) AS refs FROM fail GROUP BY ALL)"""


@query(f"""WITH {HOURS},
d AS (SELECT day, row_number() OVER (ORDER BY count(*) DESC, day) - 1 AS place FROM h GROUP BY day)
SELECT window_start, count, array_to_string(list_concat(
  list_transform(range((SELECT max(hour) FROM h)), lambda i: CAST(hour = i AS INTEGER)),
  list_transform(range((SELECT count(*) - 1 FROM d)), lambda i: CAST(place = i AS INTEGER))), ' ') AS features
FROM h JOIN d USING (day)""")
def feature_rows(spark, sf):
    """One-hot hour, then one-hot weekday numbered by falling frequency; the last of each is all zeros."""
    hourly = counts.tumbling_counts(normalise.dedup_events(_failures(spark, sf)))
    found = outliers.add_features(hourly, outliers.fit_features(hourly))
    numbers = F.transform(vector_to_array("features"), lambda x: x.cast("int").cast("string"))
    return found.select(F.col("window.start").alias("window_start"), "count", F.array_join(numbers, " ").alias("features"))


@query(f"""WITH {HOURS}
SELECT 'hour' AS part, CAST(hour AS VARCHAR) AS value, count(*) AS rows, round(avg(count), 6) AS mean FROM h GROUP BY hour
UNION ALL SELECT 'day', day, count(*), round(avg(count), 6) FROM h GROUP BY day""")
def linear_fit_moments(spark, sf):
    """A least-squares fit on one-hot columns predicts, on average, what was observed: for every hour and every weekday. These
    conditions determine the fit."""
    hourly = counts.tumbling_counts(normalise.dedup_events(_failures(spark, sf)))
    scored = materialise(outliers.predict(hourly, *outliers.train(hourly, "linear", reg_param=0.0)), "scored")
    mean = F.round(F.avg("prediction") + F.lit(0.0), 6).alias("mean")
    parts = [scored.groupBy(F.lit(p).alias("part"), F.col(p).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"), mean) for p in ("hour", "day")]
    return parts[0].unionByName(parts[1])


RATE_TEXT = "Unexpectedly High Number of Authentication Failures during hour starting "


@query(f"""WITH {HOURS}, m AS (SELECT *, avg(count) OVER (PARTITION BY day, hour) AS prediction, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS t FROM h)
SELECT '2024-01-31T00:00:00.000Z,Unexpectedly High Authentication Failures Rate,{RATE_TEXT}' || t || '.,{RATE_TEXT}' || t
  || '.  Expected count:' || CAST(floor(prediction) AS BIGINT) || '. Actual count:' || count || ',hour,' || t || ',count,' || count
  || ',prediction,' || prediction || refs AS value FROM m WHERE count > prediction * 1.5 AND count > 5""")
def rate_alert_lines(spark, sf):
    """The detector's alert lines, with the mean of the hour of the week in place of a trained model."""
    hourly = counts.tumbling_counts(normalise.dedup_events(_failures(spark, sf)))
    scored = outliers.predict_mean(hourly, outliers.mean_per_hour_of_week(hourly))
    found = outliers.outliers(scored, 1.5, 5)
    return al.alert_lines(al.rate_alerts(detector.with_event_refs(found, tables.events(spark, sf)), F.lit(AS_OF).cast("timestamp")))


@query()
def failure_outliers_ml(spark, sf):
    """The deployed detector: logistic regression on the hour and weekday."""
    hourly, features, model = _trained(spark, sf, "logistic")
    scored = outliers.predict(hourly, features, model)
    return al.alert_lines(detector.detect(scored, tables.events(spark, sf), 1, 5)).withColumn(
        "value", F.regexp_replace("value", "^[^,]*", "")
    )


def _fit(kind):
    def run(spark, sf):
        hourly, features, model = _trained(spark, sf, kind)
        return outliers.errors(hourly, features, model).select(
            "rows", F.round("mean_absolute_error", 3).alias("mean_absolute_error"),
            F.round("root_mean_squared_error", 3).alias("root_mean_squared_error"),
        )

    return run


QUERIES["linear_fit"] = _fit("linear")
QUERIES["logistic_fit"] = _fit("logistic")
QUERIES["forest_fit"] = _fit("forest")


# ----------------------------------------------------------------------------------------------------------- streaming
def _stream(spark, sf) -> DataFrame:
    return tables.as_events(tables.stream_events(spark, sf))


def _latest(spark, stream: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Run a stream in update mode over what its source holds; the last value reported for each key."""
    out = work_dir(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    run_available(stream, write, f"{out}/checkpoint", "update")
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


@query(USER_OPERATIONS)
def stream_user_operation_counts(spark, sf):
    rows = detector.user_operations(_stream(spark, sf), "userops_stream")
    return _latest(spark, rows, ["user", "operation"], "events", "userops")


@query(f"""WITH {S.FAIL} SELECT date_trunc('hour', ts) AS window_start, dayname(ts) AS day,
CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count FROM fail GROUP BY ALL""")
def stream_failure_counts(spark, sf):
    hourly = _flat(detector.failure_counts(_stream(spark, sf))).drop("window_end")
    return _latest(spark, hourly, ["window_start", "day", "hour"], "count", "failures")


@query(f"WITH {S.EV} SELECT operation, date_trunc('day', ts) AS date, count(*) AS count FROM ev GROUP BY ALL")
def stream_daily_counts(spark, sf):
    """Complete mode: every batch reports the whole sorted table of counts, and the last one stands."""
    rows = _stream(spark, sf).select(normalise.operation().alias("operation"), F.date_trunc("day", "timestamp").alias("date"))
    out = work_dir(spark, "daily")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    run_available(rows.groupBy("operation", "date").count().sort("date", "operation"), write, f"{out}/checkpoint", "complete")
    return spark.read.parquet(f"{out}/rows")


@query()
def stream_failure_outliers(spark, sf):
    """Models from the table, counts and alerts from the stream."""
    _, features, model = _trained(spark, sf, "logistic")
    out = work_dir(spark, "outliers")

    def sink(alerts: DataFrame, batch_id: int) -> None:
        al.alert_lines(alerts).write.mode("overwrite").parquet(f"{out}/alerts/batch={batch_id}")

    query = detector.detect_stream(
        _stream(spark, sf), features, model, sink, f"{out}/checkpoint", tables.events(spark, sf),
        factor=1, floor=5, trigger={"availableNow": True},
    )
    finish(query)
    lines = spark.read.parquet(f"{out}/alerts")
    return lines.select(F.regexp_replace("value", "^[^,]*", "").alias("value"))


RUN_ENDS = """,
reach AS (SELECT min(epoch_us(ts)) AS first, (max(epoch_us(ts)) - min(epoch_us(ts))) // 5 + 1 AS width FROM events),
ends AS (SELECT max(ts) AS t FROM events, reach GROUP BY (epoch_us(ts) - first) // width),
runs AS (SELECT t, lag(t) OVER (ORDER BY t) AS before, row_number() OVER (ORDER BY t) AS k FROM ends)"""
RUNS = RUN_ENDS + """,
tr AS (SELECT all_tr.* REPLACE (key || '#' || k AS key) FROM all_tr JOIN runs
       ON ts <= t AND (before IS NULL OR ts >= before - INTERVAL 102 HOUR))"""
# Each run looks back from the run before as far as the rule set's horizon, 2 x 2 days and 6 hours, and judges what it could not before.
RUN_OF = "(SELECT t FROM runs WHERE k = CAST(split_part(o.key, '#', 2) AS INTEGER) AND coalesce(before <= o.ts + INTERVAL 2 DAY, true))"
EACH_RUN = S.missing(S.tr().replace("tr AS (", "all_tr AS (") + RUNS + S.WARN_SPANS, S.NOTHING_OPEN_WARN, RUN_OF)


@query(f"SELECT * REPLACE (split_part(key, '#', 1) AS key) FROM ({EACH_RUN}) x")
def stream_state_monitor(spark, sf):
    """The monitor on a stream of five parts, each judged at the latest event time so far: what all runs alerted on."""
    out = work_dir(spark, "monitor")
    rules = tables.monitor_rules("warn")

    def sink(missing: DataFrame, warnings: DataFrame, batch_id: int) -> None:
        missing.write.mode("overwrite").parquet(f"{out}/alerts/batch={batch_id}")

    running = monitor.monitor_stream(
        _stream(spark, sf), rules, f"{out}/store", f"{out}/checkpoint", sink, monitor.event_clock(),
        trigger={"availableNow": True},
    )
    finish(running)
    return _opened(spark.read.parquet(f"{out}/alerts").drop("batch"))


# The keyed monitor forgets nothing by itself: an opening is judged by its whole history, once, when its latency has passed.
KEYED = S.missing(S.tr() + RUN_ENDS + S.WARN_SPANS, S.NOTHING_OPEN_WARN, "(SELECT min(t) FROM runs WHERE t > o.ts + INTERVAL 2 DAY)")


@query(KEYED)
def stream_state_monitor_keyed(spark, sf):
    """The same stream with keyed state and timers in place of tables."""
    out = work_dir(spark, "keyed-monitor")

    def sink(found: DataFrame, batch_id: int) -> None:
        keyed.missing(found).write.mode("overwrite").parquet(f"{out}/alerts/batch={batch_id}")

    running = keyed.start(keyed.keyed_findings(_stream(spark, sf), tables.monitor_rules("warn")), sink, f"{out}/checkpoint", {"availableNow": True})
    finish(running)
    return _opened(spark.read.parquet(f"{out}/alerts").drop("batch"))


# Hours as the stream saw them grow: the first part after which an hour is unusual reports it, with what was counted until then.
ONCE = f"""WITH {HOURS} {RUN_ENDS}, means AS (SELECT day, hour, avg(count) AS prediction FROM h GROUP BY ALL),
grown AS (SELECT k, date_trunc('hour', ts) AS window_start, count(*) AS count FROM fail JOIN runs ON ts <= t GROUP BY ALL),
unusual AS (SELECT g.*, row_number() OVER (PARTITION BY window_start ORDER BY k) AS nr, prediction FROM grown g JOIN h USING (window_start)
  JOIN means USING (day, hour) WHERE g.count > prediction * 1.5 AND g.count > 5),
once AS (SELECT * FROM unusual WHERE nr = 1)"""


def _reported(spark, sf):
    """The hours that the stream reports, and their references, as written batch by batch."""
    out = work_dir(spark, "rates")
    hourly = counts.tumbling_counts(_failures(spark, sf))
    means = materialise(outliers.mean_per_hour_of_week(hourly), "means")
    log = rates.HourLog(spark, f"{out}/log")

    def sink(hours: DataFrame, batch: int) -> None:
        hours.select(F.col("window.start").alias("window_start"), "count", F.round("prediction", 6).alias("prediction")).write.mode("overwrite").parquet(f"{out}/hours/batch={batch}")
        log.refs(hours, batch).select(F.col("window.start").alias("window_start"), "eventref").write.mode("overwrite").parquet(f"{out}/refs/batch={batch}")

    running = rates.rate_alerts_once(
        _stream(spark, sf), lambda hours: outliers.predict_mean(hours, means), log, sink, f"{out}/checkpoint", factor=1.5, floor=5, trigger={"availableNow": True}
    )
    finish(running)
    return spark.read.parquet(f"{out}/hours").drop("batch"), spark.read.parquet(f"{out}/refs").drop("batch")


@query(f"{ONCE} SELECT window_start, count, round(prediction, 6) AS prediction FROM once")
def stream_alerts_once(spark, sf):
    """Every unusual hour once, with its count when it was first unusual."""
    return _reported(spark, sf)[0]


@query(f"{ONCE} SELECT o.window_start, f.streamid || ':' || f.eventid AS eventref FROM once o JOIN runs USING (k) "
       "JOIN fail f ON date_trunc('hour', f.ts) = o.window_start AND f.ts <= t")
def stream_failure_refs(spark, sf):
    """The references behind these counts, one row each, from the rows that the stream counted."""
    return _reported(spark, sf)[1]
