import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kestrelwatch.functions import texts
from kestrelwatch.operators import alerts, counts, linked, normalise, outliers, replay, scan, scoring, tags
from kestrelwatch.operators.normalise import EVENT_SCHEMA
from kestrelwatch.operators.transitions import map_transitions
from kestrelwatch.rules import rules_from_dict
from kestrelwatch.streaming import detector

T0 = datetime(2024, 1, 1)
EVENT = {
    "StreamId": "7",
    "EventId": "3",
    "EventTime": {"TimeCreated": "2024-01-01T10:00:00.123Z"},
    "EventDetail": {"TypeId": "Login", "Authenticate": {"User": {"Id": "User1"}}},
    "EventSource": {"System": {"Name": "VPN", "Environment": "A"}},
}


def messages(spark, *values, headers=None):
    return spark.createDataFrame(
        [(b"User1", v.encode(), headers or []) for v in values],
        "key binary, value binary, headers array<struct<key: string, value: binary>>",
    )


def test_parse_messages(spark):
    broken = "{not json"
    partial = json.dumps({"StreamId": "7", "EventId": "4", "EventTime": {"TimeCreated": "yesterday"}})
    found = normalise.parse_messages(messages(spark, json.dumps(EVENT), broken, partial)).withColumn("user", normalise.user())
    a, b, c = found.collect()
    assert (a.key, a.streamid, a.eventid, a.user) == ("User1", "7", "3", "User1")
    assert a.timestamp == datetime(2024, 1, 1, 10, 0, 0, 123000)
    assert (b.key, b.streamid, b.timestamp) == ("User1", None, None)
    assert (c.eventid, c.timestamp, c.user) == ("4", None, None)


def test_headers_last_one_counts(spark):
    headers = [("a", b"1"), ("b", b"2"), ("a", b"3"), (None, b"x")]
    found = normalise.parse_messages(messages(spark, json.dumps(EVENT), headers=headers)).first()
    assert found.headers == {"a": "3", "b": "2"}


def test_messages_roundtrip(spark):
    parsed = normalise.parse_messages(messages(spark, json.dumps(EVENT)))
    out = normalise.to_messages(parsed, {"kind": normalise.operation()}, F.lit("topic"), F.lit(2))
    row = out.first()
    assert json.loads(row.value) == EVENT and row.topic == "topic" and row.partition == 2
    assert row.headers == [Row(key="kind", value=bytearray(b"Login"))]
    again = normalise.parse_messages(out)
    assert again.first().Event == parsed.first().Event


def test_dedup_keeps_one_per_id(spark):
    rows = spark.createDataFrame([("1", "1"), ("1", "1"), ("1", "2"), (None, None), (None, None)], "streamid string, eventid string")
    assert normalise.dedup_events(rows).count() == 4  # events without ids are not copies of each other


def test_map_transitions_matches_several_rules(spark):
    rules = rules_from_dict(
        {
            "eventId": "Event.EventId",
            "streamId": "Event.StreamId",
            "tags": {"tag1": "domain", "tag2": "device"},
            "states": [
                {"name": "a", "open": {"filter": "Event.EventDetail.TypeId = 'Login'", "tags": [{"name": "domain", "definition": "Event.EventSource.System.Environment"}]},
                 "close": {"filter": "Event.EventDetail.TypeId = 'Logout'", "tags": []}},
                {"name": "b", "open": {"filter": "Event.EventSource.System.Name = 'VPN'", "tags": [{"name": "device", "definition": "Event.EventSource.System.Name"}]}},
            ],
        }
    )
    logout = json.dumps({**EVENT, "EventDetail": {"TypeId": "Logout"}, "EventSource": None})
    rows = map_transitions(normalise.parse_messages(messages(spark, json.dumps(EVENT), logout, "{}")), rules).collect()
    got = {(r.state, r.open, r.tag1, r.tag2, r.tag3, r.eventid, r.streamid) for r in rows}
    assert len(rows) == 3 and got == {
        ("a", True, "A", None, None, "3", "7"),
        ("b", True, None, "VPN", None, "3", "7"),
        ("a", False, None, None, None, "3", "7"),
    }


@pytest.mark.parametrize("slices", [None, 1, 3, 100])
def test_scan_equals_window(spark, slices):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, -2, -1, 0, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    if slices:
        df = df.withColumn("s", F.expr(f"i div {300 // slices}"))
    specs = [scan.Spec(f"{a}_{f}", a, F.col("v"), f) for a in ("sum", "min", "max") for f in ("upto", "before", "after", "all")]
    got = {r.i: r for r in scan.scan(df, ["g"], ["i"], specs, "s" if slices else None).collect()}
    assert len(got) == 300
    for g, i, _ in rows:
        group = [(j, v) for h, j, v in rows if h == g and v is not None]
        frames = {
            "upto": [v for j, v in group if j <= i], "before": [v for j, v in group if j < i],
            "after": [v for j, v in group if j > i], "all": [v for _, v in group],
        }
        for a, f in (("sum", sum), ("min", min), ("max", max)):
            for name, values in frames.items():
                assert got[i][f"{a}_{name}"] == (f(values) if values else None)


@pytest.mark.parametrize("literals", [500, 0])
def test_hot_keys(spark, monkeypatch, literals):
    monkeypatch.setattr(scan, "MAX_LITERALS", literals)
    df = spark.createDataFrame([("a", 1)] * 10 + [(None, 2)] * 8 + [("b", 3)] * 3, "key string, n int")
    hot = scan.hot_keys(df, "key", 5)
    assert hot.values == ("a",) and hot.null_key
    assert [sorted({r.n for r in part.collect()}) for part in hot.split(df, "key")] == [[3], [1, 2]]
    hot = scan.hot_keys(df, "key", 9)
    assert [part.count() for part in hot.split(df, "key")] == [11, 10]


def test_large_hour_keeps_its_shape(spark):
    """An hour of 5000 failures, 4000 of them distinct: one row per event and one hourly row with the full count."""
    rows = spark.range(5000).select(
        F.timestamp_micros(F.lit(1704067200000000) + F.col("id")).alias("timestamp"),
        F.lit("s").alias("streamid"),
        (F.col("id") % 4000).cast("string").alias("eventid"),
    )
    refs = counts.hourly_event_refs(rows)
    assert {r.eventref for r in refs.collect()} == {f"s:{i}" for i in range(4000)} and refs.count() == 4000
    (hour,) = counts.hourly_ref_counts(refs).collect()
    assert (hour["count"], hour.day, hour.hour) == (4000, "Monday", 0)


def test_rolling_counts(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), T0 + timedelta(seconds=rng.randint(0, 20000) / 3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "key string, timestamp timestamp")
    got = sorted((r.key or "", r.timestamp, r.rolling) for r in counts.with_rolling_count(df, ["key"], 600).collect())
    sec = lambda t: int((t - T0).total_seconds())
    want = sorted((k or "", t, sum(1 for j, u in rows if j == k and 0 <= sec(t) - sec(u) <= 600)) for k, t in rows)
    assert got == want


def test_unusual_logins(spark):
    def event(ts, kind="Login"):
        return (ts, "k", "s", "e", kind)

    df = spark.createDataFrame(
        [event(datetime(2024, 1, 1, 7, 59)), event(datetime(2024, 1, 1, 8)), event(datetime(2024, 1, 1, 18)),
         event(datetime(2024, 1, 6, 12)), event(datetime(2024, 1, 1, 3), "Logout")],
        "timestamp timestamp, key string, streamid string, eventid string, kind string",
    ).withColumn("Event", normalise.event_struct({"EventDetail.TypeId": F.col("kind")}))
    found = normalise.unusual_logins(df)
    assert sorted(r.timestamp for r in found.collect()) == [
        datetime(2024, 1, 1, 7, 59), datetime(2024, 1, 1, 18), datetime(2024, 1, 6, 12)]
    assert alerts.alert_lines(alerts.login_alerts(found)).count() == 3


def test_alert_line_is_valid_csv(spark):
    import csv

    df = spark.createDataFrame(
        [("t", 'say "hi", you', "two\nlines", None, [("a,b", "c"), ("n", '"')], ["1:2", "1:3"])],
        "time string, title string, description string, detail string, props array<struct<name:string,value:string>>, eventrefs array<string>",
    )
    line = alerts.alert_lines(df).first().value
    (fields,) = list(csv.reader([line[: line.index("\n") + 1], line[line.index("\n") + 1 :]]))
    assert fields == ["t", 'say "hi", you', "two\nlines", "", "a,b", "c", "n", '"', "eventref", "1:2", "eventref", "1:3"]


def test_suppressed_at_startup(spark):
    rules = rules_from_dict({"alertingDelay": "PT24H", "tags": {"tag1": "domain"}, "states": [{"name": "a", "open": {"filter": "x"}}]})
    missing = spark.createDataFrame(
        [("k", T0, "a", "d", None, None, None, None, "b")],
        "key string, timestamp timestamp, state string, tag1 string, tag2 string, tag3 string, eventid string, streamid string, required_state string",
    )
    for hours, suppressed in ((1, True), (24, True), (25, False)):
        when = F.lit(T0 + timedelta(hours=hours))
        row = alerts.state_alerts(missing, rules, when, T0).first()
        assert row.suppressed is suppressed
    assert row.description == "Required state b is missing for k while opening state a"
    assert [p.name for p in row.props] == ["analytic", "config", "key", "state", "requiredState", "domain"]
    assert row.eventrefs == []


def test_texts(spark):
    row = spark.range(1).select(
        texts.rate_detail(F.lit("H"), F.lit(12), F.lit(5.9)).alias("detail"),
        texts.event_ref(F.lit("1"), F.lit(None).cast("string")).alias("none"),
        texts.ref_stream(F.lit("1:2:3")).alias("stream"),
        texts.ref_event(F.lit("1:2:3")).alias("event"),
        texts.restore_quotes(texts.hide_quotes(F.lit('{"a":"b"}'))).alias("json"),
        texts.hide_quotes(F.lit('{"a"}')).alias("hidden"),
        texts.iso_utc(F.lit(datetime(2024, 1, 1, 1, 2, 3, 456789))).alias("iso"),
    ).first()
    assert row.detail == "Unexpectedly High Number of Authentication Failures during hour starting H.  Expected count:5. Actual count:12"
    assert row.none is None and (row.stream, row.event) == ("1:2", "3")
    assert row.json == '{"a":"b"}' and row.hidden == "{¬a¬}"
    assert row.iso == "2024-01-01T01:02:03.456Z"


def test_dedup_alerts(spark):
    rows = [("t", "k", T0 + timedelta(minutes=m), i) for i, m in enumerate([50, 10, 30, 70])] + [("t", "j", T0, 9)]
    df = spark.createDataFrame(rows, "title string, entity string, at timestamp, n int")
    assert sorted(r.n for r in alerts.dedup_alerts(df, ["title", "entity"], "at").collect()) == [1, 3, 9]


def test_linked_events(spark):
    found = spark.createDataFrame([("x", ["1:1", "1:2", "9:9"]), ("y", ["1:2"])], "title string, eventrefs array<string>")
    events = spark.createDataFrame([("1", "1", "Login"), ("1", "2", "Logout"), ("2", "1", "Login")], "streamid string, eventid string, op string")
    got = sorted((r.title, r.eventid) for r in linked.linked_events(found, events).collect())
    assert got == [("x", "1"), ("x", "2"), ("y", "2")]
    assert [r.eventid for r in linked.linked_events(found, events, "op = 'Login'").collect()] == ["1"]


def test_entity_timeline(spark):
    vpn = spark.createDataFrame([(T0 + timedelta(hours=2), "Logout", "U1", "D1"), (T0, "Login", "U1", "D1"), (T0, "Login", "U2", "D2")],
                                "timestamp timestamp, operation string, user string, device string")
    main = spark.createDataFrame([(T0 + timedelta(hours=1), "Login", "U1"), (T0, "Process Start", "U1")], "timestamp timestamp, operation string, user string")
    rows = linked.entity_timeline({"vpn": vpn, "main": main}, "U1").collect()
    assert [(r.feed, r.operation) for r in rows] == [("vpn", "Login"), ("main", "Login"), ("vpn", "Logout")]
    assert [r.user for r in linked.entity_timeline({"vpn": vpn}, "D2").collect()] == ["U2"]


@pytest.mark.parametrize("tolerance", [timedelta(0), timedelta(seconds=7), timedelta(minutes=2)])
def test_scoring_against_pairs(spark, tolerance):
    rng = random.Random(str(tolerance))
    make = lambda n: [(rng.choice("abc"), T0 + timedelta(seconds=rng.randint(0, 3000))) for _ in range(n)]
    found, truth = make(60), make(25) + [("d", T0)]
    schema = "entity string, timestamp timestamp"
    row = scoring.score_alerts(spark.createDataFrame(found, schema), spark.createDataFrame(truth, schema), tolerance).first()
    near = lambda x, ys: any(x[0] == y[0] and abs(x[1] - y[1]) <= tolerance for y in ys)
    tp, ok = sum(near(x, truth) for x in found), sum(near(x, found) for x in truth)
    assert (row.true_positives, row.false_positives, row.found, row.missed) == (tp, 60 - tp, ok, 26 - ok)
    assert row.precision == pytest.approx(tp / 60) and row.recall == pytest.approx(ok / 26)


def test_replay_batches_never_fall(spark, monkeypatch):
    monkeypatch.setattr(replay, "LINES_PER_SLICE", 7)
    rng = random.Random(5)
    rows, clock = [], T0
    for line in range(120):
        clock += timedelta(minutes=rng.randint(0, 25))
        late = timedelta(hours=rng.choice([0, 0, 0, 5]))
        rows.append(("f" if line % 3 else "g", line, clock - late))
    start, oldest = datetime(2030, 1, 1), T0 - timedelta(seconds=10)
    df = spark.createDataFrame(rows, "feed string, line long, timestamp timestamp")
    got = {r.line: r for r in replay.accelerate(df, 45, start, oldest).collect()}
    highest = {"f": 1, "g": 1}
    for feed, line, ts in rows:
        ms = int((ts - oldest).total_seconds() * 1000) * 45
        moved = start + timedelta(milliseconds=int(ms / 3600))
        while moved > start + timedelta(seconds=45 * highest[feed]):
            highest[feed] += 1
        assert (got[line].replay_time, got[line].batch) == (moved, highest[feed])


def test_oldest_event(spark):
    rows = [("f", 1, T0), ("f", 2, T0 - timedelta(days=1)), ("g", 1, T0 + timedelta(hours=1))]
    df = spark.createDataFrame(rows, "feed string, line long, timestamp timestamp")
    assert counts.oldest_event(df).first().oldest == T0 - timedelta(seconds=10)


@pytest.mark.parametrize("hot_rows", [10**9, 10])
def test_tag_levels_and_concurrency(spark, hot_rows):
    rng = random.Random(11)
    rows = [
        (rng.choice(["a", "b", "c"]), T0 + timedelta(seconds=rng.randint(0, 4000)), "vpn", rng.random() < 0.5,
         rng.choice("xyz"), None, None, str(i), "s")
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "key string, timestamp timestamp, state string, open boolean, tag1 string, tag2 string, tag3 string, eventid string, streamid string")
    hot = scan.hot_keys(df, "key", hot_rows)
    levels = {r.eventid: r.level for r in tags.open_levels(df, "vpn", "tag1", hot).collect()}
    peaks = {r.key: r.concurrent for r in tags.concurrent_tags(df, "vpn", "tag1", hot).collect()}
    for key in "abc":
        now, peak = {}, 0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[8], r[7], not r[3])):
            now[r[4]] = max(0, now.get(r[4], 0) + (1 if r[3] else -1))
            assert levels[r[7]] == now[r[4]]
            peak = max(peak, sum(v > 0 for v in now.values()))
        assert peaks[key] == peak


def test_distinct_tags(spark):
    rows = [("k", T0, True, "x"), ("k", T0, True, "y"), ("k", T0, True, "x"), ("k", T0 + timedelta(hours=2), True, "z"), ("k", T0, False, "q")]
    df = spark.createDataFrame(rows, "key string, timestamp timestamp, open boolean, tag1 string")
    got = {(r.window.start, r["values"]) for r in tags.distinct_tags(df, "tag1", "1 hour").collect()}
    assert got == {(T0, 2), (T0 + timedelta(hours=2), 1)}
    assert max(r["values"] for r in tags.distinct_tags(df, "tag1", "3 hours", "1 hour").collect()) == 3


def hourly(spark, spike=False):
    rows = []
    for d in range(21):
        for h in range(24):
            n = 5 + h % 5 + d % 7 + (60 if spike and (d, h) == (15, 9) else 0)
            rows += [(T0 + timedelta(days=d, hours=h, seconds=i), "s", f"{d}-{h}-{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "timestamp timestamp, streamid string, eventid string")
    return df.withColumn("Event", normalise.event_struct({"EventDetail.TypeId": F.lit(detector.FAILURE)}))


@pytest.mark.parametrize("kind", ["linear", "logistic", "forest"])
def test_models_find_the_spike(spark, tmp_path, kind):
    features, model = outliers.train(counts.training_counts(hourly(spark)), kind)
    assert len(outliers.add_features(counts.training_counts(hourly(spark)), features).first().features) == 29
    outliers.save_models(features, model, str(tmp_path))
    features, model = outliers.load_models(str(tmp_path), kind)
    events = hourly(spark, spike=True)
    found = detector.detect(outliers.predict(detector.failure_counts(events), features, model), events).collect()
    assert {r.title for r in found} == {texts.RATE_TITLE}
    assert {p.value for r in found for p in r.props if p.name == "hour"} == {"2024-01-16 09:00:00"}
    assert len(found) == 1 and len(set(found[0].eventrefs)) == len(found[0].eventrefs) == 5 + 4 + 1 + 60
    error = outliers.errors(counts.training_counts(hourly(spark)), features, model).first()
    assert error.rows == 21 * 24 and error.mean_absolute_error < 4
    assert outliers.residuals(counts.training_counts(hourly(spark)), features, model).count() == 21 * 24


def test_high_counts_are_classes(spark):
    rows = [("Monday", h, 5000 + 1000 * (h % 2)) for h in range(24)] * 3
    features, model = outliers.train(spark.createDataFrame(rows, "day string, hour int, count long"), "logistic", invalid="keep")
    hours = spark.createDataFrame(rows[:24], "day string, hour int, count long")
    assert all(r.prediction == r["count"] for r in outliers.predict(hours, features, model).collect())


def test_state_occupancy(spark):
    rows = [("a", T0, "vpn", True), ("a", T0 + timedelta(1), "vpn", False), ("b", T0, "vpn", True), ("c", T0, "main", True)]
    df = spark.createDataFrame([(*r, "1", "1") for r in rows], "key string, timestamp timestamp, state string, open boolean, eventid string, streamid string")
    assert {r.state: r["keys"] for r in counts.state_occupancy(df).collect()} == {"-": 1, "vpn": 1, "main": 1}
    assert {r.state: r["keys"] for r in counts.state_occupancy(df, T0).collect()} == {"vpn": 2, "main": 1}


def test_event_schema_is_all_strings():
    def leaves(t):
        return [x for f in t.fields for x in (leaves(f.dataType) if hasattr(f.dataType, "fields") else [f.dataType.typeName()])]

    found = leaves(EVENT_SCHEMA)
    assert set(found) == {"string"} and len(found) == 18
