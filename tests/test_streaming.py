import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kestrelwatch.operators import normalise, outliers, replay
from kestrelwatch.operators.transitions import map_transitions
from kestrelwatch.rules import rules_from_dict
from kestrelwatch.sources import readers, writers
from kestrelwatch.streaming import detector, monitor

from replay_model import identity
from replay_model import replay as replay_loop

T0 = datetime(2024, 1, 1)
RULES = rules_from_dict(
    {
        "eventId": "Event.EventId", "streamId": "Event.StreamId", "alertingDelay": "P30D",
        "tags": {"tag1": "domain"},
        "states": [
            {
                "name": name, "maxlatency": "PT2H",
                "open": {"filter": f"Event.EventSource.System.Name = '{name}' and Event.EventDetail.TypeId = 'Login'",
                         "timeout": "P30D", "requires": needs, "tags": [{"name": "domain", "definition": "Event.EventSource.System.Environment"}]},
                "close": {"filter": f"Event.EventSource.System.Name = '{name}' and Event.EventDetail.TypeId = 'Logout'",
                          "multipleMatchStrategy": "close", "tags": [{"name": "domain", "definition": "Event.EventSource.System.Environment"}]},
            }
            for name, needs in (("main", ["vpn"]), ("vpn", []))
        ],
    }
)


def event(i, ts, key, system, kind, domain="A"):
    value = {
        "StreamId": "s", "EventId": str(i), "EventTime": {"TimeCreated": ts.strftime("%Y-%m-%dT%H:%M:%S.%fZ")},
        "EventDetail": {"TypeId": kind}, "EventSource": {"System": {"Name": system, "Environment": domain}, "User": {"Id": key}},
    }
    return key, json.dumps(value)


def write(spark, path, rows):
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, **options):
    return normalise.parse_messages(readers.read_stream(spark, "parquet", path, "key string, value string", **options))


def drain(query):
    assert query.awaitTermination(300)


def test_dedup_needs_a_bound(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [event(1, T0, "u", "vpn", "Login")])
    with pytest.raises(ValueError):
        normalise.dedup_events(stream(spark, str(tmp_path / "in")))


def test_spread_dedup(spark, tmp_path):
    copies = [event(1, T0, "u", "vpn", "Login")] * 200 + [event(2, T0, "u", "vpn", "Login")] + [("u", '{"EventTime": {"TimeCreated": "2024-01-01T00:00:00Z"}}')] * 50
    write(spark, str(tmp_path / "in"), copies)
    rows = normalise.dedup_events(stream(spark, str(tmp_path / "in")), "1 hour", spread=8)
    writers.run_available(rows, lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/b={i}"), str(tmp_path / "cp"))
    assert sorted(str(r.eventid) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", *["None"] * 50]


@pytest.mark.parametrize("mode", ["update", "append"])
def test_failure_counts(spark, tmp_path, mode):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [event(i, T0 + timedelta(minutes=i), "u", "main", detector.FAILURE) for i in range(90)]
    write(spark, source, rows + rows[:30] + [event(999, T0, "u", "main", "Login")])
    write(spark, source, [event(1000, T0 + timedelta(hours=9), "u", "main", detector.FAILURE)])
    hourly = detector.failure_counts(stream(spark, source))

    def sink(batch, batch_id):
        batch.select(F.col("window.start").alias("start"), "day", "hour", "count").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writers.run_available(hourly, sink, str(tmp_path / "cp"), mode)
    rows = spark.read.parquet(out).groupBy("start").agg(F.max("count").alias("n"), F.count("*").alias("times")).orderBy("start").collect()
    want = [(T0, 60), (T0 + timedelta(hours=1), 30)] + ([(T0 + timedelta(hours=9), 1)] if mode == "update" else [])
    assert [(r.start, r.n) for r in rows] == want
    assert mode == "update" or {r.times for r in rows} == {1}


def test_user_operations_view(spark, tmp_path):
    source = str(tmp_path / "in")
    write(spark, source, [event(1, T0, "u", "vpn", "Login"), event(1, T0, "u", "vpn", "Login"), event(2, T0, "u", "vpn", "Logout"), ("u", "{}")])
    query = writers.memory_stream(detector.user_operations(stream(spark, source)), "userops_out", "complete")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {(r.user, r.operation, r.events) for r in spark.table("userops_out").collect()} == {
        ("u", "Login", 1), ("u", "Logout", 1), (None, None, 0)}


def test_detect_stream(spark, tmp_path):
    quiet = [event(f"{d}-{h}-{i}", T0 + timedelta(days=d, hours=h, minutes=i), "u", "main", detector.FAILURE)
             for d in range(7) for h in range(24) for i in range(4 + h % 2)]
    table = spark.createDataFrame(quiet, "key string, value string")
    hourly = detector.failure_counts(normalise.parse_messages(table))
    features, model = outliers.train(hourly, "linear")
    spike = [event(f"x{i}", T0 + timedelta(days=7, hours=3, seconds=i), "u", "main", detector.FAILURE) for i in range(50)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, source, spike)
    stored = normalise.parse_messages(spark.createDataFrame(quiet + spike, "key string, value string"))
    both = writers.fan_out(lambda a, i: writers.write_alert_lines(a, f"{out}/detections", i), lambda a, i: writers.write_alert_rows(a, f"{out}/annotations", i))
    drain(detector.detect_stream(stream(spark, source), features, model, both, str(tmp_path / "cp"), stored, trigger={"availableNow": True}))
    (alert,) = spark.read.parquet(f"{out}/annotations").collect()
    assert sorted(alert.eventrefs) == sorted(f"s:x{i}" for i in range(50))
    (line,) = spark.read.text(f"{out}/detections").collect()
    assert line.value.count(",eventref,s:x") == 50


def history(rng, n):
    out, clock = [], T0
    for i in range(n):
        clock += timedelta(minutes=rng.randint(1, 20))
        out.append((i, clock, rng.choice(["u1", "u2", "hot", "hot"]), rng.choice(["main", "vpn"]), rng.choice(["Login", "Login", "Logout"]), rng.choice("AB")))
    return out


@pytest.mark.parametrize("hot_rows", [10**9, 20])
def test_monitor_stream_equals_batch(spark, tmp_path, hot_rows):
    """Hourly replay batches fed one after the other end in the alerts of one look at everything."""
    rows = history(random.Random(2), 120)
    frame = spark.createDataFrame([(f"{r[3]}", r[0], r[1], *event(*r)) for r in rows], "feed string, line long, timestamp timestamp, key string, value string")
    batches = replay.accelerate(frame, 3600, T0, T0 - timedelta(seconds=10))
    batches = batches.withColumn("batch", F.expr("batch div 6"))
    replay.write_batches(batches, str(tmp_path / "batches"))
    source, alerts, last = str(tmp_path / "in"), [], None
    for n in sorted(r.batch for r in batches.select("batch").distinct().collect()):
        part = spark.read.parquet(f"{tmp_path}/batches/batch={n}").select("key", "value").collect()
        write(spark, source, [tuple(r) for r in part])
        last = max(r[1] for r in rows if event(*r) in [tuple(p) for p in part])

        def sink(missing, warnings, batch_id):
            alerts.extend(missing.collect())
            assert warnings.count() == 0

        drain(
            monitor.monitor_stream(
                stream(spark, source), RULES, str(tmp_path / "store"), str(tmp_path / "cp"), sink, monitor.event_clock(),
                trigger={"availableNow": True}, hot_rows=hot_rows,
            )
        )
    events = normalise.parse_messages(frame.select("key", "value"))
    transitions = [r.asDict() for r in map_transitions(events, RULES).collect()]
    expected = {}
    for key in {t["key"] for t in transitions}:
        expected.update(replay_loop([t for t in transitions if t["key"] == key], RULES, last)[0])
    assert len(alerts) == len(expected) > 5
    assert {identity(r.asDict()) for r in alerts} == set(expected)


def test_heartbeat_runs_without_events(spark, tmp_path):
    """A login alerts once its latency has passed, although nothing more arrives."""
    source = str(tmp_path / "in")
    login = datetime.now() - timedelta(hours=2) + timedelta(seconds=12)
    write(spark, source, [event(1, login, "u", "main", "Login")])
    seen, runs = [], []

    def sink(missing, warnings, batch_id):
        runs.append(batch_id)
        seen.extend(missing.collect())

    query = monitor.monitor_stream(
        monitor.heartbeat(stream(spark, source)), RULES, str(tmp_path / "store"), str(tmp_path / "cp"), sink,
        trigger={"processingTime": "1 second"},
    )
    try:
        until = time.time() + 90
        while not seen and time.time() < until and query.isActive:
            time.sleep(1)
    finally:
        query.stop()
    assert [r.eventid for r in seen] == ["1"] and len(runs) > 1


def test_console(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [event(1, T0, "u", "vpn", "Login")])
    query = writers.show_stream(stream(spark, str(tmp_path / "in")).select("key"), "1 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_the_store_stops_growing(spark, tmp_path):
    """A run a day with a horizon of four hours: folders do not pile up, a repeated run changes nothing, keys stay warned about."""
    import dataclasses

    from kestrelwatch.streaming.monitor import MonitorStore

    rules = dataclasses.replace(RULES, alerting_delay=timedelta(0))
    store = MonitorStore(spark, str(tmp_path / "store"))
    columns = "key string, timestamp timestamp, state string, open boolean, tag1 string, tag2 string, tag3 string, eventid string, streamid string"
    sizes, alerts = [], []
    for day in range(7):
        now = T0 + timedelta(days=day)
        rows = [(f"k{day}", now + timedelta(hours=1), "main", True, "A", None, None, str(day), "s")]
        store.append(spark.createDataFrame(rows, columns), day)
        for _ in range(2 if day == 4 else 1):
            found, _ = store.run(rules, (now + timedelta(hours=20)).astimezone(), day)
            keys = [r.key for r in found.collect()]
        alerts.append(keys)
        sizes.append({name: len(list((tmp_path / "store" / name).glob("*=*"))) for name in ("transitions", "judged", "warned", "log")})
    assert alerts == [[f"k{day}"] for day in range(7)]
    assert sizes[3] == sizes[4] == sizes[5] == sizes[6] and max(sizes[6].values()) <= 3
    assert monitor.folders(spark, str(tmp_path / "none")) == []


def folder_count(path):
    return sum(1 for p in path.rglob("*=*") if p.is_dir())


def test_merged_levels_hold_what_was_written(spark, tmp_path, monkeypatch):
    """Many runs: folders grow with the logarithm, nothing young is lost, what is old goes, a source that stays behind counts once."""
    monkeypatch.setattr(monitor, "FAN", 2)
    store = monitor.MonitorStore(spark, str(tmp_path / "s"), quiet=timedelta(hours=6))
    hour, horizon, start = timedelta(hours=1), timedelta(hours=8), T0.astimezone()
    columns = "key string, timestamp timestamp, state string, open boolean, tag1 string, tag2 string, tag3 string, eventid string, streamid string"
    counts = []
    for n in range(22):
        now = start + n * hour
        row = (f"k{n}", now, "main", True, None, None, None, str(n), "s")
        store.append(spark.createDataFrame([row, row], columns), n)
        judged = spark.createDataFrame([row], columns).drop("open").selectExpr("*", "'vpn' required_state", "true emitted")
        judged.write.parquet(f"{store.path}/judged/run={n}")
        spark.createDataFrame([(f"k{n}", monitor._micros(now))], "key string, at long").write.parquet(f"{store.path}/warned/run={n}")
        spark.createDataFrame([(now, n)], "as_of timestamp, arrival long").write.parquet(f"{store.path}/log/run={n}")
        if n:
            last = monitor.Run(n - 1, now - hour, n - 1)
            store.merge(last, horizon)
            store.expire(last, horizon)
            counts.append(folder_count(tmp_path / "s"))
    assert max(counts[14:]) <= 1.3 * max(counts[:14])
    rules = type("Rules", (), {"horizon": horizon, "requiring": []})
    young = {f"k{n}" for n in range(20 - 8, 22)}
    assert young <= {r.key for r in store.transitions(rules, None, 21, start).collect()}
    assert {r.key for r in store.judged(rules, last).collect()} == {f"k{n}" for n in range(20 - 8, 21)}
    assert {r.key for r in store.warned(last).collect()} == {f"k{n}" for n in range(20 - 6, 21)}
    kept = {r.key for r in spark.read.parquet(f"{store.path}/warned-merged").collect()}
    assert "k0" not in kept


def test_a_key_is_warned_about_again_after_quiet(spark, tmp_path):
    """An ambiguous close every ten hours, with a horizon of four: with ``quiet`` of a day only some are new, without one only the first."""
    import dataclasses

    warn = dataclasses.replace(RULES, alerting_delay=timedelta(0), states=tuple(dataclasses.replace(s, strategy="warn") for s in RULES.states))
    columns = "key string, timestamp timestamp, state string, open boolean, tag1 string, tag2 string, tag3 string, eventid string, streamid string"
    found = {}
    for name, quiet in (("day", timedelta(days=1)), ("ever", None)):
        store = monitor.MonitorStore(spark, str(tmp_path / name), quiet)
        for n in range(5):
            now = T0 + timedelta(hours=10 * n)
            rows = [("u", now + timedelta(minutes=i), "vpn", i < 2, "A", None, None, f"{n}-{i}", "s") for i in range(3)]
            store.append(spark.createDataFrame(rows, columns), n)
            _, warnings = store.run(warn, (now + timedelta(hours=9)).astimezone(), n)
            found.setdefault(name, []).append(warnings.count())
    assert found == {"day": [1, 0, 0, 1, 0], "ever": [1, 0, 0, 0, 0]}
