"""The state monitor with keyed state and timers, against the plain loop and against its own state's size."""

import dataclasses
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kestrelwatch.operators import normalise
from kestrelwatch.operators.transitions import map_transitions
from kestrelwatch.rules import rules_from_dict
from kestrelwatch.sources import readers
from kestrelwatch.streaming import keyed

from replay_model import identity
from replay_model import replay as replay_loop

T0 = datetime(2024, 1, 1)
DOMAIN = {"name": "domain", "definition": "Event.EventSource.System.Environment"}
DEVICE = {"name": "device", "definition": "Event.EventSource.Client.HostName"}


def rules(strategy="warn", device=(), timeout="P30D"):
    """``device``: what sets the device as well, of opens, closes and logins that look."""

    def tags(name):
        return [DOMAIN, DEVICE] if name in device else [DOMAIN]

    def when(system, kind):
        return f"Event.EventSource.System.Name = '{system}' and Event.EventDetail.TypeId = '{kind}'"

    return rules_from_dict(
        {
            "eventId": "Event.EventId", "streamId": "Event.StreamId", "tags": {"tag1": "domain", "tag2": "device"},
            "states": [
                {"name": "ledger", "maxlatency": "PT1H", "open": {"filter": when("ledger", "Login"), "timeout": timeout, "requires": ["gate", "badge"], "tags": tags("looks")}},
                {"name": "gate", "maxlatency": "PT2H", "open": {"filter": when("gate", "Login"), "tags": tags("opens")},
                 "close": {"filter": when("gate", "Logout"), "multipleMatchStrategy": strategy, "tags": tags("closes")}},
                {"name": "badge", "maxlatency": "PT2H", "open": {"filter": when("badge", "Login"), "tags": tags("opens")},
                 "close": {"filter": when("badge", "Logout"), "multipleMatchStrategy": strategy, "tags": tags("closes")}},
            ],
        }
    )


def event(i, ts, key, system, kind, domain="A", device=None):
    value = {
        "StreamId": "s", "EventId": str(i), "EventTime": {"TimeCreated": ts.strftime("%Y-%m-%dT%H:%M:%S.%fZ")}, "EventDetail": {"TypeId": kind},
        "EventSource": {"System": {"Name": system, "Environment": domain}, "Client": {"HostName": device}, "User": {"Id": key}},
    }
    return key, json.dumps(value)


def history(rng, n, keys=("u1", "u2", "hot", "hot", "hot"), kinds=("Login", "Logout")):
    out, clock = [], T0
    for i in range(n):
        clock += timedelta(minutes=rng.randint(0, 20), seconds=rng.randint(0, 59), microseconds=rng.randint(0, 999_999))
        out.append((i, clock, rng.choice(keys), rng.choice(["ledger", "gate", "gate", "badge"]), rng.choice(kinds), rng.choice("AB"), rng.choice([None, "x", "y"])))
    return out


def write(spark, path, rows):
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("append").parquet(path)


def run(spark, path, batches, rule_set, keep=None, each=None):
    """Feeds the batches one after the other, restarting the query each time, and returns what was found."""
    found = []
    for rows in batches:
        write(spark, f"{path}/in", [event(*r) for r in rows])
        events = normalise.parse_messages(readers.read_stream(spark, "parquet", f"{path}/in", "key string, value string"))
        query = keyed.start(keyed.keyed_findings(events, rule_set, keep), lambda f, _: found.extend(r.asDict() for r in f.collect()), f"{path}/cp", {"availableNow": True})
        assert query.awaitTermination(300) and query.exception() is None
        if each:
            each(query)
    return found


def expected(spark, rows, rule_set, keep=None):
    """The loop over whole histories, judged at the time that the watermark stands for."""
    frame = spark.createDataFrame([event(*r) for r in rows], "key string, value string")
    found = [r.asDict() for r in map_transitions(normalise.parse_messages(frame), rule_set).collect()]
    last = max(t["timestamp"] for t in found)
    now = last - timedelta(hours=2) + max(s.max_latency for s in rule_set.required)
    out = {}
    for key in {t["key"] for t in found}:
        mine = [t for t in found if t["key"] == key and t["timestamp"] <= last - timedelta(hours=2, milliseconds=1)]
        out.update({i: need for i, (need, emitted) in replay_loop(mine, rule_set, now + timedelta(days=1))[0].items()})
    return out


@pytest.mark.parametrize("strategy, device", [("warn", ()), ("pop", ("opens", "looks", "closes")), ("warn", ("opens", "closes")), ("close", ("opens",))])
def test_findings_are_those_of_the_loop(spark, tmp_path, strategy, device):
    rule_set = rules(strategy, device)
    assert keyed.common_tags(rule_set) == (("tag1", "tag2") if len(device) == 3 else ("tag1",))
    rows = history(random.Random(strategy + str(device)), 150)
    if len(device) == 3:
        rows = [(*r[:6], r[6] or "z") for r in rows]
    random.Random(1).shuffle(one := rows[:50])
    found = run(spark, str(tmp_path), [one + one[:5], rows[50:] + rows[60:65]], rule_set)
    missing = {identity(f): f["required_state"] for f in found if f["kind"] == "missing"}
    assert missing == expected(spark, rows, rule_set) and len(missing) > (0 if strategy == "warn" else 2)
    assert len(missing) == sum(f["kind"] == "missing" for f in found)
    warned = [f for f in found if f["kind"] == "ambiguous"]
    assert bool(warned) == (strategy == "warn") and all(f["ambiguous_opens"] > 1 for f in warned)


def test_timed_out_openings_give_no_alert(spark, tmp_path):
    rows = [(1, T0, "u", "ledger", "Login"), (2, T0 + timedelta(hours=20), "u", "ledger", "Login"), (3, T0 + timedelta(hours=24), "u", "gate", "Logout")]
    found = run(spark, str(tmp_path), [rows], rules(timeout="PT6H"))
    assert [f["eventid"] for f in found] == ["2"]


def test_state_stays_small(spark, tmp_path):
    """200 batches of ten hours each in one stream, a hot key among them and keys that come once: rows of state do not pile up."""
    rng, clock, total = random.Random(5), T0, []
    path = f"{tmp_path}/in"
    rows = []
    for n in range(200):
        for i in range(3):
            rows.append((n, f"{n}-{i}", clock + timedelta(hours=3 * i), rng.choice(["hot", f"once{n}"]), rng.choice(["gate", "ledger"]), rng.choice(["Login", "Login", "Logout"])))
        clock += timedelta(hours=10)
    messages = [(r[0], *event(*r[1:])) for r in rows]
    frame = spark.createDataFrame(messages, "n int, key string, value string").repartitionByRange(200, "n").sortWithinPartitions("n")
    frame.drop("n").write.option("maxRecordsPerFile", 3).parquet(path)
    # Files of a stream are taken in the order of their times; these are named in order and written at once.
    import os

    names = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    for k, name in enumerate(names):
        os.utime(f"{path}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    assert len(names) == 200
    events = normalise.parse_messages(readers.read_stream(spark, "parquet", path, "key string, value string", maxFilesPerTrigger="1"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = []
        query = keyed.start(keyed.keyed_findings(events, rules("pop"), keep=timedelta(hours=40)), lambda f, _: found.extend(f.collect()), f"{tmp_path}/cp", {"availableNow": True})
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert query.awaitTermination(600) and query.exception() is None
        total = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(total) >= 90 and max(total[len(total) // 2 :]) <= 1.5 * max(total[: len(total) // 2]) and max(total) < 150
    assert found


def test_what_is_kept(spark, tmp_path):
    """A gate that opened longer ago than is kept no longer counts; one within does."""
    day = timedelta(days=1)
    rows = [(1, T0, "u", "gate", "Login"), (2, T0, "u", "badge", "Login"), (3, T0 + day, "u", "ledger", "Login"), (4, T0 + 3 * day, "u", "ledger", "Login"), (5, T0 + 9 * day, "v", "gate", "Logout")]
    for n, strategy in enumerate(("warn", "pop", "close")):
        found = run(spark, f"{tmp_path}/{n}", [rows[:3], rows[3:]], rules(strategy), keep=timedelta(hours=36))
        assert [(f["eventid"], f["required_state"]) for f in found] == [("4", "gate")]
        assert run(spark, f"{tmp_path}/{n}k", [rows[:3], rows[3:]], rules(strategy)) == []


def test_rows_without_the_tag_of_their_sub_key_are_an_error(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [event(1, T0, "u", "gate", "Login", None)])
    events = normalise.parse_messages(readers.read_stream(spark, "parquet", f"{tmp_path}/in", "key string, value string"))
    query = keyed.start(keyed.keyed_findings(events, rules()), lambda f, _: f.collect(), f"{tmp_path}/cp", {"availableNow": True})
    with pytest.raises(Exception, match="lacks tag1"):
        query.awaitTermination(120)


def test_rules_without_requirement_are_refused(spark, tmp_path):
    plain = rules()
    bare = dataclasses.replace(plain, states=tuple(dataclasses.replace(s, open=dataclasses.replace(s.open, requires=())) for s in plain.states))
    with pytest.raises(ValueError):
        keyed.keyed_findings(spark.createDataFrame([], "key string, value string"), bare)


def test_nothing_and_null_keys(spark, tmp_path):
    rows = [(1, T0, None, "ledger", "Login"), (2, T0 + timedelta(hours=9), None, "gate", "Login")]
    frame = spark.createDataFrame([(None, event(*r)[1].replace('"User": {"Id": null}', '"User": {}')) for r in rows], "key string, value string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    events = normalise.parse_messages(readers.read_stream(spark, "parquet", f"{tmp_path}/in", "key string, value string"))
    found = []
    query = keyed.start(keyed.keyed_findings(events, rules()), lambda f, _: found.extend(f.collect()), f"{tmp_path}/cp", {"availableNow": True})
    assert query.awaitTermination(120)
    assert [(f.key, f.eventid) for f in found] == [(None, "1")]
    assert keyed.missing(spark.createDataFrame([], keyed.OUTPUT)).where(F.lit(True)).count() == 0


@pytest.mark.parametrize("groups", [1, 8])
def test_calls_on_state_do_not_grow_with_the_keys(spark, tmp_path, groups):
    """400 keys in a few groups: one timer per group, and what the loop finds."""
    rng = random.Random(groups)
    rows = history(rng, 1200, keys=[f"u{i}" for i in range(400)])
    rows[7:9] = [(*rows[7][:2], 'a "quoted", [key]\\', *rows[7][3:]), (*rows[8][:2], "ключ\n", *rows[8][3:])]
    found = []
    write(spark, f"{tmp_path}/in", [event(*r) for r in rows[:900]])
    for more in (rows[900:], []):
        events = normalise.parse_messages(readers.read_stream(spark, "parquet", f"{tmp_path}/in", "key string, value string"))
        query = keyed.start(
            keyed.keyed_findings(events, rules("close"), groups=groups), lambda f, _: found.extend(r.asDict() for r in f.collect()), f"{tmp_path}/cp", {"availableNow": True}
        )
        assert query.awaitTermination(300) and query.exception() is None
        timers = [p.stateOperators[0].customMetrics["numRegisteredTimers"] for p in query.recentProgress if p.stateOperators]
        assert 0 < max(timers) <= 2 * groups
        if more:
            write(spark, f"{tmp_path}/in", [event(*r) for r in more])
    missing = {identity(f): f["required_state"] for f in found if f["kind"] == "missing"}
    assert missing == expected(spark, rows, rules("close")) and len(missing) > 50


def test_rows_of_state_in_several_elements(monkeypatch):
    class State:
        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

        def get(self):
            return iter(self.rows)

    monkeypatch.setattr(keyed, "SENT", 3)
    state = State()
    rows = [[None, 'a "quoted", [key]\\', n, True] for n in range(7)]
    for n, elements in ((7, 3), (6, 2), (0, 0)):
        keyed.store(state, rows[:n])
        assert len(state.rows) == elements and list(keyed.stored(state)) == rows[:n]


@pytest.mark.parametrize("name", ["stream_state_monitor_keyed", "stream_state_monitor", "stream_user_operation_counts"])
def test_no_query_gives_up_by_the_clock(spark, monkeypatch, name):
    """A stream that takes long is waited for: a wait with a limit, which says here that the time is up, would end it."""
    from pyspark.sql.streaming import StreamingQuery

    import __spark_entry__ as entry

    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: wait(self) if timeout is None else False)
    assert entry.queries()[name](spark, entry.SMALL).count() > 0
