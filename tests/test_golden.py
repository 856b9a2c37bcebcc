"""Incremental runs of hand-written histories, one per key, with the outcome each must have."""

from datetime import timezone

import pytest

from kestrelwatch.operators.state_monitor import judge, state_monitor, state_warnings
from kestrelwatch.rules import rules_from_dict
from kestrelwatch.streaming.monitor import MonitorStore

from replay_model import at, identity, replay_runs

SCHEMA = "key string, timestamp timestamp, state string, open boolean, tag1 string, tag2 string, tag3 string, eventid string, streamid string"


def config(strategy):
    both = [{"name": "domain", "definition": "d"}, {"name": "device", "definition": "v"}]
    close = {"filter": "d", "tags": both}
    if strategy:
        close["multipleMatchStrategy"] = strategy
    return rules_from_dict(
        {
            "alertingDelay": "PT6H",
            "tags": {"tag1": "domain", "tag2": "device"},
            "states": [
                {
                    "name": "ledger",
                    "maxlatency": "PT2H",
                    "open": {"filter": "a", "timeout": "P10D", "requires": ["gate"], "tags": both},
                    "close": {"filter": "b", "tags": both[:1]},
                },
                {"name": "gate", "maxlatency": "P3D", "open": {"filter": "c", "timeout": "PT8H", "tags": both}, "close": close},
            ],
        }
    )


# key: lines of "run | state | time | open or close | domain | device". A run number says when the line arrived.
RUNS = ["2024-03-01T12:00:00Z", "2024-03-03T12:00:00Z", "2024-03-05T12:00:00Z", "2024-03-08T12:00:00Z", "2024-03-09T09:30:00Z", "2024-03-20T12:00:00Z"]
HISTORIES = {
    # The second ledger login comes after the GATE session has ended.
    "missing": """
        0 gate 03-01T08:00:00 open A x
        0 ledger 03-01T08:10:00 open A x
        0 ledger 03-01T08:20:00 close A -
        0 gate 03-01T09:00:00 close A x
        0 ledger 03-01T10:00:00 open A x
        0 ledger 03-01T10:05:00 close A -""",
    # The GATE login that covers the ledger login arrives two runs late, but within its three days.
    "late": """
        0 ledger 03-01T10:00:00 open A x
        1 ledger 03-01T10:05:00 close A -
        1 gate 03-01T09:00:00 open A x
        1 gate 03-01T11:00:00 close A x""",
    # It arrives after the ledger login has been judged: one alert, not two.
    "too late": """
        0 ledger 03-01T10:00:00 open A x
        3 gate 03-01T09:00:00 open A x
        3 gate 03-01T11:00:00 close A x""",
    # The only GATE session is in another domain.
    "other domain": """
        1 gate 03-03T08:00:00 open B x
        1 ledger 03-03T08:10:00 open A x
        1 gate 03-03T09:00:00 close B x""",
    # Without tags on the opening any GATE session will do.
    "no tags": """
        1 gate 03-03T08:00:00 open B x
        1 ledger 03-03T08:10:00 open - -
        1 gate 03-03T09:00:00 close B x""",
    # Two domains interleaved; each close ends its own.
    "interleaved": """
        0 gate 03-01T08:00:00 open A x
        0 gate 03-01T08:05:00 open B x
        0 ledger 03-01T08:20:00 open A x
        0 gate 03-01T08:30:00 close A x
        0 ledger 03-01T09:00:00 open B x
        0 gate 03-01T09:30:00 close B x""",
    # Two equal sessions, one close.
    "ambiguous": """
        0 gate 03-01T08:00:00 open A x
        0 gate 03-01T08:05:00 open A x
        1 gate 03-01T09:00:00 close A x
        1 ledger 03-01T10:00:00 open A x""",
    # A repeated close and a repeated line change nothing.
    "repeated": """
        0 gate 03-01T08:00:00 open A x
        0 gate 03-01T08:00:00 open A x
        0 ledger 03-01T08:30:00 open A x
        0 gate 03-01T09:00:00 close A x
        1 gate 03-01T09:00:00 close A x
        1 gate 03-01T09:30:00 close A x""",
    # First judged at the last run, more than ten days after it happened: timed out, no alert.
    "timed out": """
        5 ledger 03-09T10:00:00 open A x""",
    # Judged at run 5, eleven days after run 4; it happened after run 4 less three days, so it still alerts.
    "long pause": """
        5 ledger 03-15T10:00:00 open A x""",
    # Arrives when its three days had already passed at the run before: judged, but no alert.
    "arrives stale": """
        4 ledger 03-05T09:00:00 open A x""",
}
ALERTS = {
    "warn": {"missing", "too late", "other domain", "long pause"},
    "pop": {"missing", "too late", "other domain", "long pause"},
    "close": {"missing", "too late", "other domain", "long pause", "ambiguous"},
}


def lines():
    out = []
    for key, text in HISTORIES.items():
        for n, line in enumerate(text.split("\n")[1:]):
            run, state, time, action, domain, device = line.split()
            tag1, tag2 = (None if v == "-" else v for v in (domain, device))
            row = {
                "key": key, "timestamp": at(f"2024-{time}Z"), "state": state, "open": action == "open",
                "tag1": tag1, "tag2": tag2, "tag3": None, "eventid": None, "streamid": None,
            }
            out.append((int(run), row))
    return out


@pytest.mark.parametrize("strategy", ["warn", "pop", "close"])
def test_incremental_runs(spark, tmp_path, strategy):
    rules = config(None if strategy == "warn" else strategy)
    runs = [(at(now), [row for run, row in lines() if run == n]) for n, now in enumerate(RUNS)]
    expected = replay_runs(runs, rules, rules.horizon)

    store = MonitorStore(spark, str(tmp_path))
    alerts, warned = [], []
    for n, (now, arrived) in enumerate(runs):
        frame = spark.createDataFrame([tuple(r.values()) for r in arrived], SCHEMA)
        for _ in range(2 if n == 3 else 1):  # a repeated micro-batch changes nothing
            store.append(frame, n)
            found, warnings = store.run(rules, now.replace(tzinfo=timezone.utc), n)
        found = found.collect()
        new, keys = expected[n]
        assert {identity(r.asDict()): r.required_state for r in found} == {i: need for i, (need, out) in new.items() if out}
        assert {r.key for r in warnings.collect()} == keys
        alerts += [r.key for r in found]
        warned += sorted(keys)
    assert sorted(alerts) == sorted(ALERTS[strategy])
    assert warned == (["ambiguous"] if strategy == "warn" else [])


def test_one_run_over_everything(spark):
    rules = config("close")
    frame = spark.createDataFrame([tuple(r.values()) for _, r in lines()], SCHEMA)
    keys = {r.key for r in state_monitor(frame, rules, "2024-03-08T12:00:00Z").collect()}
    assert keys == {"missing", "other domain", "ambiguous", "arrives stale"}
    assert state_warnings(frame, config("pop"), "2024-03-08T12:00:00Z").count() == 0


def test_all_missing_requirements(spark):
    rules = rules_from_dict(
        {
            "states": [
                {"name": "a", "open": {"filter": "x", "requires": ["b", "c"]}, "maxlatency": "PT1H"},
                {"name": "b", "open": {"filter": "x"}, "maxlatency": "PT2H"},
                {"name": "c", "open": {"filter": "x"}, "maxlatency": "PT1H"},
            ]
        }
    )
    frame = spark.createDataFrame([("k", at("2024-01-01T00:00:00Z"), "a", True, None, None, None, "1", "1")], SCHEMA)
    when = {"2024-01-01T00:30:00Z": [], "2024-01-01T01:30:00Z": ["c"], "2024-01-01T03:00:00Z": ["b"]}
    for now, want in when.items():
        assert [r.required_state for r in judge(frame, rules, now).collect()] == want
    found = judge(frame, rules, "2024-01-01T03:00:00Z", all_missing=True).collect()
    assert sorted(r.required_state for r in found) == ["b", "c"]
