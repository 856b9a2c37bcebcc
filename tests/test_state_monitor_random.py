"""Random histories: the DataFrame operators must agree with the plain loop, on the plain and on the sliced path."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from kestrelwatch.operators import state_monitor as sm
from kestrelwatch.rules import rules_from_dict
from kestrelwatch.streaming.monitor import MonitorStore

from replay_model import identity, replay, replay_runs

START = datetime(2024, 1, 1)
NOW = START + timedelta(hours=20)
SCHEMA = "key string, timestamp timestamp, state string, open boolean, tag1 string, tag2 string, tag3 string, eventid string, streamid string"


def rules(vpn, badge="warn", close_tags=("domain", "device")):
    tag = {"domain": "d", "device": "v"}

    def tags(names):
        return [{"name": n, "definition": tag[n]} for n in names]

    return rules_from_dict(
        {
            "tags": {"tag1": "domain", "tag2": "device"},
            "states": [
                {
                    "name": "mainframe",
                    "maxlatency": "PT1H",
                    "open": {"filter": "a", "timeout": "PT15H", "requires": ["vpn", "badge"], "tags": tags(["domain", "device"])},
                    "close": {"filter": "b", "tags": tags(["domain"])},
                },
                {
                    "name": "vpn",
                    "maxlatency": "PT3H",
                    "open": {"filter": "c", "tags": tags(["domain", "device"])},
                    "close": {"filter": "d", "tags": tags(close_tags), "multipleMatchStrategy": vpn},
                },
                {
                    "name": "badge",
                    "maxlatency": "PT2H",
                    "open": {"filter": "e", "requires": ["badge"], "tags": tags(["domain"])},
                    "close": {"filter": "f", "tags": tags([]), "multipleMatchStrategy": badge},
                },
            ],
        }
    )


def history(rng, rule_set, keys, rows, gaps):
    """``gaps``: how often a tag that the rule defines is missing."""
    out = []
    for key in range(keys):
        for i in range(rng.randint(1, rows)):
            state = rng.choice(rule_set.states)
            is_open = rng.random() < 0.55
            defined = (state.open if is_open else state.close).tags
            row = {
                "key": None if key == 0 else f"User{key}",
                "timestamp": START + timedelta(minutes=rng.randint(0, 1200) // 3 * 3),
                "state": state.name,
                "open": is_open,
                "tag1": rng.choice("ab") if "domain" in defined and rng.random() >= gaps else None,
                "tag2": rng.choice("xy") if "device" in defined and rng.random() >= gaps else None,
                "tag3": None,
                "eventid": rng.choice([None, str(i), str(i % 5)]),
                "streamid": rng.choice([None, "1", "2"]),
            }
            out += [row] * rng.choice([1, 1, 1, 2])
    return out


CASES = [
    (strategy, close_tags, gaps)
    for strategy in ("close", "pop", "warn")
    for close_tags, gaps in [(("domain", "device"), 0.0), (("domain",), 0.0), (("domain", "device"), 0.2), ((), 0.1)]
]


SLICED = [case for case in CASES if case[2] == 0.2 or case in (("pop", ("domain",), 0.0), ("warn", (), 0.1))]


@pytest.mark.parametrize(
    "strategy,close_tags,gaps,hot_rows", [(*c, 10**9) for c in CASES] + [(*c, 25) for c in SLICED]
)
def test_agrees_with_loop(spark, strategy, close_tags, gaps, hot_rows):
    rng = random.Random(f"{strategy}{close_tags}{gaps}")
    rule_set = rules(strategy, rng.choice(["close", "pop", "warn"]), close_tags)
    rows = history(rng, rule_set, 12, 70, gaps)
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3)
    profile = sm.profile_transitions(frame, rule_set, hot_rows=hot_rows, slice_seconds=2 * 3600)
    assert bool(profile.hot) == (hot_rows == 25)

    expected, warnings = {}, {}
    for key in {r["key"] for r in rows}:
        found, warned = replay([r for r in rows if r["key"] == key], rule_set, NOW)
        expected.update(found)
        if warned:
            warnings[key] = warned
    judged = {identity(r.asDict()): (r.required_state, r.emitted) for r in sm.judge(frame, rule_set, NOW, profile=profile).collect()}
    assert judged == expected
    emitted = {identity(r.asDict()): r.required_state for r in sm.state_monitor(frame, rule_set, NOW, profile=profile).collect()}
    assert emitted == {k: need for k, (need, out) in expected.items() if out}
    found = sm.state_warnings(frame, rule_set, NOW, profile=profile).collect()
    assert {r.key: (identity(r.asDict()), r.ambiguous_opens) for r in found} == {
        k: (close, len(opens)) for k, (close, opens) in warnings.items()
    }
    opens = [identity(r.asDict()) for r in sm.ambiguous_opens(frame, rule_set, NOW, profile).collect()]
    assert sorted(opens, key=repr) == sorted((o for _, found in warnings.values() for o in found), key=repr)


@pytest.mark.parametrize("strategy,hot_rows", [("pop", 10**9), ("warn", 20)])
def test_runs_agree_with_loop(spark, tmp_path, strategy, hot_rows):
    """Rows that arrive late and out of order over several runs, of which each reads only what is due."""
    rng = random.Random(strategy)
    rule_set = rules(strategy, "warn")
    times = [START + timedelta(hours=h) for h in (4, 7, 8, 20)]
    arrivals = [[] for _ in times]
    for row in history(rng, rule_set, 14, 60, 0.1):
        first = next((i for i, t in enumerate(times) if t >= row["timestamp"]), len(times) - 1)
        arrivals[min(len(times) - 1, first + rng.choice([0, 0, 0, 1, 2]))].append(row)
    expected = replay_runs([(t, rows) for t, rows in zip(times, arrivals)], rule_set, rule_set.horizon)
    store = MonitorStore(spark, str(tmp_path))
    total = 0
    for n, (now, rows) in enumerate(zip(times, arrivals)):
        store.append(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), n)
        found, warnings = store.run(rule_set, now.replace(tzinfo=timezone.utc), n, hot_rows)
        new, keys = expected[n]
        got = {identity(r.asDict()): r.required_state for r in found.collect()}
        assert got == {i: need for i, (need, out) in new.items() if out}
        assert {r.key for r in warnings.collect()} == keys
        total += len(got)
    assert total > 20


def test_a_run_replays_once(spark, tmp_path, monkeypatch):
    """A run's alerts and warnings come out of one replay of its rows; before, each replayed them."""
    rule_set, replays, histories = rules("warn"), [], sm._histories
    monkeypatch.setattr(sm, "_histories", lambda *args: replays.append(1) or histories(*args))
    store = MonitorStore(spark, str(tmp_path))
    store.append(spark.createDataFrame([tuple(r.values()) for r in history(random.Random(7), rule_set, 9, 40, 0.1)], SCHEMA), 0)
    found, warnings = store.run(rule_set, NOW.replace(tzinfo=timezone.utc), 0)
    assert found.count() > 0 and warnings.count() > 0
    assert len(replays) == 1


@pytest.mark.parametrize("case,hot_rows", [(CASES[0], 10**9), (CASES[6], 10**9), (CASES[6], 25), (CASES[10], 10**9), (CASES[11], 25)])
def test_one_replay_finds_what_two_find(spark, case, hot_rows):
    strategy, close_tags, gaps = case
    rng = random.Random(repr(case))
    rule_set = rules(strategy, rng.choice(["close", "pop", "warn"]), close_tags)
    frame = spark.createDataFrame([tuple(r.values()) for r in history(rng, rule_set, 12, 70, gaps)], SCHEMA).repartition(3)
    for now in (NOW, START + timedelta(hours=9)):
        profile = sm.profile_transitions(frame, rule_set, hot_rows=hot_rows, slice_seconds=2 * 3600)
        both = sm.judge_and_warn(frame, rule_set, now, profile).cache()
        judged = sm.verdicts(both, rule_set, now)
        assert sorted(map(repr, judged.collect())) == sorted(map(repr, sm.judge(frame, rule_set, now, profile=profile).collect()))
        warned = sm.first_warnings(both, rule_set)
        want = sm.state_warnings(frame, rule_set, now, profile=profile).select(*warned.columns)
        assert sorted(map(repr, warned.collect())) == sorted(map(repr, want.collect()))
        assert judged.count() > 0
        both.unpersist()


@pytest.mark.parametrize("strategy", ["warn", "pop"])
def test_mixed_closes_take_linear_time(strategy):
    """One group of 100,000 transitions whose closes set different tags, most of them stuck: seconds, without Spark."""
    import time

    import pandas as pd

    rng = random.Random(3)

    def rows(n):
        for i in range(n):
            is_open = rng.random() < 0.6
            yield {
                "key": "k", "state": "gate", "_g0": "d", "_g1": None, "_g2": None, "_pos": i, "open": is_open, "tag1": "d",
                "tag2": rng.choice(["x", "y", "z"]) if is_open or rng.random() < 0.5 else None, "tag3": None, "_end": None, "_ambiguous": None,
            }

    seconds = []
    for n in (20_000, 100_000):
        frame = pd.DataFrame(list(rows(n)))
        start = time.process_time()
        out = pd.concat(sm._replay({"gate": strategy}, {"gate": (1, 3)})(iter([frame[:7], frame[7:]])))
        seconds.append(time.process_time() - start)
        assert len(out) == n and out["_pos"].nunique() == n
    assert seconds[1] < 60 and seconds[1] < 5 * 2.5 * seconds[0]
