"""Alerts once, with the references of what was counted, also after a restart."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kestrelwatch.operators import normalise
from kestrelwatch.sources import readers
from kestrelwatch.streaming import rates

T0 = datetime(2024, 1, 1, 10)


def failure(i, ts, key="u", kind="Authentication Failure"):
    value = {"StreamId": "s", "EventId": str(i), "EventTime": {"TimeCreated": ts.strftime("%Y-%m-%dT%H:%M:%S.%fZ")}, "EventDetail": {"TypeId": kind}, "EventSource": {"User": {"Id": key}}}
    return key, json.dumps(value)


def feed(spark, path, batches, log, checkpoint, score, **options):
    """One micro-batch each, the query started anew for every one. Returns (batch, rows of hours, references by hour)."""
    out = []

    def sink(hours, batch):
        found = hours.collect()
        refs = {}
        for r in log.refs(hours, batch).collect():
            refs.setdefault((*(r[c] for c in log.by), r.window.start), []).append(r.eventref)
        out.append((batch, found, refs))

    for rows in batches:
        spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("append").parquet(path)
        events = normalise.parse_messages(readers.read_stream(spark, "parquet", path, "key string, value string"))
        query = rates.rate_alerts_once(events, score, log, sink, checkpoint, trigger={"availableNow": True}, **options)
        assert query.awaitTermination(300) and query.exception() is None
    return out


def five(hours):
    return hours.withColumn("prediction", F.lit(5.0))


def test_an_hour_that_grows_over_batches(spark, tmp_path):
    """Copies count once; the hour is reported when it passes ten, never again, with as many references as its count says."""
    first = [failure(i, T0 + timedelta(minutes=i)) for i in range(8)]
    second = [failure(i, T0 + timedelta(minutes=i)) for i in range(5, 14)] + [failure("x", T0, kind="Login")]
    third = [failure(i, T0 + timedelta(minutes=i)) for i in range(14, 20)] + [failure(f"n{i}", T0 + timedelta(minutes=61 + i)) for i in range(12)]
    log = rates.HourLog(spark, f"{tmp_path}/log")
    found = feed(spark, f"{tmp_path}/in", [first, second, third], log, f"{tmp_path}/cp", five)
    reports = [(r.window.start, r["count"], len(refs[(r.window.start,)]), len(set(refs[(r.window.start,)]))) for _, rows, refs in found for r in rows]
    assert reports == [(T0, 14, 14, 14), (T0 + timedelta(hours=1), 12, 12, 12)]
    ledger = spark.read.parquet(f"{tmp_path}/log/hours").orderBy("start").where(F.col("batch") == F.lit(max(b for b, *_ in found))).collect()
    assert [r["count"] for r in ledger] == [20, 12] and len(list((tmp_path / "log" / "hours").glob("batch=*"))) <= 2
    # The last batch again, as after a failure: the same report, and one copy of everything.
    last, rows, _ = found[-1] if found[-1][1] else found[-2]
    again = log.add(spark.createDataFrame([(T0 + timedelta(minutes=61 + i), "s", f"n{i}") for i in range(12)] + [(T0 + timedelta(minutes=i), "s", str(i)) for i in range(14, 20)], "timestamp timestamp, streamid string, eventid string"), last, five, 2, 10)
    assert [(r.window.start, r["count"]) for r in again.collect()] == [(r.window.start, r["count"]) for r in rows]
    assert log.refs(again).count() == 12


def test_entities_and_what_is_kept(spark, tmp_path):
    day = timedelta(days=1)
    batches = [
        [failure(f"a{i}", T0 + timedelta(minutes=i), "u") for i in range(11)] + [failure(f"b{i}", T0 + timedelta(minutes=i), None) for i in range(9)],
        [failure(f"c{i}", T0 + timedelta(minutes=11 + i), None) for i in range(3)],
        [failure(f"d{i}", T0 + 5 * day + timedelta(minutes=i), "v") for i in range(3)],
        [failure("late", datetime(1970, 1, 1), "u")],
    ]
    log = rates.HourLog(spark, f"{tmp_path}/log", ("key",), keep=2 * day)
    found = feed(spark, f"{tmp_path}/in", batches, log, f"{tmp_path}/cp", five)
    assert [(r.key, r["count"], len(refs[(r.key, r.window.start)])) for _, rows, refs in found for r in rows] == [("u", 11, 11), (None, 12, 12)]
    assert [(r.key, r["count"]) for r in log.before(10**9).collect()] == [("v", 3)]


def test_hours_must_be_kept_long_enough(spark, tmp_path):
    events = normalise.parse_messages(spark.createDataFrame([], "key string, value string"))
    with pytest.raises(ValueError):
        rates.rate_alerts_once(events, five, rates.HourLog(spark, "x", keep=timedelta(minutes=80)), lambda *_: None, "y")
