import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kestrelwatch.operators import normalise
from kestrelwatch.operators.alerts import ALERT_COLUMNS
from kestrelwatch.session import materialise, shared_dir
from kestrelwatch.sources import readers, writers
from kestrelwatch.streaming import monitor
from kestrelwatch.sources.schema import discover_schema, load_schema, save_schema

ALERTS = "time string, title string, description string, detail string, props array<struct<name:string,value:string>>, eventrefs array<string>"


def test_feed_lines_are_numbered_across_blocks(spark, tmp_path):
    path = tmp_path / "VPN.txt"
    path.write_text("".join(f"2024-01-01T00:{i // 60 % 60:02}:{i % 60:02}.000Z, Login, User{i}, Device{i % 3}\n" for i in range(2000)))
    (tmp_path / "OTHER.txt").write_text("2024-01-01T00:00:00.000Z, Logout, User1, Device1\nno time, Login, User2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        feed = normalise.number_lines(readers.read_feed(spark, str(tmp_path), ("user", "device")))
        rows = feed.collect()
        assert feed.select("file", "block").distinct().count() > 5
        events = normalise.normalise_feed(feed, "VPN", F.lit("live")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 2002
    for r in rows:
        if r.file.endswith("/VPN.txt"):
            assert r.user == f"User{r.line - 1}" and r.device == f"Device{(r.line - 1) % 3}"
    odd = next(r for r in rows if r.user == "User2" and r.file.endswith("/OTHER.txt"))
    assert odd.line == 2 and odd.timestamp is None and odd.device is None
    one = next(r for r in events if r.eventid == "62" and r.streamid.endswith("/VPN.txt"))
    assert one.key == one.Event.EventSource.User.Id == "User61"
    assert one.Event.EventTime.TimeCreated == "2024-01-01T00:01:01.000000Z"
    assert one.Event.EventSource.System.Environment == "live" and one.timestamp == datetime(2024, 1, 1, 0, 1, 1)


def test_feeds_of_one_name_in_two_folders(spark, tmp_path):
    for folder in ("f1", "f2"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.csv").write_text(f"2024-01-01T00:00:00Z, Login, User{folder}\n")
    apart = [normalise.normalise_feed(normalise.number_lines(readers.read_feed(spark, str(tmp_path / f))), "VPN") for f in ("f1", "f2")]
    assert normalise.dedup_events(apart[0].unionByName(apart[1])).count() == 2
    together = normalise.normalise_feed(normalise.number_lines(readers.read_feed(spark, str(tmp_path / "*"))), "VPN").collect()
    assert len({r.streamid for r in together}) == 2 and {r.eventid for r in together} == {"1"}


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_days_are_those_of_utc(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = ["2024-01-09T00:30:00Z", "2024-01-09T23:30:00Z", "2024-01-08T23:59:00Z", "2024-01-10T00:01:00Z"]
        events = spark.createDataFrame([("k", t, str(i)) for i, t in enumerate(times)], "key string, t string, eventid string")
        events = events.select("key", F.col("t").cast("timestamp").alias("timestamp"), normalise.event_struct({"EventId": F.col("eventid")}).alias("Event"))
        writers.store_events(events, str(tmp_path / "e"))
        found = readers.read_events(spark, str(tmp_path / "e"), "2024-01-09T00:00:00.000Z", "2024-01-10T00:00:00.000Z")
        assert sorted(r.idxEventTime[:16] for r in found.collect()) == ["2024-01-09T00:30", "2024-01-09T23:30"]
        capped = readers.read_events(spark, str(tmp_path / "e"), "2024-01-09T00:00:00.000Z", max_results=1)
        assert [r.idxEventTime[:16] for r in capped.collect()] == ["2024-01-09T00:30"]
        rows = events.select("key", "timestamp", F.lit("s").alias("state"), F.lit(True).alias("open"), *[F.lit(None).cast("string").alias(f"tag{i}") for i in (1, 2, 3)], "Event.EventId")
        monitor.MonitorStore(spark, str(tmp_path / "m")).append(rows.withColumnRenamed("EventId", "eventid").withColumn("streamid", F.lit("x")), 0)
        days = {p.name for p in (tmp_path / "m" / "transitions").glob("date=*")}
        assert days == {"date=2024-01-08", "date=2024-01-09", "date=2024-01-10"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_feed_with_users_only(spark, tmp_path):
    (tmp_path / "m.txt").write_text("2024-01-01T00:00:00Z, Authentication Failure, User1\n")
    feed = normalise.number_lines(readers.read_feed(spark, str(tmp_path)))
    event = normalise.normalise_feed(feed, "MAINFRAME").first()
    assert event.Event.EventDetail.Authenticate.Outcome.Success == "false"
    assert event.Event.EventSource.Client.HostName is None


def test_truth_and_transitions(spark, tmp_path):
    (tmp_path / "truth.out").write_text("Compromised Login, 2024-01-01T07:32:33Z, Login, User87\n")
    row = readers.read_truth(spark, str(tmp_path / "truth.out")).first()
    assert (row.label, row.operation, row.entity) == ("Compromised Login", "Login", "User87")
    (tmp_path / "t.csv").write_text(
        "2024-01-01T08:00:00Z\nvpn,2024-01-01T07:00:00.5Z, Login, User1, A, x\nmainframe,2024-01-01T07:01:00Z, Logout, User1\n"
    )
    a, b = readers.read_transitions(spark, str(tmp_path / "t.csv")).orderBy("timestamp").collect()
    assert (a.state, a.open, a.key, a.tag1, a.tag2) == ("vpn", True, "User1", "A", "x")
    assert (b.state, b.open, b.tag1) == ("mainframe", False, None)


def test_stored_events_push_down(spark, tmp_path):
    rows = [(f"2024-01-0{d}T00:00:00.000Z", kind, "{}") for d in range(1, 6) for kind in ("a", "b")]
    spark.createDataFrame(rows, "idxEventTime string, idxDescription string, json string").write.parquet(str(tmp_path / "e"))
    found = readers.read_events(spark, str(tmp_path / "e"), "2024-01-01T00:00:00.000Z", "2024-01-05T00:00:00.000Z", "a", 2)
    assert [r.idxEventTime[:10] for r in found.collect()] == ["2024-01-02", "2024-01-03"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        found = readers.read_events(spark, str(tmp_path / "e"), "2024-01-01T00:00:00.000Z", "2024-01-05T00:00:00.000Z", "a", 2)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    for pushed in ("GreaterThan(idxEventTime", "LessThan(idxEventTime", "EqualTo(idxDescription,a)"):
        assert pushed in plan


def test_many_results(spark):
    rows = spark.range(5000).select(
        F.date_format(F.timestamp_seconds(1704067200 + F.pmod(F.col("id") * 7919, F.lit(5000)) * 60), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("idxEventTime"),
        F.lit("a").alias("idxDescription"), F.col("id").cast("string").alias("json"))
    every = sorted(r.idxEventTime for r in rows.collect())
    for n in (1500, 4999, 5000, 9000):
        assert [r.idxEventTime for r in readers.select_events(rows, max_results=n).collect()] == every[:n]


def test_schema_file(spark, tmp_path):
    df = spark.createDataFrame([('{"b": {"c": "x"}, "a": 1}',), (None,), ('{"a": 2.5}',)], "json string")
    schema = discover_schema(df)
    assert schema.simpleString() == "struct<a:double,b:struct<c:string>>"
    path = str(tmp_path / "schema.json")
    save_schema(schema, path)
    assert load_schema(path) == schema
    text = open(path).read()
    assert text == json.dumps(json.loads(schema.json()), indent=4, sort_keys=True)
    assert discover_schema(df, sample=1.0) == schema
    rows = ['{"a": {"b c": 1, "d": [1, 2]}, "x": true}', '{"a": {"d": [2.5], "e": null}, "x": "t"}', "no json", '{"a": null, "z": [{"k": "v"}]}']
    found = discover_schema(spark.createDataFrame([(r,) for r in rows], "json string"))
    assert found.simpleString() == "struct<a:struct<b c:bigint,d:array<double>,e:string>,x:string,z:array<struct<k:string>>>"
    assert discover_schema(df.filter("false")).fields == []


def test_alert_batches_replace_themselves(spark, tmp_path):
    df = spark.createDataFrame([("t", "a", "b", "c", [("n", "v")], ["1:1"])], ALERTS)
    for _ in range(2):
        writers.write_alert_lines(df, str(tmp_path / "lines"), 4)
        writers.write_alert_rows(df, str(tmp_path / "rows"), 4)
    writers.write_alert_lines(df, str(tmp_path / "lines"), 5)
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).select("value").collect()] == ["t,a,b,c,n,v,eventref,1:1"] * 2
    assert spark.read.parquet(str(tmp_path / "rows")).select(*ALERT_COLUMNS).count() == 1
    writers.write_alert_lines(df, str(tmp_path / "more"))
    writers.write_alert_lines(df, str(tmp_path / "more"))
    assert spark.read.text(str(tmp_path / "more")).count() == 2


def test_fan_out_needs_both(spark):
    seen = []

    def fails(df, batch_id):
        raise OSError("no space")

    write = writers.fan_out(lambda df, i: seen.append(df.count()), lambda df, i: seen.append(i))
    write(spark.range(3), 7)
    assert seen == [3, 7]
    with pytest.raises(OSError):
        writers.fan_out(lambda df, i: None, fails)(spark.range(1), 1)


def test_kafka_options():
    found = readers.kafka_options("host:9092", "events", "earliest")
    assert found == {
        "kafka.bootstrap.servers": "host:9092", "subscribe": "events", "startingOffsets": "earliest",
        "includeHeaders": "true", "failOnDataLoss": "false",
    }


def test_materialise_uses_the_shared_folder(spark):
    df = materialise(spark.range(5), "five")
    assert df.count() == 5 and df.inputFiles()[0].startswith(f"file://{shared_dir(spark)}/five-")


def test_store_and_search_events(spark, tmp_path):
    events = spark.range(96).select(
        F.lit("k").alias("key"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("timestamp"),
        F.when(F.col("id") % 2 == 0, "Login").otherwise("Logout").alias("kind"),
        F.col("id").cast("string").alias("eventid"),
    ).withColumn("Event", normalise.event_struct({"EventDetail.TypeId": F.col("kind"), "EventId": F.col("eventid")}))
    writers.store_events(events, str(tmp_path / "e"))
    found = readers.read_events(spark, str(tmp_path / "e"), "2024-01-02T00:00:00.000Z", "2024-01-03T00:00:00.000Z", "Login")
    assert found.count() == 11 and {str(r.date) for r in found.collect()} == {"2024-01-02"}
    assert "PartitionFilters: [isnotnull(date" in found._jdf.queryExecution().executedPlan().toString()
    assert discover_schema(found).simpleString() == "struct<EventDetail:struct<TypeId:string>,EventId:string>"


def test_feed_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "VPN.txt").write_text("2024-01-01T00:00:00.000Z, Login, User1, Device1\n")
    feed = readers.read_feed(spark, str(tmp_path / "in"), ("user", "device"), streaming=True)
    writers.run_available(feed, lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/b={i}"), str(tmp_path / "cp"))
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row.user, row.device, row.timestamp) == ("User1", "Device1", datetime(2024, 1, 1)) and row.file.endswith("/VPN.txt")


def test_files_of_a_stream_grow_with_the_table():
    """As many as tasks should read a part, the same for all parts; few where a part could not fill them."""
    from kestrelwatch.plans import tables

    assert [tables.files_per_part([n] * 5) for n in (0, 20_000, 1_200_000, 7_200_000)] == [4, 4, 12, 72]
    assert tables.files_per_part([6_000_000, 5, 5, 5, 5]) == tables.files_per_part([6_000_000]) == tables.files_per_part([]) == 4
