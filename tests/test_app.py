import json
from datetime import datetime, timedelta, timezone

from kestrelwatch import app
from kestrelwatch.operators.normalise import EVENT_SCHEMA
from kestrelwatch.sources.schema import save_schema
from kestrelwatch.streaming.detector import FAILURE

from test_streaming import T0, event, write

RULES = """
schemaFile: {schema}
alertingDelay: {delay}
eventId: Event.EventId
streamId: Event.StreamId
tags: {{tag1: domain}}
states:
  - name: mainframe
    maxlatency: PT1H
    open:
      filter: Event.EventSource.System.Name == 'main' and Event.EventDetail.TypeId == 'Login'
      requires: [vpn]
      tags: [{{name: domain, definition: Event.EventSource.System.Environment}}]
  - name: vpn
    maxlatency: PT2H
    open: {{filter: "Event.EventSource.System.Name == 'vpn' and Event.EventDetail.TypeId == 'Login'", tags: [{{name: domain, definition: Event.EventSource.System.Environment}}]}}
    close: {{filter: "Event.EventSource.System.Name == 'vpn' and Event.EventDetail.TypeId == 'Logout'", tags: []}}
"""


def test_monitor(spark, tmp_path):
    save_schema(EVENT_SCHEMA, str(tmp_path / "schema.json"))
    login = datetime.now(timezone.utc) - timedelta(hours=3)
    write(spark, str(tmp_path / "in"), [
        event(1, login, "u1", "main", "Login"),
        event(2, login, "u2", "vpn", "Login"),
        event(2, login, "u2", "vpn", "Login"),
        event(3, login + timedelta(minutes=1), "u2", "main", "Login"),
        event(4, login, "u3", "vpn", "Login"),
        event(5, login + timedelta(minutes=1), "u3", "vpn", "Login"),
        event(6, login + timedelta(minutes=2), "u3", "vpn", "Logout"),
    ])
    for delay, folder in (("-PT1H", "alerts"), ("PT1H", "suppressed")):
        path = tmp_path / f"{folder}.yml"
        path.write_text(RULES.format(schema=tmp_path / "schema.json", delay=delay))
        store = str(tmp_path / folder)
        app.main(["monitor", str(path), "--store", store, "--source", "parquet", "--path", str(tmp_path / "in"), "--once"])
        (line,) = spark.read.text(f"{store}/alerts/{folder}").collect()
        assert line.value.endswith(
            f"Required state vpn is missing for u1 while opening state mainframe,,analytic,StateMonitor,config,{folder}.yml,"
            "key,u1,state,mainframe,requiredState,vpn,domain,A,eventref,s:1"
        )
        (warning,) = spark.read.text(f"{store}/alerts/warnings").collect()
        assert "state of vpn-close" in warning.value and "eventid 6 from streamid s" in warning.value


def test_train_and_detect(spark, tmp_path):
    quiet = [event(f"{d}-{h}-{i}", T0 + timedelta(days=d, hours=h, minutes=i), "u", "main", FAILURE)
             for d in range(7) for h in range(24) for i in range(2 + h % 2)]
    spike = [event(f"x{i}", T0 + timedelta(days=7, hours=3, seconds=i), "u", "main", FAILURE) for i in range(50)]
    write(spark, str(tmp_path / "quiet"), quiet)
    write(spark, str(tmp_path / "spike"), spike)
    app.main(["train", str(tmp_path / "quiet"), "--models", str(tmp_path / "models")])
    app.main(["detect", "--models", str(tmp_path / "models"), "--source", "parquet", "--path", str(tmp_path / "spike"),
              "--events", str(tmp_path / "spike"), "--out", str(tmp_path / "out"), "--once"])
    (line,) = spark.read.text(str(tmp_path / "out")).collect()
    assert "Expected count:3. Actual count:50" in line.value and line.value.count("eventref") == 50
    assert json.loads(spike[0][1])["EventId"] == "x0"
