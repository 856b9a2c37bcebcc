from datetime import timedelta

import pytest

from kestrelwatch.functions.durations import parse_duration
from kestrelwatch.rules import load_rules, rules_from_dict

RULES = """
bootstrapServers: localhost:9092
topic: events
schemaFile: schema.json
alertingDelay: PT24H
interval: 60 seconds
eventId: Event.EventId
streamId: Event.StreamId
someAnnotationURL: http://localhost/annotations
tags:
  tag1: domain
  tag2: device
states:
  - name: mainframe
    maxlatency: PT1H
    open:
      filter: a = 1
      requires: [vpn]
      tags:
        - name: domain
          definition: x.y
  - name: vpn
    open:
      filter: b = 2
      timeout: PT12H
    close:
      filter: c = 3
      multipleMatchStrategy: pop
      tags:
        - name: device
          definition: x.z
"""


def test_load(tmp_path):
    path = tmp_path / "rules.yml"
    path.write_text(RULES)
    rules = load_rules(str(path))
    mainframe, vpn = rules.states
    assert rules.name == "rules.yml" and rules.interval == "60 seconds"
    assert mainframe.close is None and mainframe.strategy == "warn" and vpn.strategy == "pop"
    assert mainframe.open.timeout == timedelta(days=1) and vpn.open.timeout == timedelta(hours=12)
    assert mainframe.max_latency == timedelta(hours=1) and vpn.max_latency == timedelta(days=1)
    assert rules.horizon == timedelta(days=3)
    assert rules.tag_mask(mainframe.open) == 1 and rules.tag_mask(vpn.close) == 2
    assert rules.annotation_url == "http://localhost/annotations"


def states(**close):
    return {"states": [{"name": "a", "open": {"filter": "x"}, "close": {"filter": "y", **close}}]}


def test_unknown_strategy_warns(caplog):
    assert rules_from_dict(states(multipleMatchStrategy="other")).states[0].strategy == "warn"
    assert "state a:" in caplog.text and all(name in caplog.text for name in ("close", "pop", "warn"))


def test_unlisted_tag_is_an_error():
    spec = states(tags=[{"name": "domian", "definition": "d"}])
    with pytest.raises(ValueError, match="domian"):
        rules_from_dict({**spec, "tags": {"tag1": "domain"}})
    with pytest.raises(ValueError, match="domian"):
        rules_from_dict(spec)
    assert rules_from_dict({**spec, "tags": {"tag2": "domian"}}).tag_names[1] == "domian"


@pytest.mark.parametrize("broken", [{"interval": "5"}, {"interval": "minutes"}, {"tags": {"tag4": "x"}}, {"alertingDelay": "1 day"}])
def test_rejected(broken):
    with pytest.raises(ValueError):
        rules_from_dict({**states(), **broken})


def test_unknown_requirement():
    spec = states()
    spec["states"][0]["open"]["requires"] = ["b"]
    with pytest.raises(ValueError, match="b"):
        rules_from_dict(spec)


@pytest.mark.parametrize(
    "text,span",
    [
        ("PT1H", timedelta(hours=1)),
        ("P3D", timedelta(days=3)),
        ("P1DT2H3M4.5S", timedelta(days=1, hours=2, minutes=3, seconds=4.5)),
        ("PT0S", timedelta(0)),
        ("-PT10M", timedelta(minutes=-10)),
        ("pt15m", timedelta(minutes=15)),
    ],
)
def test_durations(text, span):
    assert parse_duration(text) == span


@pytest.mark.parametrize("text", ["", "P", "PT", "1D", "P1DT", "P1Y", "PT1D"])
def test_no_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)
