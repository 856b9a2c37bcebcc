"""Rule configuration for the state monitor: states, what opens and closes them, what they require."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field
from datetime import timedelta
from typing import Any

from kestrelwatch.functions.durations import parse_duration, parse_interval

log = logging.getLogger(__name__)

# Fixed values of the rule format.
WARN, POP, CLOSE_ALL = "warn", "pop", "close"
DEFAULT_DURATION = "P1D"
DEFAULT_INTERVAL = "5 minutes"
TAG_SLOTS = ("tag1", "tag2", "tag3")


@dataclass(frozen=True)
class Transition:
    """A SQL predicate that spots the event, and the SQL that reads its tags."""

    filter: str
    tags: dict[str, str] = field(default_factory=dict)
    requires: tuple[str, ...] = ()
    timeout: timedelta = parse_duration(DEFAULT_DURATION)


@dataclass(frozen=True)
class State:
    name: str
    open: Transition
    close: Transition | None = None
    max_latency: timedelta = parse_duration(DEFAULT_DURATION)
    strategy: str = WARN


@dataclass(frozen=True)
class RuleSet:
    name: str
    states: tuple[State, ...]
    tag_names: tuple[str | None, str | None, str | None] = (None, None, None)
    alerting_delay: timedelta = timedelta(0)
    event_id: str | None = None
    stream_id: str | None = None
    interval: str = DEFAULT_INTERVAL
    topic: str | None = None
    bootstrap_servers: str | None = None
    schema_file: str | None = None
    alert_file: str | None = None
    annotation_url: str | None = None

    def state(self, name: str) -> State:
        return next(s for s in self.states if s.name == name)

    @property
    def requiring(self) -> list[State]:
        return [s for s in self.states if s.open.requires]

    @property
    def required(self) -> list[State]:
        wanted = {r for s in self.states for r in s.open.requires}
        return [s for s in self.states if s.name in wanted]

    @property
    def horizon(self) -> timedelta:
        """How far before the last run a transition can still matter."""
        return 2 * max(s.max_latency for s in self.states) + self.alerting_delay

    def tag_mask(self, transition: Transition) -> int:
        """Bit i is set when the transition defines a value for tag slot i."""
        return sum(1 << i for i, name in enumerate(self.tag_names) if name is not None and name in transition.tags)


def _transition(spec: dict[str, Any]) -> Transition:
    tags: dict[str, str] = {}
    for tag in spec.get("tags") or ():
        tags.setdefault(tag["name"], tag["definition"])
    return Transition(
        filter=spec["filter"],
        tags=tags,
        requires=tuple(spec.get("requires") or ()),
        timeout=parse_duration(spec.get("timeout") or DEFAULT_DURATION),
    )


def _state(spec: dict[str, Any]) -> State:
    close = spec.get("close")
    strategy = (close or {}).get("multipleMatchStrategy") or WARN
    if strategy not in (WARN, POP, CLOSE_ALL):
        log.error("state %s: multipleMatchStrategy is %r, which is none of %s, %s, %s; taking %s", spec["name"], strategy, CLOSE_ALL, POP, WARN, WARN)
        strategy = WARN
    return State(
        name=spec["name"],
        open=_transition(spec["open"]),
        close=_transition(close) if close else None,
        max_latency=parse_duration(spec.get("maxlatency") or DEFAULT_DURATION),
        strategy=strategy,
    )


def rules_from_dict(spec: dict[str, Any], name: str = "rules") -> RuleSet:
    """Build and check a rule set from parsed YAML or JSON."""
    by_name: dict[str, State] = {}
    for one in spec["states"]:
        by_name.setdefault(one["name"], _state(one))
    unknown = {r for s in by_name.values() for r in s.open.requires} - set(by_name)
    if unknown:
        raise ValueError(f"states that are required but missing from the rules: {sorted(unknown)}")
    tags = spec.get("tags") or {}
    if set(tags) - set(TAG_SLOTS):
        raise ValueError(f"tags must be named by the slots {', '.join(TAG_SLOTS)}")
    for state in by_name.values():
        for transition in (state.open, state.close):
            # A misspelt tag would put nothing into any slot, and every open would then satisfy the requirement.
            if transition is not None and set(transition.tags) - set(tags.values()):
                raise ValueError(f"state {state.name} uses tags that the rules do not list: {sorted(set(transition.tags) - set(tags.values()))}")
    return RuleSet(
        name=name,
        states=tuple(by_name.values()),
        tag_names=tuple(tags.get(slot) for slot in TAG_SLOTS),
        alerting_delay=parse_duration(spec.get("alertingDelay") or "PT0S"),
        event_id=spec.get("eventId"),
        stream_id=spec.get("streamId"),
        interval=parse_interval(spec.get("interval") or DEFAULT_INTERVAL),
        topic=spec.get("topic"),
        bootstrap_servers=spec.get("bootstrapServers"),
        schema_file=spec.get("schemaFile"),
        alert_file=spec.get("alertFile"),
        annotation_url=next((v for k, v in spec.items() if k.lower().endswith("annotationurl")), None),
    )


def load_rules(path: str) -> RuleSet:
    """Read a rule file: YAML where PyYAML is installed, JSON otherwise."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    try:
        import yaml
    except ImportError:
        spec = json.loads(text)
    else:
        spec = yaml.safe_load(text)
    return rules_from_dict(spec, os.path.basename(path))
