"""The state monitor as keyed state with event-time timers.

``monitor.monitor_stream`` judges tables, run by run. Here sub-keys have their own small histories instead, and a batch touches
only those near the ones that got rows or whose time has come. A sub-key is a key together with the tags that all opens and
closes of the monitored states and all openings that look for them set: rows that differ in one of those never meet, so the
state of a busy key is dealt over as many sub-keys as it has tag values.

Every call on state goes to the JVM and back, some twenty for a key and batch, and costs more than replaying a sub-key's few
rows. So the key of the state is a group, one of a fixed number into which sub-keys are dealt by hash; its calls serve all of its
sub-keys at once, and their number does not grow with the keys. For the same reason an element of a list is a JSON array of many
rows, and rows come in as JSON: a value that crosses by itself costs a hundred times what it costs in a text.

State of a group:
  waiting    list: rows that the watermark has not passed. Nothing can come before a row that it has passed, so the rows of a
             sub-key are replayed in their order, whatever order they arrived in.
  histories  list: one row per sub-key. The time of its latest replayed row, whether it has been warned about, and what is open,
             by state and tags. Under ``warn`` alike opens are one entry with a number, since from the second on no close can
             tell them apart; so it is bounded by the combinations of tags.
One timer per group stands at its earliest waiting row, or at the time when the first sub-key is forgotten if that comes earlier.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce
from itertools import batched
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from kestrelwatch.operators.state_monitor import IDENTITY
from kestrelwatch.operators.transitions import map_transitions
from kestrelwatch.rules import CLOSE_ALL, POP, TAG_SLOTS, WARN, RuleSet

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

OUTPUT = (
    "kind string, key string, timestamp timestamp, state string, tag1 string, tag2 string, tag3 string, eventid string, streamid string, "
    "required_state string, ambiguous_opens long"
)
#: An element of the two list states: a JSON array of at most ``SENT`` rows.
ROWS = "rows string"
FINDING = Row(*(part.split()[0] for part in OUTPUT.split(", ")))

#: Into how many groups sub-keys are dealt. A batch reads the whole state of a group that it touches.
GROUPS = 4096
#: Rows in an element of state.
SENT = 10_000


class Held(NamedTuple):
    """A row of ``waiting``."""

    key: str | None
    sub: str
    at: int
    streamid: str | None
    eventid: str | None
    open: bool
    rank: int
    tag1: str | None
    tag2: str | None
    tag3: str | None

    @classmethod
    def of(cls, words: list[str | None]) -> Held:
        key, sub, at, streamid, eventid, opens, rank, *tags = words
        return cls(key, sub, int(at), streamid, eventid, opens == "true", int(rank), *tags)

    def words(self) -> list[str | None]:
        """As ``keyed_findings`` gives them."""
        return [self.key, self.sub, str(self.at), self.streamid, self.eventid, "true" if self.open else "false", str(self.rank), *self[7:]]



def common_tags(rules: RuleSet) -> tuple[str, ...]:
    """The tag slots that everything sets which can meet: opens and closes of the required states, and the openings that need
    them. States that require each other across different tags share none, and then a key is one sub-key."""
    masks = [rules.tag_mask(s.open) for s in rules.requiring]
    for s in rules.required:
        masks += [rules.tag_mask(s.open)] + ([rules.tag_mask(s.close)] if s.close else [])
    common = reduce(lambda a, b: a & b, masks, (1 << len(TAG_SLOTS)) - 1)
    return tuple(t for i, t in enumerate(TAG_SLOTS) if common >> i & 1)


@dataclass(frozen=True)
class Plan:
    """What the rules come to, in plain values that every task gets."""

    names: tuple[str, ...]
    strategies: tuple[str, ...]
    required: tuple[bool, ...]
    needs: tuple[tuple[int, ...], ...]
    timeouts: tuple[int, ...]
    delay: int
    keep: int | None

    @classmethod
    def of(cls, rules: RuleSet, keep: timedelta | None) -> Plan:
        names = tuple(s.name for s in rules.states)
        wanted = {s.name for s in rules.required}
        return cls(
            names,
            tuple(s.strategy for s in rules.states),
            tuple(n in wanted for n in names),
            tuple(tuple(names.index(r) for r in s.open.requires) for s in rules.states),
            tuple(_micros(s.open.timeout) for s in rules.states),
            _micros(max(s.max_latency for s in rules.required)),
            None if keep is None else _micros(keep),
        )


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _time(micros: int) -> datetime:
    return datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=micros)


def place(row: Held) -> tuple:
    """Where a row stands in the history: the order of the batch monitor, nulls first."""
    words = [(w is not None, w or "") for w in (row.streamid, row.eventid)]
    return (row.at, *words, not row.open, row.rank, *((t is not None, t or "") for t in (row.tag1, row.tag2, row.tag3)))


class Opened:
    """What is open in a sub-key."""

    def __init__(self, plan: Plan, entries: list[list]) -> None:
        self.plan = plan
        # rank, tag1, tag2, tag3, time, number; oldest first
        self.entries = entries

    def found(self, rank: int, tags: tuple) -> list[list]:
        """The entries of a state that have all the tags that are set in ``tags``."""
        return [e for e in self.entries if e[0] == rank and all(t is None or t == own for t, own in zip(tags, e[1:4], strict=True))]

    def open(self, rank: int, tags: tuple, at: int) -> None:
        if self.plan.strategies[rank] == WARN:
            for entry in self.entries:
                if entry[0] == rank and tuple(entry[1:4]) == tags:
                    entry[5] += 1
                    return
        elif self.plan.strategies[rank] == CLOSE_ALL:
            # The same close ends them all: the latest stands for all.
            self.entries = [e for e in self.entries if e[0] != rank or tuple(e[1:4]) != tags]
        self.entries.append([rank, *tags, at, 1])

    def close(self, rank: int, tags: tuple) -> int | None:
        """Ends what the close finds. Returns how many there were where it could not choose."""
        found = self.found(rank, tags)
        number = sum(e[5] for e in found)
        strategy = self.plan.strategies[rank]
        if strategy == WARN and number > 1:
            return number
        gone = found[:1] if strategy == POP else found
        self.entries = [e for e in self.entries if not any(e is g for g in gone)]
        return None

    def expire(self, before: int) -> None:
        """Forgets what opened before a time; under ``warn`` entries stay, since they stand for several opens."""
        self.entries = [e for e in self.entries if e[4] >= before or self.plan.strategies[e[0]] == WARN]


def replay(plan: Plan, opened: Opened, rows: list[Held], as_of: int, warned: bool) -> Iterator[tuple[Held, str | None, int | None]]:
    """Rows with what they give rise to: a missing state for an opening, or a number of opens for the first ambiguous close."""
    before = None
    for row in rows:
        here = place(row)
        if here == before:
            continue
        before = here
        tags = (row.tag1, row.tag2, row.tag3)
        if plan.keep is not None:
            opened.expire(row.at - plan.keep)
        if not row.open:
            number = opened.close(row.rank, tags)
            if number is not None and not warned:
                warned = True
                yield row, None, number
            continue
        if plan.required[row.rank]:
            opened.open(row.rank, tags, row.at)
        for need in plan.needs[row.rank]:
            if not opened.found(need, tags):
                if as_of <= row.at + plan.timeouts[row.rank]:
                    yield row, plan.names[need], None
                break


def store(state, rows: Iterable[list]) -> None:
    """Replaces a list state."""
    parts = [(json.dumps(part),) for part in batched(rows, SENT)]
    if parts:
        state.put(parts)
    else:
        state.clear()


def stored(state) -> Iterator[list]:
    for (rows,) in state.get():
        yield from json.loads(rows)


class Monitor(StatefulProcessor):
    def __init__(self, plan: Plan) -> None:
        self.plan = plan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROWS)
        self.histories = handle.getListState("histories", ROWS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        for some in batched(rows, SENT):
            some = list(some)
            self.waiting.appendValue((f"[{','.join(r.row for r in some)}]",))
            earliest = min(r.at for r in some)
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.wake(first // 1000 + 1)
        return iter(())

    def wake(self, millis: int) -> None:
        """One timer, at the earliest time that was asked for."""
        standing = list(self.handle.listTimers())
        if standing and min(standing) <= millis:
            return
        for timer in standing:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(millis)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        keep = self.plan.keep
        ready: dict[tuple, list[Held]] = defaultdict(list)
        later = []
        for held in map(Held.of, stored(self.waiting)):
            if held.at <= passed:
                ready[held.key, held.sub].append(held)
            else:
                later.append(held)
        histories = {(k, sub): rest for k, sub, *rest in stored(self.histories)}
        for sub, rows in ready.items():
            rows.sort(key=place)
            last, warned, entries = histories.get(sub, (None, False, ()))
            opened = Opened(self.plan, list(entries))
            cuts = [] if keep is None else [i for i in range(1, len(rows)) if rows[i].at - rows[i - 1].at > keep]
            anew = keep is not None and last is not None and rows[0].at - last > keep
            for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                if a or anew:
                    # Quiet for longer than things are kept: begun anew, whether the timer came first or not.
                    opened, warned = Opened(self.plan, []), False
                for row, need, number in replay(self.plan, opened, rows[a:b], passed + self.plan.delay, warned):
                    warned = warned or number is not None
                    kind = "ambiguous" if need is None else "missing"
                    yield FINDING(kind, row.key, _time(row.at), self.plan.names[row.rank], row.tag1, row.tag2, row.tag3, row.eventid, row.streamid, need, number)
            histories[sub] = [rows[-1].at, warned, opened.entries]
        if ready:
            store(self.waiting, [h.words() for h in later])
        if keep is not None:
            histories = {sub: h for sub, h in histories.items() if h[0] + keep > passed}
        store(self.histories, [[*sub, *h] for sub, h in histories.items()])
        times = [h.at for h in later]
        if keep is not None:
            times += [h[0] + keep for h in histories.values()]
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1)

    def close(self) -> None:
        pass


def keyed_findings(events: DataFrame, rules: RuleSet, keep: timedelta | None = None, groups: int = GROUPS) -> DataFrame:
    """A stream of findings for a stream of parsed events, in append mode: rows of ``kind`` ``missing`` (an opening without the
    ``required_state``) and ``ambiguous`` (the first close of a sub-key that found ``ambiguous_opens`` opens), with the columns
    of the transition.

    Rows are replayed once the watermark, which stays behind the latest event by the longest latency of a required state, has
    passed them; later ones are dropped by Spark. So an opening is judged when all its latencies have passed, in the batch after
    the one that brought the time; it gives no alert if it had timed out by then. Equal rows count once.

    ``keep``: what is forgotten. An open of a ``pop`` or ``close`` state counts no longer than that, and a sub-key that is quiet
    for longer begins anew; so the state holds only what is recent. None keeps everything.

    ``groups``: into how many groups sub-keys are dealt; a checkpoint belongs to one number. What one group holds must fit into a
    task, so take more where there are more than some millions of sub-keys or waiting rows.

    A row without one of ``common_tags`` belongs to no sub-key and is an error; give rules in which not everything sets that
    tag, and keys are no longer split by it. Rows without a time cannot be placed and are left out; a null key is a key.
    """
    if not rules.requiring:
        raise ValueError("no state has a requirement; there is nothing to monitor")
    names = [s.name for s in rules.states]
    required, requiring = [s.name for s in rules.required], [s.name for s in rules.requiring]
    rows = map_transitions(events, rules).where(F.col("timestamp").isNotNull())
    rows = rows.where(F.col("state").isin(*required) | (F.col("open") & F.col("state").isin(*requiring)))
    rank = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])[F.col("state")]
    tags = common_tags(rules)
    sub = F.lit("")
    for tag in tags:
        there = F.when(F.col(tag).isNull(), F.raise_error(F.concat(F.lit(f"a row lacks {tag}, by which keys are split; its event is "), F.coalesce("eventid", F.lit("null")))))
        sub = F.concat(sub, there.otherwise(F.concat(F.length(tag).cast("string"), F.lit(":"), F.col(tag))))
    plan = Plan.of(rules, keep)
    at = F.unix_micros("timestamp")
    words = ["key", sub, at, "streamid", "eventid", "open", rank.cast("int"), *TAG_SLOTS]
    row = F.to_json(F.array(*[(F.col(w) if isinstance(w, str) else w).cast("string") for w in words]))
    rows = rows.withWatermark("timestamp", f"{plan.delay // 1000} milliseconds").select(
        F.pmod(F.xxhash64("key", sub), F.lit(groups)).cast("int").alias("group"), "timestamp", at.alias("at"), row.alias("row")
    )
    return rows.groupBy("group").transformWithState(Monitor(plan), StructType.fromDDL(OUTPUT), "Append", "EventTime")


def start(findings: DataFrame, sink, checkpoint: str, trigger: dict | None = None):
    """Starts the stream; ``sink(findings, batch_id)`` gets what each batch found. Keyed state of this kind needs Spark's RocksDB
    store, so that is what the query is started with."""
    spark = findings.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        return findings.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def missing(findings: DataFrame) -> DataFrame:
    """The openings to alert on, as the batch monitor gives them."""
    return findings.where("kind = 'missing'").select(*IDENTITY, "required_state")
