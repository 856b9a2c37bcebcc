"""State monitor: find states that open while a state they require is not open.

A key's transitions are replayed in time order. An open adds to the open set; a close removes the opens of its state
that carry all tags set on the close. Several matches are ambiguous: ``close`` removes them all, ``pop`` the oldest,
``warn`` none. An opening transition alerts on the first of its required states that has no open with all the tags the
transition sets, once the latency allowed for that state has passed.

Here the replay is a few running aggregates. First every open gets the position at which it ends (``_end``); then the
largest ``_end`` among earlier opens of the required state tells whether one is still open at a given transition.

How each strategy fixes ``_end``, within one (key, state, tags set on the close):
  close  the next close.
  pop    opens are served first in, first out, so the i-th open ends at the i-th close that found something to close.
  warn   at most one open is outstanding until two opens follow each other; from there on nothing closes any more.

``pop`` and ``warn`` need the closes of a (key, state) to set the same tags. Where they do not, e.g. a device missing in
some events, the rows of that (key, state) which share the tags that all closes set are replayed one by one, streamed
from sorted partitions.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelwatch.functions.durations import plus
from kestrelwatch.operators.scan import (
    DEFAULT_HOT_ROWS,
    DEFAULT_SLICE_SECONDS,
    HotKeys,
    Spec,
    scan,
    split_scan,
    time_slice,
)
from kestrelwatch.rules import CLOSE_ALL, POP, TAG_SLOTS, WARN, RuleSet, State

TRANSITION_COLUMNS = ("key", "timestamp", "state", "open", *TAG_SLOTS, "eventid", "streamid")
IDENTITY = tuple(c for c in TRANSITION_COLUMNS if c != "open")
NEVER = 2**63 - 1
AMBIGUOUS = -1
_ROWS_PER_SLICE = 2**32


# ------------------------------------------------------------------------------------------------------------ profile
@dataclass(frozen=True)
class Profile:
    """What one look at the data tells about how to run: all of it bounded by the rules or by rows / hot_rows.

    ``probe_masks``: per required state, the tag combinations that openings requiring it set.
    ``close_masks``: per state, the tag combinations that its closes set.
    """

    hot: HotKeys = HotKeys()
    probe_masks: dict[str, tuple[int, ...]] = field(default_factory=dict)
    close_masks: dict[str, tuple[int, ...]] = field(default_factory=dict)
    slice_seconds: int = DEFAULT_SLICE_SECONDS


ALL_MASKS = tuple(range(1 << len(TAG_SLOTS)))


def _mask_of_row() -> Column:
    """Bit i is set when tag slot i has a value."""
    bits = [F.when(F.col(t).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(TAG_SLOTS)]
    return reduce(lambda a, b: a + b, bits)


def assume_anything(rules: RuleSet) -> Profile:
    """A profile that costs no job: any tag may be missing anywhere; no hot keys."""
    return Profile(HotKeys(), {s.name: ALL_MASKS for s in rules.required}, {s.name: ALL_MASKS for s in rules.states})


def profile_transitions(
    transitions: DataFrame,
    rules: RuleSet,
    hot_rows: int = DEFAULT_HOT_ROWS,
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> Profile:
    """One job over the transitions. Everything is combined per key before the shuffle; one row comes back, with at
    most (rows / hot_rows) keys in it."""
    bit = F.call_function("shiftleft", F.lit(1), _mask_of_row())
    seen: dict[tuple[str, str], Column] = {}
    for r in rules.required:
        openers = [s.name for s in rules.requiring if r.name in s.open.requires]
        seen["probe", r.name] = F.when(F.col("open") & F.col("state").isin(*openers), bit)
    for s in rules.states:
        seen["close", s.name] = F.when(~F.col("open") & (F.col("state") == s.name), bit)
    per_key = transitions.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), *[F.bit_or(c).alias(f"m{i}") for i, c in enumerate(seen.values())]
    )
    is_hot = F.col("n") > hot_rows
    row = per_key.agg(
        F.collect_list(F.when(is_hot, F.col("key"))).alias("hot"),
        F.max(is_hot & F.col("key").isNull()).alias("hot_null"),
        *[F.bit_or(f"m{i}").alias(f"m{i}") for i in range(len(seen))],
    ).first()
    masks = {k: tuple(m for m in ALL_MASKS if (row[f"m{i}"] or 0) >> m & 1) for i, k in enumerate(seen)}
    return Profile(
        HotKeys(tuple(row["hot"]), bool(row["hot_null"])),
        {name: found for (kind, name), found in masks.items() if kind == "probe"},
        {name: found for (kind, name), found in masks.items() if kind == "close"},
        slice_seconds,
    )


# ---------------------------------------------------------------------------------------------------------- positions
def _state_rank(rules: RuleSet) -> Column:
    return F.create_map(*[x for i, s in enumerate(rules.states) for x in (F.lit(s.name), F.lit(i))])[F.col("state")]


def _with_positions(transitions: DataFrame, rules: RuleSet, slice_col: str | None) -> DataFrame:
    """Distinct rows with ``_pos``, their place in the key's history.

    The one shuffle of the plan is here, by key (and slice); every later window groups by more columns than that and
    needs no other. Order: time, stream id, event id, opens before closes, states as configured, tags. All its partitions
    are kept: coalesced ones are often one or two more than there are cores, and the last ones are then waited for alone.
    """
    partitions = int(transitions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = ["key", slice_col] if slice_col else ["key"]
    order = ["timestamp", "streamid", "eventid", F.desc("open"), _state_rank(rules), *TAG_SLOTS]
    w = Window.partitionBy(*part).orderBy(*order)
    base = F.col(slice_col) * F.lit(_ROWS_PER_SLICE) if slice_col else F.lit(0)
    # The order covers every column, so equal rows are peers: only the first of them has its rank as its number.
    rows = transitions.repartition(partitions, *part).withColumns({"_pos": F.row_number().over(w), "_rank": F.rank().over(w)})
    return rows.filter("_pos = _rank").withColumn("_pos", F.col("_pos") + base).drop("_rank")


# --------------------------------------------------------------------------------------------------------------- ends
def _per_state(states: list[State], value) -> Column:
    """CASE on the state name."""
    out = F.lit(None)
    for s in states:
        out = F.when(F.col("state") == s.name, value(s)).otherwise(out)
    return out


def _masked(mask: int, i: int) -> Column:
    return F.col(TAG_SLOTS[i]) if mask >> i & 1 else F.lit(None).cast("string")


_GROUP = ("key", "state", "_g0", "_g1", "_g2")


@dataclass(frozen=True)
class _Closing:
    """The states whose closes are replayed, and the tags by which their closes find opens."""

    rules: RuleSet
    profile: Profile
    states: list[State]

    def base_mask(self, s: State) -> int:
        found = self.profile.close_masks.get(s.name, ())
        if len(found) == 1:
            return found[0]
        return self.rules.tag_mask(s.close) if s.close else 0

    def other_masks(self, s: State) -> tuple[int, ...]:
        return tuple(m for m in self.profile.close_masks.get(s.name, ()) if m != self.base_mask(s))

    def common_mask(self, s: State) -> int:
        """The tags that every close of the state sets: opens and closes that differ in one of them never meet."""
        return reduce(lambda a, b: a & b, self.profile.close_masks.get(s.name, ()), len(ALL_MASKS) - 1)

    @property
    def strategies(self) -> set[str]:
        return {s.strategy for s in self.states}

    @property
    def uneven(self) -> list[State]:
        """States whose replay depends on the order of closes that set different tags."""
        return [s for s in self.states if s.strategy != CLOSE_ALL and self.other_masks(s)]

    def case(self, value) -> Column:
        return _per_state(self.states, value)

    def has_base_mask(self) -> Column:
        return _mask_of_row() == self.case(lambda s: F.lit(self.base_mask(s)))

    def grouped(self, rows: DataFrame, pick) -> DataFrame:
        """``_g*``: the row's values of the tags in ``pick(state)``."""
        return rows.withColumns(
            {f"_g{i}": self.case(lambda s, i=i: _masked(pick(s), i)).cast("string") for i in range(len(TAG_SLOTS))}
        )


def _ends(rows: DataFrame, closing: _Closing, slice_col: str | None) -> DataFrame:
    """Add ``_end`` to opens and ``_ambiguous`` (the number of opens matched) to ambiguous closes."""
    strategies = closing.strategies
    is_open, pos = F.col("open"), F.col("_pos")
    close_pos = F.when(~is_open, pos)
    columns = [*rows.columns, "_end", "_ambiguous"]
    rows = closing.grouped(rows, closing.base_mask)

    specs: list[Spec] = []
    if strategies & {CLOSE_ALL, WARN}:
        specs.append(Spec("_next", "min", F.when(closing.has_base_mask(), close_pos), "after"))
    if WARN in strategies:
        specs += [
            Spec("_last_open", "max", F.when(is_open, pos), "before"),
            Spec("_last_close", "max", close_pos, "before"),
        ]
    if strategies & {POP, WARN}:
        specs.append(Spec("_opens", "sum", is_open.cast("long")))
    if POP in strategies:
        specs += [
            Spec("_closes", "sum", (~is_open).cast("long")),
            Spec("_balance", "sum", F.when(is_open, 1).otherwise(-1).cast("long")),
        ]
    rows = scan(rows, _GROUP, ["_pos"], specs, slice_col, chained=bool(closing.uneven))

    # Second pass, on what the first one found.
    specs = []
    if WARN in strategies:
        piled_up = is_open & (F.col("_last_open") > F.coalesce("_last_close", F.lit(-1)))
        specs += [
            Spec("_stuck", "min", F.when(piled_up, pos), "all"),
            Spec("_stuck_opens", "min", F.when(piled_up, F.col("_opens")), "all"),
        ]
    if POP in strategies:
        specs.append(Spec("_low", "min", F.col("_balance"), "before"))
    rows = scan(rows, _GROUP, ["_pos"], specs, slice_col, chained=True)

    if POP in strategies:
        # A close that takes the balance below its lowest point so far found nothing open; the others are numbered.
        low = F.least(F.lit(0), F.coalesce("_low", F.lit(0)))
        serving = ~is_open & (F.col("_balance") >= low)
        turn = F.when(is_open, F.col("_opens")).when(serving, F.col("_closes") + low).otherwise(-pos)
        rows = rows.withColumn("_turn", turn).withColumn(
            "_served", F.max(F.when(serving, pos)).over(Window.partitionBy(*_GROUP, "_turn"))
        )
    end_of = {
        CLOSE_ALL: lambda: F.col("_next"),
        WARN: lambda: F.when(F.col("_stuck").isNull() | (F.col("_next") < F.col("_stuck")), F.col("_next")),
        POP: lambda: F.col("_served"),
    }
    end = closing.case(lambda s: end_of[s.strategy]())
    ambiguous = F.lit(None)
    if WARN in strategies:
        warned = ~is_open & (pos > F.col("_stuck")) & closing.case(lambda s: F.lit(s.strategy == WARN))
        ambiguous = F.when(warned, F.col("_opens") - F.col("_stuck_opens") + 2)
    rows = rows.withColumn("_end", F.when(is_open, F.coalesce(end, F.lit(NEVER))).cast("long"))
    rows = rows.withColumn("_ambiguous", ambiguous.cast("long"))

    # ``close`` with closes that set other tags than usual: one more look-ahead for each such combination.
    uneven = [s for s in closing.states if s.strategy == CLOSE_ALL]
    for mask in sorted({m for s in uneven for m in closing.other_masks(s)}):
        here = F.col("state").isin(*[s.name for s in uneven if mask in closing.other_masks(s)])
        rows = closing.grouped(rows, lambda s, m=mask: m)
        found = Spec("_other", "min", F.when((_mask_of_row() == mask) & here, close_pos), "after")
        rows = scan(rows, _GROUP, ["_pos"], [found], slice_col, chained=True)
        rows = rows.withColumn("_end", F.when(here & is_open, F.least("_end", "_other")).otherwise(F.col("_end")))
    return rows.select(*columns)


class _Openings:
    """The openings of one group by the values that a close can ask for, so that a close costs the same however many there
    are. ``masks``: the tags that closes set."""

    def __init__(self, masks: tuple[int, ...], warns: bool) -> None:
        self.masks, self.warns = masks, warns
        self.found: dict[tuple, OrderedDict] = {}
        self.stuck: dict[tuple, int] = {}
        self.alike: dict[tuple, int] = {}

    def _asked(self, row: dict) -> list[tuple]:
        return [(m, *(row[t] if m >> i & 1 else None for i, t in enumerate(TAG_SLOTS))) for m in self.masks]

    def open(self, row: dict) -> list[dict]:
        """Takes an opening; returns those that nothing can close any more. Under ``warn`` these are two that no close can
        tell apart, and all that come like them: only their number is kept."""
        asked = tuple(self._asked(row))
        if self.warns:
            if asked in self.alike:
                twin = self.alike[asked]
                done = [row]
                if twin is not None:
                    done.insert(0, self._take(twin, asked))
                    self.alike[asked] = None
                for key in asked:
                    self.stuck[key] = self.stuck.get(key, 0) + len(done)
                return done
            self.alike[asked] = row["_pos"]
        for key in asked:
            self.found.setdefault(key, OrderedDict())[row["_pos"]] = row
        return []

    def _take(self, pos: int, asked: tuple) -> dict:
        row = None
        for key in asked:
            row = self.found[key].pop(pos)
            if not self.found[key]:
                del self.found[key]
        return row

    def close(self, row: dict) -> tuple[dict | None, int | None]:
        """The opening that a close ends, or how many it cannot choose from."""
        mask = sum(1 << i for i, t in enumerate(TAG_SLOTS) if row[t] is not None)
        key = (mask, *(row[t] for t in TAG_SLOTS))
        here = self.found.get(key, ())
        several = len(here) + self.stuck.get(key, 0)
        if self.warns and several > 1:
            return None, several
        if not here:
            return None, None
        first = here[next(iter(here))]
        asked = tuple(self._asked(first))
        if self.warns:
            del self.alike[asked]
        return self._take(first["_pos"], asked), None

    def left(self) -> list[dict]:
        return list({pos: row for rows in self.found.values() for pos, row in rows.items()}.values())


def _replay(strategy_of: dict[str, str], masks_of: dict[str, tuple[int, ...]]):
    """Row-by-row replay of sorted groups, a constant number of look-ups per row. Under ``warn`` no more openings are held
    than there are combinations of tags, under ``pop`` those that are open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = current = columns = None
        for batch in batches:
            columns = list(batch.columns)
            done: list[dict] = []
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                group = [row[c] for c in _GROUP]
                if group != current:
                    done += opened.left() if opened else []
                    opened, current = _Openings(masks_of[row["state"]], strategy_of[row["state"]] == WARN), group
                if row["open"]:
                    done += opened.open({**row, "_end": NEVER})
                else:
                    ended, several = opened.close(row)
                    done += [{**ended, "_end": row["_pos"]}] if ended else []
                    done.append({**row, "_ambiguous": several})
            yield pd.DataFrame(done, columns=columns, dtype=object)
        if opened:
            yield pd.DataFrame(opened.left(), columns=columns, dtype=object)

    return run


def _replayed(rows: DataFrame, closing: _Closing) -> DataFrame:
    """``_ends`` for groups whose closes differ in the tags they set. Rows stream through in order; the time is linear in a
    group's rows."""
    columns = [c for c in rows.columns if c not in _GROUP[2:]] + ["_end", "_ambiguous"]
    rows = rows.withColumn("timestamp", F.unix_micros("timestamp"))
    rows = rows.withColumns({c: F.lit(None).cast("long") for c in columns[-2:]}).repartition(*_GROUP)
    done = rows.sortWithinPartitions(*_GROUP, "_pos").mapInPandas(
        _replay({s.name: s.strategy for s in closing.states}, {s.name: closing.profile.close_masks[s.name] for s in closing.uneven}),
        rows.schema,
    )
    return done.withColumn("timestamp", F.timestamp_micros("timestamp")).select(*columns)


def _histories(rows: DataFrame, closing: _Closing, slice_col: str | None) -> DataFrame:
    """Positions and ends for all rows; rows of states outside ``closing`` only get positions."""
    rows = _with_positions(rows, closing.rules, slice_col)
    if not closing.uneven:
        return _ends(rows, closing, slice_col)
    # Groups by the tags that all closes of a state set; only those with an unusual close are replayed.
    rows = closing.grouped(rows, closing.common_mask)
    names = F.col("state").isin(*[s.name for s in closing.uneven])
    differs = F.coalesce(names & ~F.col("open") & ~closing.has_base_mask(), F.lit(False))
    flagged = scan(rows, _GROUP, ["_pos"], [Spec("_odd", "max", differs.cast("int"), "all")], slice_col)
    even = _ends(flagged.filter("_odd = 0").drop("_odd", *_GROUP[2:]), closing, slice_col)
    return even.unionByName(_replayed(flagged.filter("_odd = 1").drop("_odd"), closing))


# ------------------------------------------------------------------------------------------------------------- probes
def _entries(rules: RuleSet, profile: Profile, warning: list[State] = ()) -> Column:
    """What a row adds to the search: opens of a required state are filed under every tag combination that is looked
    up, openings look up the tags they set. Ambiguous closes of the ``warning`` states look for what is never filed."""

    def entry(need: str, turn: Column, mask: Column, tags: list[Column], end: Column, when: Column, matched: Column = F.lit(None)) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(need).alias("_need"),
                turn.cast("int").alias("_turn"),
                mask.cast("int").alias("_mask"),
                *[t.cast("string").alias(f"_g{i}") for i, t in enumerate(tags)],
                end.cast("long").alias("_until"),
                matched.cast("long").alias("_matched"),
            ),
        )

    is_open, none = F.col("open"), F.lit(None)
    out = []
    for r in rules.required:
        for mask in profile.probe_masks.get(r.name, ()):
            present = reduce(
                lambda a, b: a & b, [F.col(TAG_SLOTS[i]).isNotNull() for i in range(3) if mask >> i & 1], F.lit(True)
            )
            here = is_open & (F.col("state") == r.name) & present
            out.append(entry(r.name, none, F.lit(mask), [_masked(mask, i) for i in range(3)], F.col("_end"), here))
    for s in rules.requiring:
        for turn, need in enumerate(s.open.requires):
            here = F.col("_probe") & is_open & (F.col("state") == s.name)
            out.append(entry(need, F.lit(turn), _mask_of_row(), [F.col(t) for t in TAG_SLOTS], none, here))
    for s in warning:
        here = F.col("_ambiguous").isNotNull() & (F.col("state") == s.name)
        out.append(entry(s.name, F.lit(AMBIGUOUS), F.lit(AMBIGUOUS), [none] * len(TAG_SLOTS), none, here, F.col("_ambiguous")))
    return F.array(*out)


def _missing(
    histories: DataFrame, rules: RuleSet, profile: Profile, probe: Column, slice_col: str | None, warning: list[State] = ()
) -> DataFrame:
    """Openings for which a required state is not open, one row per opening and missing state; and the ambiguous closes of
    the ``warning`` states, whose ``_turn`` is ``AMBIGUOUS``."""
    keep = [*IDENTITY, *([slice_col] if slice_col else []), "_pos"]
    found = histories.withColumn("_probe", probe).select(*keep, F.inline(_entries(rules, profile, warning)))
    found = found.filter("_need is not null")
    group = ["key", "_need", "_mask", "_g0", "_g1", "_g2"]
    # At equal positions the opening itself comes before its own look-up: a state satisfies a requirement on itself.
    found = found.withColumn("_looks", F.col("_turn").isNotNull())
    found = scan(found, group, ["_pos", "_looks"], [Spec("_alive", "max", F.col("_until"))], slice_col, chained=True)
    return found.filter("_looks and coalesce(_alive, -1) <= _pos")


# ------------------------------------------------------------------------------------------------------------ public
def _instant(value: datetime | str) -> datetime:
    when = datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else value
    return when if when.tzinfo else when.replace(tzinfo=timezone.utc)


def _relevant(transitions: DataFrame, rules: RuleSet) -> DataFrame:
    """Only states that some rule requires, and openings that require something, can change what is missing."""
    required = F.col("state").isin(*[s.name for s in rules.required])
    return transitions.select(*TRANSITION_COLUMNS).filter(
        required | (F.col("open") & F.col("state").isin(*[s.name for s in rules.requiring]))
    )


def _check(rules: RuleSet) -> None:
    if not rules.requiring:
        raise ValueError("no state has a requirement; there is nothing to monitor")


def _late(rules: RuleSet, now: datetime) -> Column:
    return _by_name("_need", rules.required, lambda r: F.lit(now) > plus(F.col("timestamp"), r.max_latency))


def judge(
    transitions: DataFrame,
    rules: RuleSet,
    as_of: datetime | str,
    last_run: datetime | str | None = None,
    judged_before: DataFrame | None = None,
    profile: Profile | None = None,
    emitted_only: bool = False,
    all_missing: bool = False,
) -> DataFrame:
    """Openings that lack a required state at ``as_of``: transition columns, ``required_state`` and ``emitted``.

    Each opening is judged once. It is not ``emitted`` (no alert) when it had timed out by ``as_of``, or when its
    latency had already passed at ``last_run``; it still counts as judged. Pass the earlier results as ``judged_before``
    to leave those openings out. ``all_missing`` reports every missing requirement of an opening, not only the first.
    ``emitted_only`` keeps the alerts and looks only at openings that can still give one.

    Runs one small job (``profile_transitions``) unless a profile is given.
    """
    _check(rules)
    now = _instant(as_of)
    # Rows after the last opening that can be judged now cannot change the outcome.
    judged_until = now - min(r.max_latency for r in rules.required)
    rows = _relevant(transitions.filter(F.col("timestamp") < F.lit(judged_until)), rules)
    if profile is None:
        profile = profile_transitions(rows, rules)
    closing = _Closing(rules, profile, rules.required)
    alive_since = now - max(s.open.timeout for s in rules.requiring)
    probe = F.col("timestamp") >= F.lit(alive_since) if emitted_only else F.lit(True)

    def body(part: DataFrame, slice_col: str | None) -> DataFrame:
        found = _missing(_histories(part, closing, slice_col), rules, profile, probe, slice_col)
        return found.filter(_late(rules, now)).select(*IDENTITY, "_turn", F.col("_need").alias("required_state"))

    found = split_scan(rows, "key", profile.hot, body, time_slice(F.col("timestamp"), profile.slice_seconds))
    found = verdicts(found, rules, now, last_run, judged_before, all_missing)
    return found.filter("emitted") if emitted_only else found


def judge_and_warn(transitions: DataFrame, rules: RuleSet, as_of: datetime | str, profile: Profile) -> DataFrame:
    """What ``judge`` and ``state_warnings`` look for, in one replay instead of two: ``verdicts`` and ``first_warnings`` go on
    with it and each take their rows. To be written out, as both read it.

    A replay never looks ahead of what it judges, so rows that only the other one needs change nothing.
    """
    _check(rules)
    now = _instant(as_of)
    warning = _warning(rules)
    states = [s for s in rules.states if s in rules.required or s in warning]
    rows = transitions.select(*TRANSITION_COLUMNS).filter(
        (F.col("timestamp") <= F.lit(now))
        & (F.col("state").isin(*[s.name for s in states]) | (F.col("open") & F.col("state").isin(*[s.name for s in rules.requiring])))
    )
    closing = _Closing(rules, profile, states)

    def body(part: DataFrame, slice_col: str | None) -> DataFrame:
        found = _missing(_histories(part, closing, slice_col), rules, profile, F.lit(True), slice_col, warning)
        found = found.filter((F.col("_turn") == AMBIGUOUS) | _late(rules, now))
        return found.select(*IDENTITY, "_turn", F.col("_need").alias("required_state"), F.col("_matched").alias("ambiguous_opens"))

    return split_scan(rows, "key", profile.hot, body, time_slice(F.col("timestamp"), profile.slice_seconds))


def verdicts(
    found: DataFrame,
    rules: RuleSet,
    as_of: datetime | str,
    last_run: datetime | str | None = None,
    judged_before: DataFrame | None = None,
    all_missing: bool = False,
) -> DataFrame:
    """The second half of ``judge``: of the missing requirements of an opening the one to report, and whether it is ``emitted``."""
    now = _instant(as_of)
    found = found.filter(F.col("_turn") != AMBIGUOUS)
    if not all_missing and any(len(s.open.requires) > 1 for s in rules.requiring):
        found = found.groupBy(*IDENTITY).agg(F.min_by("required_state", "_turn").alias("required_state"))
    found = found.select(*IDENTITY, "required_state")
    if judged_before is not None:
        new, seen = found.alias("new"), judged_before.select(*IDENTITY).alias("seen")
        same = reduce(lambda a, b: a & b, [F.col(f"new.{c}").eqNullSafe(F.col(f"seen.{c}")) for c in IDENTITY])
        found = new.join(seen, same, "left_anti")
    emitted = _by_name("state", rules.requiring, lambda s: F.lit(now) <= plus(F.col("timestamp"), s.open.timeout))
    if last_run is not None:
        before = F.lit(_instant(last_run))
        emitted &= _by_name("required_state", rules.required, lambda r: before <= plus(F.col("timestamp"), r.max_latency))
    return found.withColumn("emitted", emitted)


def _by_name(column: str, states: list[State], value) -> Column:
    out = F.lit(None)
    for s in states:
        out = F.when(F.col(column) == s.name, value(s)).otherwise(out)
    return out


def state_monitor(transitions: DataFrame, rules: RuleSet, as_of: datetime | str, **options) -> DataFrame:
    """The openings to alert on at ``as_of``; see ``judge`` for the options."""
    return judge(transitions, rules, as_of, emitted_only=True, **options).drop("emitted")


def ambiguous_closes(
    transitions: DataFrame, rules: RuleSet, as_of: datetime | str, profile: Profile | None = None
) -> DataFrame:
    """Closes of ``warn`` states that matched several opens, with ``ambiguous_opens``, the number matched."""

    def body(histories: DataFrame, _: str | None) -> DataFrame:
        found = histories.filter("_ambiguous is not null")
        return found.select(*IDENTITY, F.col("_ambiguous").alias("ambiguous_opens"))

    return _warn_histories(transitions, rules, as_of, profile, body)


def _warning(rules: RuleSet) -> list[State]:
    return [s for s in rules.states if s.strategy == WARN and s.close]


def _warn_histories(transitions: DataFrame, rules: RuleSet, as_of: datetime | str, profile: Profile | None, body) -> DataFrame:
    """``body`` over the histories of the states that warn, up to ``as_of``."""
    states = _warning(rules)
    rows = transitions.select(*TRANSITION_COLUMNS).filter(
        (F.col("timestamp") <= F.lit(_instant(as_of))) & F.col("state").isin(*[s.name for s in states])
    )
    if profile is None:
        profile = profile_transitions(rows, rules)
    closing = _Closing(rules, profile, states)

    def run(part: DataFrame, slice_col: str | None) -> DataFrame:
        return body(_histories(part, closing, slice_col), slice_col)

    return split_scan(rows, "key", profile.hot, run, time_slice(F.col("timestamp"), profile.slice_seconds))


def ambiguous_opens(
    transitions: DataFrame, rules: RuleSet, as_of: datetime | str, profile: Profile | None = None
) -> DataFrame:
    """The opens that the first ambiguous close of each key matched, one row each (see ``state_warnings``)."""

    def body(histories: DataFrame, slice_col: str | None) -> DataFrame:
        first = F.when(F.col("_ambiguous").isNotNull(), F.struct("_pos", "state", *TAG_SLOTS))
        rows = scan(histories, ["key"], ["_pos"], [Spec("_close", "min", first, "all")], slice_col, chained=True)
        matched = (F.col("state") == F.col("_close.state")) & (F.col("_pos") < F.col("_close._pos"))
        for t in TAG_SLOTS:
            matched &= F.col(f"_close.{t}").isNull() | (F.col(t) == F.col(f"_close.{t}"))
        return rows.filter(F.col("open") & matched & (F.col("_end") > F.col("_close._pos"))).select(*IDENTITY)

    return _warn_histories(transitions, rules, as_of, profile, body)


def state_warnings(
    transitions: DataFrame,
    rules: RuleSet,
    as_of: datetime | str,
    warned_before: DataFrame | None = None,
    profile: Profile | None = None,
) -> DataFrame:
    """The first ambiguous close of each key; keys in ``warned_before`` (column ``key``) stay quiet."""
    return _first_of_keys(ambiguous_closes(transitions, rules, as_of, profile), rules, warned_before)


def first_warnings(found: DataFrame, rules: RuleSet, warned_before: DataFrame | None = None) -> DataFrame:
    """``state_warnings`` out of the rows of ``judge_and_warn``."""
    closes = found.filter(F.col("_turn") == AMBIGUOUS).select(*IDENTITY, "ambiguous_opens")
    return _first_of_keys(closes, rules, warned_before)


def _first_of_keys(closes: DataFrame, rules: RuleSet, warned_before: DataFrame | None) -> DataFrame:
    order = F.struct("timestamp", "streamid", "eventid", _state_rank(rules).alias("rank"), *TAG_SLOTS)
    rest = [c for c in closes.columns if c != "key"]
    first = closes.groupBy("key").agg(F.min_by(F.struct(*rest), order).alias("first")).select("key", "first.*")
    if warned_before is None:
        return first
    seen = warned_before.select("key").distinct().alias("seen")
    return first.alias("new").join(seen, F.col("new.key").eqNullSafe(F.col("seen.key")), "left_anti")
