"""The state monitor on a stream.

Transitions that arrive are appended to a table; every run judges the part of it that can still matter, with the same
operator as a batch. A key's history is never held in one task's state, so a key with a large share of all events is
sliced in time as in a batch. A run reads only the histories of keys for which something can have changed since the run before. The tables, in the
shared folder ``store``:

  transitions/date=../arrival=..   what arrived in which micro-batch
  judged/run=..                    openings judged in a run, with or without an alert
  warned/run=..                    keys that a run warned about for the first time
  log/run=..                       when the run took place and what had arrived; written last
  *-merged/level=../..             several of these, merged

Each of the first three is log-structured: a run writes only what is new, and ``FAN`` folders of a level are merged into one of
the next. So a row is written again as often as there are levels, and folders grow with the logarithm of the runs, not with
their number. All three are sets: a row that stands in a merged folder and still in one of its sources counts once, so a
merge that is cut off does no harm, and nothing has to be swapped at once.

Writing a run or an arrival again replaces it, so a micro-batch that is repeated after a failure changes nothing; what a run
that may be repeated has to read is not merged yet. What is older than the horizon of the run before goes, when it is merged
or when a whole folder is that old. A key stays warned about for ``quiet``, forever if that is None.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kestrelwatch.functions.texts import utc_date
from kestrelwatch.operators.scan import DEFAULT_HOT_ROWS
from kestrelwatch.operators.state_monitor import TRANSITION_COLUMNS, first_warnings, judge_and_warn, profile_transitions, verdicts
from kestrelwatch.operators.transitions import map_transitions
from kestrelwatch.rules import RuleSet
from kestrelwatch.session import folders, materialise, remove, work_dir

_TRANSITIONS = "key string, timestamp timestamp, state string, open boolean, tag1 string, tag2 string, tag3 string, eventid string, streamid string"
_IDS = "key string, timestamp timestamp, state string, tag1 string, tag2 string, tag3 string, eventid string, streamid string"


#: Folders of a level that are merged into one.
FAN = 8


@dataclass(frozen=True)
class Run:
    number: int
    as_of: datetime
    arrival: int


@dataclass(frozen=True)
class MonitorStore:
    """The monitor's tables below a shared folder."""

    spark: SparkSession
    path: str
    quiet: timedelta | None = None

    def _both(self, name: str, schema: str, merged: str) -> DataFrame | None:
        """A table and what was merged of it; ``merged`` has the schema of the latter."""
        fresh, old = self._table(name, schema), self._table(f"{name}-merged", merged)
        columns = [c.split()[0] for c in schema.split(", ")]
        found = [f.select(*columns) for f in (fresh, old) if f is not None]
        return None if not found else found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def _table(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in (missing.getCondition() or ""):
                raise
            return None

    def append(self, transitions: DataFrame, arrival: int) -> None:
        rows = transitions.select(*TRANSITION_COLUMNS).withColumns(
            {"date": utc_date(F.col("timestamp")), "arrival": F.lit(arrival).cast("long")}
        )
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date", "arrival")
            .parquet(f"{self.path}/transitions")
        )

    def arrived(self, arrival: int) -> DataFrame:
        rows = self._table("transitions", _TRANSITIONS + ", date date, arrival long")
        if rows is None:
            return self.spark.createDataFrame([], _TRANSITIONS)
        return rows.filter(F.col("arrival") == arrival).select(*TRANSITION_COLUMNS)

    def last_run(self, before: int | None = None) -> Run | None:
        log = self._table("log", "as_of timestamp, arrival long, run int")
        if log is None:
            return None
        rows = log if before is None else log.filter(F.col("arrival") < before)
        found = rows.orderBy(F.desc("run")).select("run", F.unix_micros("as_of").alias("at"), "arrival").first()
        if found is None:
            return None
        return Run(found["run"], datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=found["at"]), found["arrival"])

    def transitions(self, rules: RuleSet, last: Run | None, arrival: int, as_of: datetime) -> DataFrame:
        """What a run has to look at: of what arrived since the last run, and of the rest what is not older than the
        rule set's horizon, the keys with something due."""
        rows = self._both("transitions", _TRANSITIONS + ", date date, arrival long", _TRANSITIONS + ", level int, arrival long, date date")
        if rows is None:
            return self.spark.createDataFrame([], _TRANSITIONS)
        rows = rows.filter(F.col("arrival") <= arrival)
        if last is None:
            return rows.select(*TRANSITION_COLUMNS)
        since = last.as_of - rules.horizon
        new = F.col("arrival") > last.arrival
        # The first condition prunes folders, the second row groups.
        rows = rows.filter(new | (F.col("date") >= F.lit(since.astimezone(timezone.utc).date()))).filter(new | (F.col("timestamp") >= F.lit(since)))
        due = rows.filter(new | self._due(rules, last.as_of, as_of)).select(F.col("key").alias("_key")).distinct()
        found = rows.join(due, F.col("key").eqNullSafe(F.col("_key")), "left_semi")
        return found.select(*TRANSITION_COLUMNS)

    @staticmethod
    def _due(rules: RuleSet, last_run: datetime, as_of: datetime) -> Column:
        """Openings that may alert now: a latency has passed since the last run. Where an opening has several
        requirements, also those that have not all passed, as an earlier miss of one rules out the others. And
        transitions that were still in the future at the last run."""
        ts = F.col("timestamp")
        out = (ts > F.lit(last_run)) & (ts <= F.lit(as_of))
        for s in rules.requiring:
            waits = [rules.state(r).max_latency for r in s.open.requires]
            span = (ts >= F.lit(last_run - max(waits))) & (ts <= F.lit(as_of - min(waits)))
            out |= F.col("open") & (F.col("state") == s.name) & span
        return out

    def judged(self, rules: RuleSet, last: Run | None) -> DataFrame | None:
        schema = _IDS + ", required_state string, emitted boolean"
        rows = self._both("judged", schema + ", run int", schema + ", level int, run int, until long") if last else None
        return None if rows is None else rows.filter(
            (F.col("run") <= last.number) & (F.col("timestamp") >= F.lit(last.as_of - rules.horizon))
        )

    def warned(self, last: Run | None) -> DataFrame | None:
        """Keys that stay quiet in the run after ``last``."""
        rows = self._both("warned", "key string, at long, run int", "key string, at long, level int, run int, until long") if last else None
        if rows is None:
            return None
        rows = rows.filter(F.col("run") <= last.number)
        return rows if self.quiet is None else rows.filter(F.col("at") >= _micros(last.as_of - self.quiet))

    def run(
        self, rules: RuleSet, as_of: datetime, arrival: int, hot_rows: int = DEFAULT_HOT_ROWS
    ) -> tuple[DataFrame, DataFrame]:
        """Judge what is due at ``as_of``. Returns the openings to alert on and the new warnings, both as written."""
        last = self.last_run(before=arrival)
        number = last.number + 1 if last else 0
        due = work_dir(self.spark, "due")
        self.transitions(rules, last, arrival, as_of).write.parquet(due)
        rows = self.spark.read.schema(_TRANSITIONS).parquet(due)
        profile = profile_transitions(rows, rules, hot_rows)
        both = work_dir(self.spark, "findings")
        replayed = judge_and_warn(rows, rules, as_of, profile)
        replayed.write.parquet(both)
        replayed = self.spark.read.schema(replayed.schema).parquet(both)
        found = verdicts(replayed, rules, as_of, last.as_of if last else None, self.judged(rules, last))
        found.write.mode("overwrite").parquet(f"{self.path}/judged/run={number}")
        before = self.warned(last)
        warnings = materialise(first_warnings(replayed, rules, before), "warnings")
        if warnings.isEmpty():
            remove(self.spark, f"{self.path}/warned/run={number}")
        else:
            keys = warnings.select("key", F.lit(_micros(as_of)).alias("at"))
            keys.write.mode("overwrite").parquet(f"{self.path}/warned/run={number}")
        log = self.spark.range(1).select(F.lit(as_of).alias("as_of"), F.lit(arrival).cast("long").alias("arrival"))
        log.write.mode("overwrite").parquet(f"{self.path}/log/run={number}")
        emitted = self.spark.read.schema(found.schema).parquet(f"{self.path}/judged/run={number}").filter("emitted")
        remove(self.spark, due)
        remove(self.spark, both)
        if last is not None:
            self.merge(last, rules.horizon)
            self.expire(last, rules.horizon)
        return emitted.drop("emitted"), warnings

    def merge(self, last: Run, horizon: timedelta) -> None:
        """Merge full levels of what the run after ``last`` and all later ones read as a whole."""
        since = last.as_of - horizon
        recent = F.col("timestamp") >= F.lit(since)
        self._merge("judged", _IDS + ", required_state string, emitted boolean", last.number, recent, F.unix_micros("timestamp"))
        still = F.lit(True) if self.quiet is None else F.col("at") >= _micros(last.as_of - self.quiet)
        self._merge("warned", "key string, at long", last.number, still, F.col("at"))
        days = folders(self.spark, f"{self.path}/transitions")
        fresh = [f"{d}/{a}" for d in days for a in folders(self.spark, f"{self.path}/transitions/{d}") if int(a[8:]) <= last.arrival]
        arrivals = {int(f.rsplit("=", 1)[1]) for f in fresh}
        level = 0
        while len(arrivals) >= FAN:
            base = f"{self.path}/transitions{'-merged' * bool(level)}"
            rows = self.spark.read.schema(_TRANSITIONS).option("basePath", base).parquet(*[f"{base}/{f}" for f in fresh])
            rows = rows.select(*TRANSITION_COLUMNS).where(recent).distinct().withColumn("date", utc_date(F.col("timestamp")))
            target = f"level={level + 1}/arrival={max(arrivals)}"
            rows.repartition("date").write.mode("overwrite").partitionBy("date").parquet(f"{self.path}/transitions-merged/{target}")
            for f in fresh:
                remove(self.spark, f"{base}/{f}")
            level += 1
            fresh = [f"level={level}/{a}" for a in folders(self.spark, f"{self.path}/transitions-merged/level={level}")]
            arrivals = {int(f.rsplit("=", 1)[1]) for f in fresh}

    def _merge(self, name: str, schema: str, upto: int, keep: Column, time: Column) -> None:
        """``name-merged/level=../run=../until=..``: the rows of ``FAN`` or more folders, labelled with the last run and time in them."""
        fresh = [f for f in folders(self.spark, f"{self.path}/{name}") if int(f[4:]) <= upto]
        level = 0
        while len(fresh) >= FAN:
            base = f"{self.path}/{name}{'-merged' * bool(level)}"
            rows = materialise(self.spark.read.schema(schema).parquet(*[f"{base}/{f}" for f in fresh]).where(keep).distinct(), f"merge-{name}")
            until = rows.agg(F.max(time)).first()[0]
            runs = [int(f.split("run=")[1].split("/")[0]) for f in fresh]
            if until is not None:
                rows.coalesce(1 + len(rows.inputFiles()) // FAN).write.mode("overwrite").parquet(f"{self.path}/{name}-merged/level={level + 1}/run={max(runs)}/until={until}")
            for f in fresh:
                remove(self.spark, f"{base}/{f.rsplit('/until', 1)[0]}")
            level += 1
            fresh = self._segments(name, level)

    def _segments(self, name: str, level: int) -> list[str]:
        top = f"{self.path}/{name}-merged/level={level}"
        return [f"level={level}/{r}/{u}" for r in folders(self.spark, top) for u in folders(self.spark, f"{top}/{r}")]

    def expire(self, last: Run, horizon: timedelta) -> None:
        """Remove what neither the run after ``last`` nor a later one reads."""
        since = last.as_of - horizon
        first_day = since.astimezone(timezone.utc).date()
        merged = f"{self.path}/transitions-merged"
        segments = [f"{merged}/{level}/{a}" for level in folders(self.spark, merged) for a in folders(self.spark, f"{merged}/{level}")]
        for path in (f"{self.path}/transitions", *segments):
            days = folders(self.spark, path)
            old = [d for d in days if d.startswith("date=2") and date.fromisoformat(d[5:]) < first_day]
            for name in old if len(old) < len(days) or path not in segments else [""]:
                remove(self.spark, f"{path}/{name}".rstrip("/"))
        log = self._table("log", "as_of timestamp, arrival long, run int")
        rows = log.filter(F.col("run") < last.number).select("run", (F.col("as_of") < F.lit(since)).alias("old")).collect()
        for row in rows:
            if row["old"]:
                remove(self.spark, f"{self.path}/judged/run={row['run']}")
            if row["old"] or row["run"] < last.number - 2 * FAN:
                remove(self.spark, f"{self.path}/log/run={row['run']}")
        limits = {"judged": _micros(since), "warned": None if self.quiet is None else _micros(last.as_of - self.quiet)}
        for name, limit in limits.items():
            for level in folders(self.spark, f"{self.path}/{name}-merged") if limit is not None else ():
                for f in self._segments(name, int(level[6:])):
                    if int(f.rsplit("=", 1)[1]) < limit:
                        remove(self.spark, f"{self.path}/{name}-merged/{f.rsplit('/', 1)[0]}")


def _micros(when: datetime) -> int:
    return (when - datetime.fromtimestamp(0, timezone.utc)) // timedelta(microseconds=1)


def wall_clock(_: DataFrame, __: Run | None) -> datetime:
    """Runs judge at the time they happen."""
    return datetime.now(timezone.utc)


def event_clock(lateness: timedelta = timedelta(0)) -> Callable[[DataFrame, Run | None], datetime]:
    """Runs judge at the latest event time seen, less ``lateness``: repeatable, and right for replays."""

    def now(batch: DataFrame, last: Run | None) -> datetime:
        micros = batch.agg(F.unix_micros(F.max("timestamp"))).first()[0]
        before = last.as_of if last else datetime.fromtimestamp(0, timezone.utc)
        if micros is None:
            return before
        return max(before, datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=micros) - lateness)

    return now


def heartbeat(events: DataFrame) -> DataFrame:
    """The same stream, with a tick every second that carries no rows: runs then also take place when nothing arrives."""
    ticks = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().filter("value < 0")
    empty = ticks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    return events.unionByName(empty)


def monitor_stream(
    events: DataFrame,
    rules: RuleSet,
    store: str,
    checkpoint: str,
    sink: Callable[[DataFrame, DataFrame, int], None],
    clock: Callable[[DataFrame, Run | None], datetime] = wall_clock,
    trigger: dict | None = None,
    hot_rows: int = DEFAULT_HOT_ROWS,
    quiet: timedelta | None = None,
) -> StreamingQuery:
    """Run the state monitor every ``rules.interval`` on a stream of parsed events. ``sink(missing, warnings,
    batch_id)`` gets the openings to alert on (see ``state_alerts``) and the warnings of each run. A key that was warned about is
    not warned about again, with ``quiet`` not for so long."""
    tables = MonitorStore(events.sparkSession, store.rstrip("/"), quiet)

    def step(batch: DataFrame, batch_id: int) -> None:
        tables.append(batch, batch_id)
        # The batch is read back from the table: reading it again from the source would parse its events again.
        now = clock(tables.arrived(batch_id), tables.last_run(before=batch_id))
        missing, warnings = tables.run(rules, now, batch_id, hot_rows)
        sink(missing, warnings, batch_id)

    return (
        map_transitions(events, rules)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": rules.interval}))
        .start()
    )
