"""Alerts as rows: ``time, title, description, detail, props, eventrefs``. Text is made only on the way out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelwatch.functions import texts
from kestrelwatch.rules import RuleSet

ALERT_COLUMNS = ("time", "title", "description", "detail", "props", "eventrefs")


def _no_text() -> Column:
    return F.lit("")


def state_alerts(
    missing: DataFrame,
    rules: RuleSet,
    alert_time: Column | None = None,
    started_at: datetime | None = None,
) -> DataFrame:
    """Alerts for the rows of ``state_monitor``. With ``started_at``, ``suppressed`` marks alerts raised before the
    rule set's start-up delay has passed."""
    when = F.current_timestamp() if alert_time is None else alert_time
    ref = texts.event_ref(F.col("streamid"), F.col("eventid"))
    out = missing.select(
        texts.iso_utc(when).alias("time"),
        F.lit(texts.STATE_TITLE).alias("title"),
        texts.missing_description(F.col("required_state"), F.coalesce("key", F.lit("")), F.col("state")).alias("description"),
        _no_text().alias("detail"),
        texts.props(
            ("analytic", F.lit("StateMonitor")),
            ("config", F.lit(rules.name)),
            ("key", F.col("key")),
            ("state", F.col("state")),
            ("requiredState", F.col("required_state")),
            *texts.tag_props(rules),
        ).alias("props"),
        F.filter(F.array(ref), lambda r: r.isNotNull()).alias("eventrefs"),
        F.lit(False).alias("suppressed") if started_at is None else (when <= F.lit(started_at) + F.lit(rules.alerting_delay)).alias("suppressed"),
    )
    return out if started_at is not None else out.drop("suppressed")


def login_alerts(logins: DataFrame, alert_time: Column | None = None) -> DataFrame:
    """Alerts for the rows of ``unusual_logins``."""
    when = F.current_timestamp() if alert_time is None else alert_time
    return logins.select(
        texts.iso_utc(when).alias("time"),
        F.lit("Unusual login time").alias("title"),
        F.concat(F.lit("Login outside office hours by "), F.coalesce("key", F.lit("unknown user"))).alias("description"),
        texts.iso_utc(F.col("timestamp")).alias("detail"),
        texts.props(("key", F.col("key")), ("loginTime", texts.iso_utc(F.col("timestamp")))).alias("props"),
        F.filter(F.array(texts.event_ref(F.col("streamid"), F.col("eventid"))), lambda r: r.isNotNull()).alias("eventrefs"),
    )


def rate_alerts(outliers: DataFrame, alert_time: Column | None = None) -> DataFrame:
    """Alerts for outlier hours: ``window, count, prediction`` and, where known, ``eventref``."""
    when = F.current_timestamp() if alert_time is None else alert_time
    hour = F.col("window.start").cast("string")
    count, prediction = F.col("count"), F.col("prediction")
    refs = F.col("eventref") if "eventref" in outliers.columns else F.array().cast("array<string>")
    return outliers.select(
        texts.iso_utc(when).alias("time"),
        F.lit(texts.RATE_TITLE).alias("title"),
        texts.rate_description(hour).alias("description"),
        texts.rate_detail(hour, count, prediction).alias("detail"),
        texts.props(("hour", hour), ("count", count), ("prediction", prediction)).alias("props"),
        refs.alias("eventrefs"),
    )


def alert_lines(alerts: DataFrame) -> DataFrame:
    """One CSV line per alert, in the column ``value``."""
    return alerts.select(texts.alert_line(*[F.col(c) for c in ALERT_COLUMNS]).alias("value"))


def dedup_alerts(alerts: DataFrame, by: list[str], at: str, unit: str = "hour") -> DataFrame:
    """The earliest alert of every group and ``unit`` of time, for detectors that report the same thing repeatedly.
    Repeats are dropped map-side already."""
    span = F.date_trunc(unit, at)
    first = alerts.groupBy(*by, span.alias("_span")).agg(F.min_by(F.struct(*alerts.columns), _order(alerts, at)).alias("first"))
    return first.select("first.*")


def _order(alerts: DataFrame, at: str) -> Column:
    flat = [f.name for f in alerts.schema.fields if f.dataType.typeName() != "map" and f.name != at]
    return F.struct(at, *flat)
