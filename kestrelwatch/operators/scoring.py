"""Score alerts against labelled incidents."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _near(left: DataFrame, right: DataFrame, tolerance: timedelta, out: str) -> DataFrame:
    """``left`` with ``out``: does ``right`` have a row of the same ``entity`` within ``tolerance``?

    Time is cut into steps of the tolerance. A row in the same step is near; of the steps before and after only the
    last and the first row can be. So ``right`` shrinks to one row per (entity, step) before the join, no pairs are
    formed, and a busy entity is spread over its steps.
    """
    width = max(1, tolerance // timedelta(microseconds=1))
    micros = F.unix_micros("timestamp")
    step = F.floor(micros / F.lit(width)).cast("long")
    summary = right.groupBy("entity", step.alias("step")).agg(F.min(micros).alias("first"), F.max(micros).alias("last"))

    def shifted(by: int, first: Column, last: Column) -> Column:
        return F.struct((F.col("step") + by).alias("at"), (F.lit(by) == 0).alias("same"), last.alias("earlier"), first.alias("later"))

    none = F.lit(None).cast("long")
    zero = tolerance == timedelta(0)
    steps = [shifted(0, none, none)] + ([] if zero else [shifted(1, none, F.col("last")), shifted(-1, F.col("first"), none)])
    around = (
        summary.select(F.col("entity").alias("_entity"), F.inline(F.array(*steps)))
        .groupBy("_entity", "at")
        .agg(F.max("same").alias("same"), F.max("earlier").alias("earlier"), F.min("later").alias("later"))
    )
    reach = F.lit(width)
    near = F.col("same") | (micros - F.col("earlier") <= reach) | (F.col("later") - micros <= reach)
    joined = left.withColumn("_step", step).join(
        around, (F.col("entity") == F.col("_entity")) & (F.col("_step") == F.col("at")), "left"
    )
    return joined.withColumn(out, F.coalesce(near, F.lit(False))).drop("_step", "_entity", "at", "same", "earlier", "later")


def match_alerts(alerts: DataFrame, truth: DataFrame, tolerance: timedelta) -> tuple[DataFrame, DataFrame]:
    """``alerts`` with ``is_true`` and ``truth`` with ``is_found``. Both have ``entity`` and ``timestamp``."""
    return _near(alerts, truth, tolerance, "is_true"), _near(truth, alerts, tolerance, "is_found")


def score_alerts(alerts: DataFrame, truth: DataFrame, tolerance: timedelta = timedelta(0)) -> DataFrame:
    """One row: true and false positives among the alerts, found and missed incidents, precision, recall."""
    judged, found = match_alerts(alerts, truth, tolerance)
    counts = judged.select(F.col("is_true").alias("hit"), F.lit("alert").alias("kind")).unionByName(
        found.select(F.col("is_found").alias("hit"), F.lit("truth").alias("kind"))
    )

    def number(kind: str, hit: bool) -> Column:
        return F.count_if((F.col("kind") == kind) & (F.col("hit") == hit))

    out = counts.agg(
        number("alert", True).alias("true_positives"),
        number("alert", False).alias("false_positives"),
        number("truth", True).alias("found"),
        number("truth", False).alias("missed"),
    )
    tp, fp, ok, fn = (F.col(c) for c in ("true_positives", "false_positives", "found", "missed"))
    return out.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(ok, ok + fn)})
