"""Windows that no key may fill: rolling counts in slices with a halo, distinct values within any span."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kestrelwatch.operators import counts, tags
from kestrelwatch.operators.scan import HotKeys

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("slice_seconds", [None, 50, 7, 300])
def test_rolling_counts_in_slices(spark, slice_seconds):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "u", None]), T0 + timedelta(seconds=rng.randint(-700, 700), microseconds=rng.randint(0, 999_999))) for _ in range(400)]
    rows += [("hot", None), ("hot", None), (None, None)]
    found = counts.rolling_counts(spark.createDataFrame(rows, "key string, timestamp timestamp"), ["key"], 50, slice_seconds).collect()
    seconds = [(k, None if t is None else int((t - datetime(1970, 1, 1)).total_seconds() // 1)) for k, t in rows]
    want = {
        (k, s): (seconds.count((k, s)), sum(o == k and (z == s if s is None or z is None else s - 50 <= z <= s) for o, z in seconds))
        for k, s in set(seconds)
    }
    assert {(r.key, r.second): (r.events, r.rolling) for r in found} == want and len(found) == len(want)
    assert counts.rolling_counts(spark.createDataFrame([], "key string, timestamp timestamp"), ["key"], 50, slice_seconds).collect() == []


def test_a_hot_key_spreads_over_tasks(spark):
    events = spark.range(300_000).select(F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id") * 3).alias("timestamp"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = counts.rolling_counts(events, ["key"], 3600)
        sizes = found.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 300_000 and len(sizes) > 8 and max(r["count"] for r in sizes) < 90_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("hot", [HotKeys(), HotKeys(("hot",), True)])
def test_distinct_values_within_any_span(spark, hot):
    rng = random.Random(9)
    span = timedelta(minutes=10)
    rows = [(rng.choice(["hot", "hot", "u", None]), T0 + timedelta(seconds=30 * rng.randint(0, 200)), rng.random() < 0.8, rng.choice(["a", "b", "c", "d", None])) for _ in range(300)]
    rows += [("u", None, True, "a"), ("u", T0, True, "a"), ("u", T0 + span, True, "a"), ("u", T0 + 2 * span, True, "b")]
    frame = spark.createDataFrame(rows, "key string, timestamp timestamp, open boolean, tag2 string").repartition(3)
    found = tags.distinct_within(frame, "tag2", span, hot, slice_seconds=120).collect()
    opens = [(k, t, v) for k, t, o, v in rows if o and v is not None and t is not None]
    want = {(k, t): len({v for o, z, v in opens if o == k and t - span < z <= t}) for k, t, _ in opens}
    assert {(r.key, r.timestamp): r["values"] for r in found} == want and len(found) == len(want)
    assert tags.distinct_within(frame.where("false"), "tag2", span, hot).collect() == []
