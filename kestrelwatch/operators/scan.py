"""Running aggregates over ordered groups, also when one group holds a large part of all rows.

A plain window puts a whole group into one task. ``scan`` can instead cut each group into slices: a window runs inside
each (group, slice), one summary row per (group, slice) is scanned across slices, and its carry is joined back. The
result is the same because sum, min and max are associative.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrelwatch.session import materialise

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "min": F.least,
    "max": F.greatest,
}


@dataclass(frozen=True)
class Spec:
    """One running column. Frames: ``upto`` the row, ``before`` it, ``after`` it, or ``all`` of the group."""

    name: str
    agg: str
    value: Column
    frame: str = "upto"


def _over(spec: Spec, keys: Sequence[str], order: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys)
    forward = w.orderBy(*order)
    # Looking ahead is written as looking back in descending order: a frame that ends at "unbounded following" is
    # evaluated anew for every row, one that starts at "unbounded preceding" is not.
    backward = w.orderBy(*[F.desc(c) for c in order])
    lo = Window.unboundedPreceding
    window = {
        "upto": forward.rowsBetween(lo, 0),
        "before": forward.rowsBetween(lo, -1),
        "after": backward.rowsBetween(lo, -1),
        "all": w,
    }[spec.frame]
    return _AGG[spec.agg](spec.value).over(window)


def scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Spec],
    slice_col: str | None = None,
    chained: bool = False,
) -> DataFrame:
    """Add one column per spec. ``slice_col`` must rise with ``order`` inside a group; None means one slice.

    A sliced scan reads its input twice. ``chained`` says that the input is itself the result of a sliced scan, so that
    it is written out first instead of being computed twice, and its input four times, and so on.
    """
    if not specs:
        return df
    if slice_col is None:
        return df.withColumns({s.name: _over(s, group, order) for s in specs})
    if chained:
        df = materialise(df, "scan")
    keys = [*group, slice_col]
    local = df.withColumns({s.name: _over(s, keys, order) for s in specs if s.frame != "all"})

    # One summary row per (group, slice), pre-aggregated before it is shuffled by group.
    summary = df.groupBy(*keys).agg(*[_AGG[s.agg](s.value).alias(f"_in_{s.name}") for s in specs])
    carry = summary.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[
            _over(
                Spec(s.name, s.agg, F.col(f"_in_{s.name}"), "before" if s.frame == "upto" else s.frame),
                group,
                [slice_col],
            ).alias(f"_carry_{s.name}")
            for s in specs
        ],
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return (
        local.join(carry, same)
        .withColumns(
            {
                s.name: F.col(f"_carry_{s.name}")
                if s.frame == "all"
                else _MERGE[s.agg](F.col(s.name), F.col(f"_carry_{s.name}"))
                for s in specs
            }
        )
        .drop(*[f"_k{i}" for i in range(len(keys))], *[f"_carry_{s.name}" for s in specs])
    )


@dataclass(frozen=True)
class HotKeys:
    """Keys that hold too many rows for one task. At most (rows / min_rows) of them can exist."""

    values: tuple = ()
    null_key: bool = False

    def __bool__(self) -> bool:
        return bool(self.values) or self.null_key

    def split(self, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """The rows of ordinary keys and those of hot keys."""
        if len(self.values) > MAX_LITERALS:
            spark, kind = df.sparkSession, df.schema[key].dataType
            known = spark.createDataFrame([(v,) for v in self.values], T.StructType([T.StructField("_hot", kind)]))
            marked = df.join(F.broadcast(known), F.col(key) == F.col("_hot"), "left")
            listed = F.col("_hot").isNotNull()
        else:
            marked = df
            listed = F.coalesce(F.col(key).isin(*self.values), F.lit(False)) if self.values else F.lit(False)
        hot = listed | F.col(key).isNull() if self.null_key else listed
        return marked.filter(~hot).select(*df.columns), marked.filter(hot).select(*df.columns)


# Up to this many hot keys are written into the plan; more are broadcast as a table.
MAX_LITERALS = 500
DEFAULT_HOT_ROWS = 2_000_000
DEFAULT_SLICE_SECONDS = 60


def hot_keys(df: DataFrame, key: str, min_rows: int = DEFAULT_HOT_ROWS) -> HotKeys:
    """Find the keys with more than ``min_rows`` rows: one job that reads only the key column and counts map-side."""
    found = df.groupBy(key).count().filter(F.col("count") > min_rows).select(key).collect()
    values = tuple(r[0] for r in found if r[0] is not None)
    return HotKeys(values, len(values) < len(found))


def split_scan(
    df: DataFrame,
    key: str,
    hot: HotKeys,
    body,
    slice_value: Column,
) -> DataFrame:
    """Run ``body(rows, slice_col)`` on ordinary keys in one slice each and on hot keys in many, and put both together."""
    if not hot:
        return body(df, None)
    ordinary, heavy = hot.split(df, key)
    return body(ordinary, None).unionByName(body(heavy.withColumn("_slice", slice_value), "_slice"))


def time_slice(ts: Column, seconds: int = DEFAULT_SLICE_SECONDS) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")
