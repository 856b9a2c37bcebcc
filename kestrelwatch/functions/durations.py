"""ISO-8601 durations and trigger intervals, parsed on the driver."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = re.compile(
    r"^(?P<sign>[-+]?)P(?:(?P<d>[-+]?\d+)D)?"
    r"(?P<t>T(?:(?P<h>[-+]?\d+)H)?(?:(?P<m>[-+]?\d+)M)?(?:(?P<s>[-+]?\d+(?:[.,]\d{1,9})?)S)?)?$",
    re.IGNORECASE,
)


def parse_duration(text: str) -> timedelta:
    """``P3D``, ``PT1H``, ``P1DT2H30M`` and so on; days are 24 hours."""
    found = _DURATION.match(text.strip())
    parts = found.groupdict() if found else {}
    if not found or (parts["t"] or "").upper() == "T" or not any(parts[k] for k in "dhms"):
        raise ValueError(f"not an ISO-8601 duration: {text!r}")
    span = timedelta(
        days=int(parts["d"] or 0),
        hours=int(parts["h"] or 0),
        minutes=int(parts["m"] or 0),
        seconds=float((parts["s"] or "0").replace(",", ".")),
    )
    return -span if parts["sign"] == "-" else span


def parse_interval(text: str) -> str:
    """A trigger interval such as ``5 minutes``: a number and a unit, both required."""
    if not re.fullmatch(r"\d+ \w+", text):
        raise ValueError(f"not a trigger interval such as '5 minutes': {text!r}")
    return text


def plus(ts: Column, span: timedelta) -> Column:
    """Timestamp plus a fixed duration, exact to the microsecond."""
    return ts + F.lit(span)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch, rounded down, also before 1970."""
    return F.floor(F.unix_micros(ts) / F.lit(1_000_000)).cast("long")
