"""Time slots. Versions are milliseconds, interval arguments are seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(seconds: Column) -> Column:
    return seconds * 1000


def slot_start(ts_ms: Column, interval: int) -> Column:
    """Start of the slot of ``interval`` seconds that holds ``ts_ms``."""
    return ts_ms - F.pmod(ts_ms, F.lit(interval * 1000))


def slot_end(ts_ms: Column, interval: int) -> Column:
    return slot_start(ts_ms, interval) + interval * 1000


def date_label(ts_ms: Column) -> Column:
    """Month-day-year label, in the session time zone (UTC)."""
    return F.date_format(F.timestamp_millis(ts_ms), "MM-dd-yyyy")
