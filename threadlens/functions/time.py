"""Times as texts, numbers and ranges; all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_compact(digits: Column) -> Column:
    """``yyyyMMddHHmmss`` as a timestamp; null if it is no such text."""
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))


def epoch_seconds(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss 'UTC'") -> Column:
    return F.unix_timestamp(F.to_timestamp(text, pattern))


def nearest_second(ts: Column) -> Column:
    """Epoch seconds of a timestamp, with or without a zone: the nearest whole one, of two equally near the even one."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long")


def with_offset(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss+HH`` as epoch seconds: the offset is taken off; without one it is UTC."""
    base = F.unix_timestamp(F.to_timestamp(F.substring(text, 1, 19), "yyyy-MM-dd HH:mm:ss"))
    hours = F.regexp_extract(text, "([+-][0-9]+)$", 1)
    return base - F.when(text.rlike(":[0-9]+[+-][0-9]+$"), hours.cast("int")).otherwise(0) * 3600


def hour_before(now: Column) -> tuple[Column, Column]:
    """The full hour that ended an hour ago: [start, end)."""
    hour = F.date_trunc("hour", now)
    return hour - F.expr("INTERVAL 2 HOURS"), hour - F.expr("INTERVAL 1 HOUR")
