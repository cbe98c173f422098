"""Column expressions over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward import fixed


def truncate(grain: str, ts: Column) -> Column:
    """Start of the period; stays a zone-less timestamp."""
    return F.date_trunc(grain, ts).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def minutes_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(60_000_000.0)


def at(when: str | Column) -> Column:
    """A zone-less timestamp from ISO text, or the column itself."""
    return when if isinstance(when, Column) else F.lit(when).cast("timestamp_ntz")


def days_before(when: str | Column, days: int) -> Column:
    return (at(when) - F.make_dt_interval(F.lit(days))).cast("timestamp_ntz")


def period_label(ts: Column, grain: str) -> Column:
    return F.date_format(ts, fixed.PERIOD_FORMAT[grain].replace(":00", "':00'"))


def lookback_start(when: str | Column, grain: str) -> Column:
    """First instant that still counts for a usage report; months count 30 days each."""
    hours = {"hour": 1, "day": 24, "month": 24 * 30}[grain] * fixed.PERIODS[grain]
    return (at(when) - F.make_dt_interval(F.lit(0), F.lit(hours))).cast("timestamp_ntz")


def within(frame: DataFrame, column: str, start: Column | None, end: Column, day: str | None = None) -> DataFrame:
    """Rows with ``start <= column <= end``.

    With ``day``, the column the table is partitioned by, the same bounds are
    put on the day, so that Spark leaves out the other partitions.
    """
    inside = F.col(column) <= end
    if day is not None:
        inside = inside & (F.col(day) <= F.to_date(end))
    if start is not None:
        inside = inside & (F.col(column) >= start)
        if day is not None:
            inside = inside & (F.col(day) >= F.to_date(start))
    return frame.filter(inside)
