"""An event log laid out for its readers: by day for windows, by case for timelines.

``append_by_day`` partitions the log by day. Operators that look at a window of
time state the days it touches when their layout names the day column, so Spark
lists and reads only those folders. ``write_by_case`` buckets a log by a
correlation key and sorts each bucket by case and time: numbering, durations
and variants then need no shuffle, and one case is read from one bucket. The
two combine: buckets inside days.

A bucket holds whole cases. A log with a case too large for one task is kept by
day only, and its readers ask for ``split``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.eventlog import EventLayout

DAY = "day"


def with_day(events: DataFrame, layout: EventLayout) -> DataFrame:
    """Add the day of each event, null where it has no time."""
    if (layout.day or DAY) in events.columns:
        raise ValueError(f"the events have a column {layout.day or DAY!r} already")
    return events.withColumn(layout.day or DAY, F.to_date(layout.ts))


def append_by_day(events: DataFrame, layout: EventLayout, path: str, replace: bool = False) -> EventLayout:
    """Append events to a log partitioned by day; the layout to read it with.

    Rows of one day come together before they are written, so a day gets few
    files; a large day is cut into several tasks. ``replace`` overwrites the
    days that occur in ``events`` and no others, so a batch can be run again.
    """
    day = layout.day or DAY
    rows = with_day(events, layout).hint("rebalance", day)
    writer = rows.write.partitionBy(day)
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)
    return layout.by_day(day)


def write_by_case(
    events: DataFrame, layout: EventLayout, key: str, table: str, buckets: int, path: str | None = None, days: bool = False
) -> EventLayout:
    """Write events as a table of ``buckets`` buckets by case, sorted by case, time and id; the layout to read it with.

    Each bucket is one file, or one for each day with ``days``. Rows without
    the key stay in the log. Choose the buckets so that one fits a task.
    """
    layout.key(key)
    rows, day = events, None
    if days:
        day = layout.day or DAY
        rows = with_day(events, layout)
    writer = rows.repartition(buckets, key).write.mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    if day is not None:
        writer = writer.partitionBy(day)
    writer.bucketBy(buckets, key).sortBy(key, layout.ts, layout.id).saveAsTable(table)
    return layout.by_day(day) if day else layout


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log written by ``append_by_day``."""
    return spark.read.parquet(path)
