"""Structured Streaming forms of the event operators.

Streams are written to files with a checkpoint in the shared folder; the file
sink commits each batch once, so a restarted stream neither loses nor repeats
rows. Rows later than the watermark are dropped by design and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyward.operators.eventlog import EventLayout, checked_events
from tallyward.session import scratch


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # the bracket makes the path a pattern, which may also match a single file
    return reader.parquet(path[:-1] + "[t]")


def drain(stream: DataFrame, label: str, partition_by: list[str] = (), folder: str | None = None):
    """Write everything available to files; ``(table, query)``.

    ``folder`` continues an earlier stream from its checkpoint.
    """
    spark = stream.sparkSession
    folder = folder or scratch(spark, label)
    writer = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start()
    # Spark keeps the progress of the last batches only, so it is summed up while the stream runs
    dropped: dict[int, int] = {}
    while not query.awaitTermination(1):
        dropped |= _dropped(query)
    query.late_rows = sum((dropped | _dropped(query)).values())
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), query


def _dropped(query) -> dict[int, int]:
    """Rows dropped by the watermark in each batch whose progress is still kept."""
    return {
        p["batchId"]: sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"]) for p in query.recentProgress
    }


def late_rows(query) -> int:
    """Rows that a query of ``drain`` dropped over its whole run because they came after the watermark."""
    return query.late_rows


def ingest_stream(incoming: DataFrame, layout: EventLayout, now=None) -> DataFrame:
    """Checked events with ``accepted``; partition the sink by it to keep rejects apart.

    Without ``now`` the write time is that of the batch, which Spark logs, so
    a repeated batch writes the same rows.
    """
    moment = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    checked = checked_events(incoming, layout, moment)
    return checked.withColumn("accepted", F.col("reject_reason").isNull())


def _timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark needs a zoned time; with the session in UTC it is the same instant."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _plain(column: str | Column, name: str) -> Column:
    moment = F.col(column) if isinstance(column, str) else column
    return moment.cast("timestamp_ntz").alias(name)


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first row of each key; keys are remembered for the watermark's delay."""
    unique = _timed(stream, ts, delay).dropDuplicatesWithinWatermark(keys)
    return unique.select(*[_plain(c, c) if c == ts else F.col(c) for c in stream.columns])


def _windows(ts: str, length: str, slide: str | None) -> Column:
    return F.window(ts, length, slide) if slide else F.window(ts, length)


def signals_stream(
    stream: DataFrame, layout: EventLayout, length: str, slide: str | None, delay: str
) -> DataFrame:
    """Events per type in windows of ``length``, sliding by ``slide`` or tumbling."""
    window = _windows(layout.ts, length, slide).alias("_window")
    counted = _timed(stream, layout.ts, delay).groupBy(window, layout.type).agg(F.count("*").alias("events"))
    return counted.select(
        _plain("_window.start", "window_start"), _plain("_window.end", "window_end"), layout.type, "events"
    )


def rates_stream(
    stream: DataFrame, layout: EventLayout, kinds: dict[str, str], length: str, slide: str | None, delay: str
) -> DataFrame:
    """Counts of named event types side by side per window."""
    window = _windows(layout.ts, length, slide).alias("_window")
    counts = [F.count_if(F.col(layout.type) == t).alias(n) for n, t in kinds.items()]
    counted = _timed(stream, layout.ts, delay).groupBy(window).agg(*counts)
    return counted.select(_plain("_window.start", "window_start"), _plain("_window.end", "window_end"), *kinds)


def case_sessions(stream: DataFrame, key: str, layout: EventLayout, idle: str, delay: str) -> DataFrame:
    """Closed runs of a case's events with no pause longer than ``idle``.

    Counts, first and last times combine before the shuffle.
    """
    runs = (
        _timed(stream.filter(F.col(key).isNotNull()), layout.ts, delay)
        .groupBy(F.session_window(layout.ts, idle).alias("_run"), key)
        .agg(F.count("*").alias("events"), F.min(layout.ts).alias("first_ts"), F.max(layout.ts).alias("last_ts"))
    )
    return runs.select(key, "events", _plain("first_ts", "first_ts"), _plain("last_ts", "last_ts"))


CASE_OUTPUT = "case_id bigint, events bigint, last_us bigint, gap_us bigint, closed boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _case_processor(idle_ms: int) -> StatefulProcessor:
    """The stateful step; a local class, so that workers need not have this package."""

    class CaseState(StatefulProcessor):
        """Events so far and last time of one case; a case that idles out is closed and forgotten."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("case", "events bigint, last_us bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            events, last_us = self.state.get() if self.state.exists() else (0, None)
            first_us, newest_us = None, last_us
            for row in rows:
                events += row.events
                first_us = row.first_us if first_us is None else min(first_us, row.first_us)
                newest_us = row.last_us if newest_us is None else max(newest_us, row.last_us)
            gap = None if last_us is None else first_us - last_us
            self.state.update((events, newest_us))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest_us // 1000 + idle_ms)
            yield self._row(key, events, newest_us, gap, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            events, last_us = self.state.get()
            self.state.clear()
            yield self._row(key, events, last_us, None, True)

        def close(self) -> None:
            pass

        @staticmethod
        def _row(key, events, last_us, gap, closed) -> Row:
            return Row(case_id=key[0], events=events, last_us=last_us, gap_us=gap, closed=closed)

    return CaseState()


def case_state_stream(
    stream: DataFrame, key: str, layout: EventLayout, delay: str, pulse: str = "1 hour", idle_hours: int = 24
) -> DataFrame:
    """Live state of each case: events so far, last time, minutes since the state before.

    Events are first counted per case and ``pulse`` with map-side combine, so
    the stateful step receives one row per case and pulse however busy a case
    is; it handles plain rows. A case without events for ``idle_hours`` is closed. The session must
    use the RocksDB state store (``STATE_STORE``).
    """
    us = F.unix_micros(F.col(layout.ts))
    pulses = (
        _timed(stream.filter(F.col(key).isNotNull()), layout.ts, delay)
        .groupBy(F.window(layout.ts, pulse), F.col(key).alias("case_id"))
        .agg(F.count("*").alias("events"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    )
    states = pulses.groupBy("case_id").transformWithState(
        statefulProcessor=_case_processor(idle_hours * 3_600_000),
        outputStructType=CASE_OUTPUT,
        outputMode="append",
        timeMode="eventTime",
    )
    return states.select(
        "case_id",
        "events",
        _plain(F.timestamp_micros("last_us"), "last_ts"),
        (F.col("gap_us") / F.lit(60_000_000.0)).alias("minutes_since_previous"),
        "closed",
    )
