"""Append once beyond any watermark; repeated batches add nothing."""

from pyspark.sql import functions as F

from tallyward.operators.ledger import append_once
from tallyward.session import scratch
from tallyward.streaming import appendonce
from tallyward.streaming.streams import stream_table

SHAPE = "key string, at bigint, what string"


def test_batches(spark, rows):
    folder = scratch(spark, "once")
    batches = [
        [("a", 1, "first a"), ("b", 2, "late b"), ("b", 1, "first b"), (None, 1, "no key")],
        [("a", 0, "again a"), ("c", 5, "first c")],
        [],
        # far behind: any watermark would have forgotten these keys
        [("b", -10**9, "again b"), ("d", 7, "first d")],
    ]
    frames = [spark.createDataFrame(b, SHAPE) for b in batches]
    for number, frame in enumerate(frames):
        appendonce.append_batch(frame, number, folder, "s", "key", ["at"])
    want = [("a", 1, "first a"), ("b", 1, "first b"), ("c", 5, "first c"), ("d", 7, "first d")]
    table = lambda: appendonce.appended(spark, folder, frames[0].schema)
    assert rows(table(), "key", "at", "what") == want
    # the last batch runs again, whole or after half of it was written
    appendonce.append_batch(frames[3], 3, folder, "s", "key", ["at"])
    assert rows(table(), "key", "at", "what") == want
    half = spark.createDataFrame([("other", 3)], "key string, part int")
    half.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/keys/source=s/batch=3")
    appendonce.append_batch(frames[3], 3, folder, "s", "key", ["at"])
    assert rows(table(), "key", "at", "what") == want
    # the drained table is that of one batch
    whole = None
    for frame in frames:
        frame = frame.filter("key is not null")
        whole = frame.limit(0) if whole is None else whole
        whole = append_once(whole, frame, "key", ["at"])
    assert rows(table(), "key", "at", "what") == rows(whole)


def test_a_stream_that_starts_again(spark, small):
    folder = scratch(spark, "once")
    events = stream_table(spark, small, "events").select("event_id", "ts", F.col("event_type").alias("key"))
    appendonce.append_once_stream(events, folder, "one", "key", ["ts", "event_id"])
    appendonce.append_once_stream(events, folder, "one", "key", ["ts", "event_id"])
    appendonce.append_once_stream(events, folder, "two", "key", ["ts", "event_id"])
    found = appendonce.appended(spark, folder, events.schema)
    assert found.count() == spark.read.parquet(f"{small}/events.parquet").select("event_type").distinct().count()
    assert {r.source for r in found.collect()} == {"one"}
