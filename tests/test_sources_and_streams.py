from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyward.operators.eventlog import EventLayout
from tallyward.session import scratch, shared_root
from tallyward.sources import files, tables
from tallyward.streaming import streams

LAYOUT = EventLayout()


def write_day(spark, folder, rows):
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    tables.append(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), folder, "events")


def day(n, count, user=1):
    return [(n * 100 + i, datetime(2024, 1, n, 1) + timedelta(minutes=i), user, "view", 1.0, "{}") for i in range(count)]


def test_shared_folder_comes_from_the_session(spark):
    root = shared_root(spark)
    assert spark.conf.get("spark.checkpoint.dir") == root
    assert scratch(spark, "x").startswith(shared_root(spark)) and scratch(spark, "x") != scratch(spark, "x")


def test_restarted_stream_neither_loses_nor_repeats(spark):
    folder, sink = scratch(spark, "src"), scratch(spark, "sink")
    write_day(spark, folder, day(1, 5))
    plain = lambda: streams.stream_table(spark, folder, "events").select("event_id")
    table, _ = streams.drain(plain(), "t", folder=sink)
    assert table.count() == 5
    write_day(spark, folder, day(2, 3))
    table, _ = streams.drain(plain(), "t", folder=sink)
    assert sorted(r[0] for r in table.collect()) == [100, 101, 102, 103, 104, 200, 201, 202]


def test_late_rows_are_dropped_and_counted(spark):
    folder, sink = scratch(spark, "src"), scratch(spark, "sink")
    counted = lambda: streams.signals_stream(
        streams.stream_table(spark, folder, "events"), LAYOUT, "1 day", None, "1 day"
    )
    write_day(spark, folder, day(10, 4))
    streams.drain(counted(), "t", folder=sink)
    write_day(spark, folder, day(2, 2) + day(15, 1))
    table, query = streams.drain(counted(), "t", folder=sink)
    # two late rows fall into one group of the partial count
    assert streams.late_rows(query) == 1
    got = {str(r["window_start"])[:10]: r["events"] for r in table.collect()}
    assert got == {"2024-01-10": 4}


def test_sliding_windows_equal_batch(spark):
    folder = scratch(spark, "src")
    write_day(spark, folder, day(1, 5) + day(2, 7) + day(3, 2) + day(20, 1))
    stream = streams.stream_table(spark, folder, "events")
    table, _ = streams.drain(streams.rates_stream(stream, LAYOUT, {"views": "view"}, "2 days", "1 day", "1 day"), "t")
    got = {str(r["window_start"])[:10]: r["views"] for r in table.collect()}
    assert got == {"2023-12-31": 5, "2024-01-01": 12, "2024-01-02": 9, "2024-01-03": 2}


def test_dedupe(spark):
    folder = scratch(spark, "src")
    write_day(spark, folder, day(1, 3) + day(1, 3))
    unique = streams.dedupe_stream(streams.stream_table(spark, folder, "events"), ["event_id"], "ts", "10 days")
    table, _ = streams.drain(unique, "t")
    assert table.count() == 3 and table.schema["ts"].dataType.simpleString() == "timestamp_ntz"


def test_case_state_over_several_batches(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    folder, sink = scratch(spark, "src"), scratch(spark, "sink")
    live = lambda: streams.case_state_stream(
        streams.stream_table(spark, folder, "events"), "user_id", LAYOUT, "1 hour", idle_hours=24 * 3
    )
    write_day(spark, folder, day(1, 5) + day(2, 1, user=2))
    streams.drain(live(), "t", folder=sink)
    write_day(spark, folder, day(3, 2) + day(4, 1, user=2))
    streams.drain(live(), "t", folder=sink)
    write_day(spark, folder, day(20, 1, user=3))
    table, _ = streams.drain(live(), "t", folder=sink)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    case = [(r["events"], r["minutes_since_previous"], r["closed"]) for r in table.filter("case_id = 1").orderBy("closed", "events").collect()]
    assert (5, None, False) in case and (7, 2 * 1440 - 4.0, False) in case
    assert case[-1] == (7, None, True)


def test_copy_reports_rows_and_keeps_types(spark, small):
    target = scratch(spark, "copy")
    report = {r["table_name"]: (r["rows"], r["columns"]) for r in tables.copy_tables(spark, small, target, ["nation", "embeddings"]).collect()}
    assert report["nation"] == (25, 3)
    copied = tables.load(spark, target, "embeddings")
    assert copied.schema["embedding"].dataType.simpleString() == "string"
    again = tables.copy_tables(spark, small, target, ["nation"]).first()
    assert again["rows"] == 25 and tables.load(spark, target, "nation").count() == 25


def test_files(spark):
    folder = scratch(spark, "files")
    spark.range(3).repartition(1).write.parquet(f"{folder}/a/b/one")
    spark.range(3).repartition(1).write.parquet(f"{folder}/a/two")
    found = files.find_files(spark, folder, "*.parquet", ignore=["two"])
    assert [r["dir"] for r in found.collect()] == ["/a/b/one"]
    summary = {r["dir"]: (r["files"], r["folders"]) for r in files.dir_summary(files.find_files(spark, folder, "*.parquet")).collect()}
    assert summary["/"] == (0, 1) and summary["/a"] == (0, 2) and summary["/a/two"] == (1, 0)
    for bad in ("/etc/*", "../x"):
        with pytest.raises(ValueError):
            files.find_files(spark, folder, bad)
