"""Event logs by day and by case: what is read, what is shuffled, and that results are those of the plain log."""

import re

import pytest
from pyspark.sql import functions as F

from tallyward.operators import eventlog, signals
from tallyward.operators.eventlog import EventLayout
from tallyward.session import scratch
from tallyward.sources import eventtables
from tallyward.suite import layouts
from tallyward.suite.common import AS_OF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def by_day(spark, small):
    return layouts.by_day(spark, small)


@pytest.fixture(scope="module")
def by_case(spark, small):
    return layouts.by_case(spark, small)


def test_a_week_reads_eight_days(spark, by_day):
    log, layout = by_day
    assert log.select("day").distinct().count() == 30
    week = signals._recent(log, layout.ts, "2024-01-10 06:00:00", 7, layout.day)
    read = re.search(r"PartitionFilters: \[([^\]]*)\]", plan(week))[1]
    assert "day" in read and "2024-01-03" in read and "2024-01-10" in read
    days = {re.search("day=([0-9-]+)", f)[1] for f in week.inputFiles()}
    assert len(days) == 30  # the files known to the table
    week.collect()
    scan = week._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numPartitions").value() == 8


@pytest.mark.parametrize("what", ["timelines", "variants", "totals"])
def test_cases_are_not_shuffled(by_case, what):
    log, layout = by_case
    if what == "timelines":
        assert "Exchange" not in plan(eventlog.case_timelines(log, "user_id", layout))
    elif what == "totals":
        assert "Exchange" not in plan(eventlog.case_totals(log, "user_id", layout))
    else:
        numbered, cases = eventlog._numbered_cases(log, "user_id", layout, False)
        assert "Exchange" not in plan(numbered) and "Exchange" not in plan(cases)


def test_durations_over_days_and_buckets(spark, small):
    log, layout = layouts.by_case(spark, small, days=True)
    found = signals.step_pairs(log, "user_id", ["view"], ["click"], "2024-01-10", 7, layout)
    text = plan(found)
    assert "Exchange" not in text and "2024-01-03" in re.search(r"PartitionFilters: \[([^\]]*)\]", text)[1]


def test_one_case_is_read_from_one_bucket(by_case):
    log, layout = by_case
    assert "SelectedBucketsCount: 1 out of 8" in plan(eventlog.case_timeline(log, "user_id", 7, layout))


def test_odd_events(spark, rows):
    layout = EventLayout()
    events = spark.createDataFrame(
        [(1, "view", None, 5, "{}"), (2, None, "2024-01-02 00:00:00", None, None), (3, "view", "2024-01-02 23:59:59.999", 5, "{}"), (3, "view", "2024-01-02 23:59:59.999", 5, "{}")],
        "event_id bigint, event_type string, ts string, user_id bigint, props string",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    path = scratch(spark, "odd")
    by_day = eventtables.append_by_day(events, layout, path)
    log = eventtables.read_log(spark, path)
    assert rows(log, *events.columns) == rows(events)
    assert rows(signals.event_distribution(log, AS_OF, 30, by_day)) == rows(signals.event_distribution(events, AS_OF, 30))
    # the day is replaced as a whole, and no other
    eventtables.append_by_day(events.filter("event_id = 3"), layout, path, replace=True)
    assert rows(eventtables.read_log(spark, path), *events.columns) == rows(events.filter("event_id <> 2"))
    with pytest.raises(ValueError, match="column 'day' already"):
        eventtables.append_by_day(log, layout, path)
    with pytest.raises(ValueError, match="unknown case key"):
        eventtables.write_by_case(events, layout, "order_id", "t", 4)
    eventtables.append_by_day(events.limit(0), layout, scratch(spark, "none"))
