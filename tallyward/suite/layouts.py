"""Event log operators over a log laid out by day or by case; each query writes its layout from the events first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyward.operators import eventlog, signals
from tallyward.operators.eventlog import EventLayout
from tallyward.session import scratch
from tallyward.sources import eventtables
from tallyward.sources.tables import load
from tallyward.suite import events as plain
from tallyward.suite.common import AS_OF, Suite

SUITE = Suite()
add = SUITE.add

BUCKETS = 8


def by_day(spark, folder):
    """The events as a log partitioned by day, and its layout."""
    path = scratch(spark, "log")
    layout = eventtables.append_by_day(load(spark, folder, "events"), EventLayout(), path)
    return eventtables.read_log(spark, path), layout


def by_case(spark, folder, days=False):
    """The events bucketed by user, and their layout; with days the catalog keeps the table, as it holds the list of days."""
    table = f"cases_{uuid.uuid4().hex}"
    layout = eventtables.write_by_case(
        load(spark, folder, "events"), EventLayout(), "user_id", table, BUCKETS, scratch(spark, "cases"), days
    )
    rows = spark.table(table)
    if not days:
        spark.sql(f"drop table {table}")
    return rows, layout


@add(
    "io5_append_by_day",
    "select cast(ts as date) as day, count(*) as events, sum(value) as value from events group by 1",
)
def io5(spark, folder):
    path = scratch(spark, "log")
    rows = load(spark, folder, "events")
    layout = eventtables.append_by_day(rows.filter(F.col("event_id") % 2 == 0), EventLayout(), path)
    eventtables.append_by_day(rows.filter(F.col("event_id") % 2 == 1), EventLayout(), path)
    # a batch of days that is run again replaces what it wrote
    again = rows.filter(F.to_date("ts").between("2024-01-05", "2024-01-08"))
    eventtables.append_by_day(again, layout, path, replace=True)
    log = eventtables.read_log(spark, path)
    return log.groupBy("day").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


@add("e04_event_distribution_by_day", plain.SUITE.oracles["e04_event_distribution"])
def e04(spark, folder):
    log, layout = by_day(spark, folder)
    return signals.event_distribution(log, AS_OF, 20, layout)


@add("e05_failure_rates_by_day", plain.SUITE.oracles["e05_failure_rates_midway"])
def e05(spark, folder):
    log, layout = by_day(spark, folder)
    return signals.failure_rates(log, "2024-01-10", {"failures": "error"}, days=7, layout=layout)


@add("e06_step_durations_by_day", plain.SUITE.oracles["e06_step_durations_midway"])
def e06(spark, folder):
    log, layout = by_day(spark, folder)
    return signals.step_durations(log, "user_id", plain.FROM, plain.TO, "2024-01-10", 25, layout)


@add("e06_step_durations_bucketed", plain.SUITE.oracles["e06_step_durations"])
def e06_bucketed(spark, folder):
    log, layout = by_case(spark, folder, days=True)
    return signals.step_durations(log, "user_id", plain.FROM, plain.TO, AS_OF, 25, layout)


@add("e02_case_timeline_bucketed", plain.SUITE.oracles["e02_case_timeline"])
def e02(spark, folder):
    log, layout = by_case(spark, folder)
    return eventlog.case_timeline(log, "user_id", 7, layout)


@add("e03_case_timelines_bucketed", plain.SUITE.oracles["e03_case_timelines"])
def e03(spark, folder):
    log, layout = by_case(spark, folder)
    rows = eventlog.case_timelines(log, "user_id", layout)
    return rows.select("event_id", "user_id", "event_type", "step", "minutes_since_previous")


@add("e03_case_totals_bucketed", plain.SUITE.oracles["e03_case_totals"])
def e03_totals(spark, folder):
    log, layout = by_case(spark, folder)
    return eventlog.case_totals(log, "user_id", layout)


@add("e10_variants_bucketed", plain.SUITE.oracles["e10_variants"])
def e10(spark, folder):
    log, layout = by_case(spark, folder)
    return eventlog.variants(log, "user_id", layout)


@add("e10_variant_steps_bucketed", plain.SUITE.oracles["e10_variant_steps"])
def e10_steps(spark, folder):
    log, layout = by_case(spark, folder)
    return eventlog.variant_steps(log, "user_id", layout)
