"""Streaming forms of the event operators, drained and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.functions.keys import content_key
from tallyward.operators.eventlog import EventLayout
from tallyward.session import scratch
from tallyward.streaming import appendonce, streams
from tallyward.suite.common import Suite

SUITE = Suite()
add = SUITE.add
LAYOUT = EventLayout()


def _events(spark, folder):
    return streams.stream_table(spark, folder, "events")


@add(
    "x01_stream_ingest",
    """select event_id as row_no, event_type, case when event_type = 'error' then null else user_id end as user_id,
              timestamp '2024-02-01' as ts, props, event_type <> 'view' as accepted from events""",
)
def x01(spark, folder):
    key = F.when(F.col("event_type") == "view", F.lit("no_such_key")).otherwise(F.lit("user_id"))
    value = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("user_id").cast("string"))
    incoming = _events(spark, folder).select(
        F.col("event_id").alias("row_no"),
        "event_type",
        F.when(F.col("event_type") == "view", F.create_map(F.lit("no_such_key"), F.lit("1"), F.lit("user_id"), value))
        .otherwise(F.create_map(key, value))
        .alias("correlations"),
        F.col("props").alias("metadata"),
    )
    checked = streams.ingest_stream(incoming, LAYOUT, "2024-02-01").drop("correlations", "reject_reason")
    table, _ = streams.drain(checked, "ingest", ["accepted"])
    return table.select("row_no", "event_type", "user_id", "ts", "props", "accepted")


@add("x02_dedupe", "select event_type, count(distinct props) as keys from events group by 1")
def x02(spark, folder):
    twice = _events(spark, folder).select("ts", "event_type", "props")
    unique = streams.dedupe_stream(twice.unionByName(twice), ["event_type", "props"], "ts", "60 days")
    table, _ = streams.drain(unique, "dedupe")
    return table.groupBy("event_type").agg(F.count("*").alias("keys"))


@add("x02_append_once", "select event_type, count(distinct props) as keys, 'first' as source from events group by 1")
def x02_once(spark, folder):
    """The events come twice; the second stream is behind any watermark of the first."""
    target = scratch(spark, "once")
    rows = _events(spark, folder).select("event_id", "ts", "event_type", "props", content_key(F.col("event_type"), F.col("props")).alias("key"))
    for source in ("first", "again"):
        appendonce.append_once_stream(rows, target, source, "key", ["ts", "event_id"])
    table = appendonce.appended(spark, target, rows.schema)
    return table.groupBy("event_type", "source").agg(F.count("*").alias("keys"))


@add(
    "x03_tumbling_signals",
    """with w as (select date_trunc('day', ts) as window_start, event_type, count(*) as events from events group by 1, 2)
       select window_start, window_start + interval '1 day' as window_end, event_type, events from w
       where window_start + interval '1 day' <= (select max(ts) from events) - interval '1 day'""",
)
def x03(spark, folder):
    counted = streams.signals_stream(_events(spark, folder), LAYOUT, "1 day", None, "1 day")
    table, _ = streams.drain(counted, "tumbling")
    return table


@add(
    "x03_sliding_rates",
    """with s as (select unnest(generate_series(date_trunc('day', ts) - interval '6 days', date_trunc('day', ts), interval '1 day')) as window_start, event_type from events),
            w as (select window_start, count(*) filter (where event_type = 'error') as failures, count(*) filter (where event_type = 'purchase') as successes from s group by 1)
       select window_start, window_start + interval '7 days' as window_end, failures, successes from w
       where window_start + interval '7 days' <= (select max(ts) from events) - interval '1 day'""",
)
def x03_sliding(spark, folder):
    kinds = {"failures": "error", "successes": "purchase"}
    counted = streams.rates_stream(_events(spark, folder), LAYOUT, kinds, "7 days", "1 day", "1 day")
    table, _ = streams.drain(counted, "sliding")
    return table


@add(
    "x04_case_sessions",
    """with g as (select user_id, ts, case when ts > lag(ts) over w + interval '6 hours' or lag(ts) over w is null then 1 else 0 end as opens
                  from events where user_id is not null window w as (partition by user_id order by ts, event_id)),
            r as (select user_id, ts, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as run from g),
            s as (select user_id, run, count(*) as events, min(ts) as first_ts, max(ts) as last_ts from r group by 1, 2)
       select user_id, events, first_ts, last_ts from s where last_ts + interval '6 hours' <= (select max(ts) from events) - interval '1 day'""",
)
def x04(spark, folder):
    runs = streams.case_sessions(_events(spark, folder), "user_id", LAYOUT, "6 hours", "1 day")
    table, _ = streams.drain(runs, "sessions")
    return table


def _states(spark, folder):
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, streams.STATE_STORE)
    try:
        states = streams.case_state_stream(_events(spark, folder), "user_id", LAYOUT, "1 day")
        return streams.drain(states, "cases")[0]
    finally:
        spark.conf.set(setting, before)


@add(
    "x04_case_state",
    """with mark as (select date_trunc('millisecond', max(ts) - interval '1 day') as m from events),
            seen as (select user_id as case_id, count(*) as events, max(ts) as last_ts from events
                     where user_id is not null and date_trunc('hour', ts) + interval '1 hour' <= (select m from mark) group by 1)
       select case_id, events, last_ts, null::double as minutes_since_previous, false as closed from seen
       union all select case_id, events, last_ts, null, true from seen
           where date_trunc('millisecond', last_ts) + interval '24 hours' <= (select m from mark)""",
)
def x04_state(spark, folder):
    return _states(spark, folder)


@add(
    "x04_case_state_totals",
    """select user_id as case_id, count(*) as events, max(ts) as last_ts from events
       where date_trunc('hour', ts) + interval '1 hour' <= date_trunc('millisecond', (select max(ts) from events) - interval '1 day') group by 1""",
)
def x04_totals(spark, folder):
    open_states = _states(spark, folder).filter("not closed")
    return open_states.groupBy("case_id").agg(F.max("events").alias("events"), F.max("last_ts").alias("last_ts"))
