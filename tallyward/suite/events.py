"""Event log and process signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.operators import eventlog, signals
from tallyward.operators.eventlog import CaseKey, EventLayout
from tallyward.sources.tables import load
from tallyward.suite.common import AS_OF, Suite, view

SUITE = Suite()
add = SUITE.add

FROM = ["signup", "view", "click"]
TO = ["view", "click", "purchase"]


def _events(spark, folder):
    return load(spark, folder, "events")


def _incoming(spark, folder):
    raw = view(spark, folder, "v_incoming")
    pairs = F.from_json("correlations_text", "map<string,string>")
    return raw.withColumn("correlations", pairs).drop("correlations_text")


@add(
    "e01_ingest_accepted",
    r"""select row_no, event_type, case when c is not null then cast(cast(c as double) as bigint) end as user_id,
               timestamp '2024-02-01' as ts, coalesce(metadata, '{}') as props
        from (select *, nullif(regexp_extract(correlations_text, '"user_id":"([^"]*)"', 1), '') as c from v_incoming)
        where correlations_text not like '%order_id%' and (c is null or try_cast(c as double) = floor(try_cast(c as double)))""",
    ("v_incoming",),
)
def e01(spark, folder):
    good, _ = eventlog.ingest_events(_incoming(spark, folder), EventLayout(), "2024-02-01")
    return good


@add(
    "e01_ingest_rejected",
    r"""select row_no, case when correlations_text like '%order_id%' then 'unknown key: order_id' else 'not an integer: user_id' end as reject_reason
        from (select *, nullif(regexp_extract(correlations_text, '"user_id":"([^"]*)"', 1), '') as c from v_incoming)
        where correlations_text like '%order_id%' or c is not null and coalesce(try_cast(c as double) <> floor(try_cast(c as double)), true)""",
    ("v_incoming",),
)
def e01_rejected(spark, folder):
    _, rejected = eventlog.ingest_events(_incoming(spark, folder), EventLayout(), "2024-02-01")
    return rejected.select("row_no", "reject_reason")


@add(
    "e02_case_timeline",
    """select row_number() over (order by ts, event_id) as step, event_id, event_type, ts,
              cast(floor((epoch_us(ts) - epoch_us(lag(ts) over (order by ts, event_id))) / 60000000.0 + 0.5) as bigint) as minutes_since_previous,
              user_id, props from (select * from events where user_id = 7 order by ts, event_id limit 100)""",
)
def e02(spark, folder):
    return eventlog.case_timeline(_events(spark, folder), "user_id", 7)


_TIMELINES = """select event_id, user_id, event_type, row_number() over w as step,
       cast(floor((epoch_us(ts) - epoch_us(lag(ts) over w)) / 60000000.0 + 0.5) as bigint) as minutes_since_previous
    from events where user_id is not null window w as (partition by user_id order by ts, event_id)"""


@add("e03_case_timelines", _TIMELINES)
def e03(spark, folder):
    rows = eventlog.case_timelines(_events(spark, folder), "user_id")
    return rows.select("event_id", "user_id", "event_type", "step", "minutes_since_previous")


@add("e03_case_timelines_split", _TIMELINES)
def e03_split(spark, folder):
    rows = eventlog.case_timelines(_events(spark, folder), "user_id", split=True)
    return rows.select("event_id", "user_id", "event_type", "step", "minutes_since_previous")


@add(
    "e03_case_totals",
    """select user_id, count(*) as total_events, min(ts) as first_ts, max(ts) as last_ts,
              cast(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 + 0.5) as bigint) as total_minutes
       from events where user_id is not null group by 1""",
)
def e03_totals(spark, folder):
    return eventlog.case_totals(_events(spark, folder), "user_id")


@add(
    "e04_event_distribution",
    """select event_type, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 1)::double as percentage from events
       where ts between timestamp '2024-01-31' - interval '20' day and timestamp '2024-01-31' group by 1 order by count desc, event_type limit 20""",
)
def e04(spark, folder):
    return signals.event_distribution(_events(spark, folder), AS_OF, 20)


@add(
    "e05_failure_rates",
    """select count(*) filter (where event_type = 'error') as failures, count(*) filter (where event_type = 'purchase') as successes,
              count(*) filter (where event_type = 'click') as cancellations, count(*) filter (where event_type = 'signup') as total_bookings,
              round(count(*) filter (where event_type = 'error') / count(*) filter (where event_type in ('error', 'purchase'))::double, 4) as failure_rate
       from events where ts between timestamp '2024-01-31' - interval '20' day and timestamp '2024-01-31'""",
)
def e05(spark, folder):
    kinds = {"failures": "error", "successes": "purchase", "cancellations": "click", "total_bookings": "signup"}
    return signals.failure_rates(
        _events(spark, folder), AS_OF, kinds, {"failure_rate": ("failures", "successes")}, 20
    )


_DURATIONS = """
    with seen as (select * from events where ts between timestamp '{at}' - interval '25' day and timestamp '{at}'), pairs as (
        select a.event_type as from_step, b.event_type as to_step, a.user_id, a.ts as t1, b.ts as t2
        from seen a join seen b on a.user_id = b.user_id and b.ts > a.ts
        where a.event_type in ('signup', 'view', 'click') and b.event_type in ('view', 'click', 'purchase')
          and not exists (select 1 from seen c where c.user_id = a.user_id and c.event_type = b.event_type and c.ts > a.ts and c.ts < b.ts))
    select from_step, to_step, round(avg((epoch_us(t2) - epoch_us(t1)) / 60000000.0), 1) as avg_minutes,
           round(min((epoch_us(t2) - epoch_us(t1)) / 60000000.0), 1) as min_minutes,
           round(max((epoch_us(t2) - epoch_us(t1)) / 60000000.0), 1) as max_minutes, count(*) as sample_size
    from pairs group by 1, 2 order by avg_minutes desc, from_step, to_step limit 10"""


@add("e06_step_durations", _DURATIONS.format(at="2024-01-31"))
def e06(spark, folder):
    return signals.step_durations(_events(spark, folder), "user_id", FROM, TO, AS_OF, 25)


@add("e06_step_durations_split", _DURATIONS.format(at="2024-01-31"))
def e06_split(spark, folder):
    return signals.step_durations(_events(spark, folder), "user_id", FROM, TO, AS_OF, 25, split=True)


@add("e06_step_durations_midway", _DURATIONS.format(at="2024-01-10"))
def e06_midway(spark, folder):
    return signals.step_durations(_events(spark, folder), "user_id", FROM, TO, "2024-01-10", 25)


@add(
    "e04_event_distribution_midway",
    """select event_type, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 1)::double as percentage from events
       where ts between timestamp '2024-01-03' and timestamp '2024-01-10' group by 1""",
)
def e04_midway(spark, folder):
    return signals.event_distribution(_events(spark, folder), "2024-01-10", 7, top=None)


@add(
    "e05_failure_rates_midway",
    """select count(*) filter (where event_type = 'error') as failures from events
       where ts between timestamp '2024-01-03' and timestamp '2024-01-10'""",
)
def e05_midway(spark, folder):
    return signals.failure_rates(_events(spark, folder), "2024-01-10", {"failures": "error"}, days=7)


@add(
    "e08_status_distribution_midway",
    """select o_orderstatus, count(*) as count from orders where o_orderdate between timestamp '1997-01-01' - interval '365' day and timestamp '1997-01-01'
       group by 1""",
)
def e08_midway(spark, folder):
    orders = load(spark, folder, "orders")
    return signals.status_distribution(orders, "o_orderstatus", "o_orderdate", "1997-01-01", 365, top=None)


@add(
    "e11_freshness_midway",
    """with t as (select 'orders' as table_name, max(o_orderdate) as last from orders where o_orderdate <= timestamp '1997-01-01 12:00:00'
                  union all select 'lineitem', max(l_shipdate) from lineitem where l_shipdate <= timestamp '1997-01-01 12:00:00'),
            j as (select *, cast(floor((epoch_us(timestamp '1997-01-01 12:00:00') - epoch_us(last)) / 60000000.0 + 0.5) as bigint) as age from t)
       select table_name, 1000::bigint as max_delay_minutes, null::bigint as max_delay_hours, 1000::bigint as max_minutes, age as age_minutes, age <= 1000 as fresh from j""",
)
def e11_midway(spark, folder):
    slas = spark.createDataFrame(
        [("orders", 1000, None), ("lineitem", 1000, None)],
        "table_name string, max_delay_minutes bigint, max_delay_hours bigint",
    )
    tables = {
        "orders": (load(spark, folder, "orders"), "o_orderdate"),
        "lineitem": (load(spark, folder, "lineitem"), "l_shipdate"),
    }
    return eventlog.freshness(tables, slas, "1997-01-01 12:00:00")


@add(
    "e07_delay_patterns",
    """select l_returnflag as reason, count(*) as delay_count, round(avg(l_quantity), 1) as avg_minutes,
              round(max(l_quantity), 1) as max_minutes, round(sum(l_quantity), 0) as total_minutes
       from lineitem join orders on l_orderkey = o_orderkey
       where l_shipdate between timestamp '2000-12-31' - interval '365' day and timestamp '2000-12-31' group by 1 order by delay_count desc, reason limit 10""",
)
def e07(spark, folder):
    return signals.delay_patterns(
        load(spark, folder, "lineitem"),
        load(spark, folder, "orders"),
        "l_orderkey",
        "o_orderkey",
        "l_shipdate",
        "l_returnflag",
        "l_quantity",
        "2000-12-31",
        365,
    )


@add(
    "e08_status_distribution",
    """select o_orderstatus, count(*) as count from orders where o_orderdate between timestamp '2001-08-01' - interval '365' day and timestamp '2001-08-01'
       group by 1 order by count desc, o_orderstatus limit 20""",
)
def e08(spark, folder):
    return signals.status_distribution(load(spark, folder, "orders"), "o_orderstatus", "o_orderdate", "2001-08-01", 365)


@add(
    "e09_optional_filter",
    """select 'one' as asked, l_returnflag, count(*) as count from lineitem where l_suppkey = 3 group by 2
       union all select 'all', l_returnflag, count(*) from lineitem group by 2""",
)
def e09(spark, folder):
    lines = load(spark, folder, "lineitem")
    one = signals.status_for(lines, "l_returnflag", "l_suppkey", 3)
    every = signals.status_for(lines, "l_returnflag", "l_suppkey", None)
    return one.select(F.lit("one").alias("asked"), "*").unionByName(every.select(F.lit("all").alias("asked"), "*"))


_CASES = """
    numbered as (select {key} as k, event_type, row_number() over (partition by {key} order by ts, event_id) as n from events where {key} is not null),
    cases as (select k, count(*) as steps, string_agg(event_type, '>' order by n) as whole from numbered group by 1),
    grouped as (select min(k) as variant, steps, count(*) as cases from cases group by steps, whole)"""
_VARIANTS = f"""with {_CASES} select variant, steps, cases, round(cases * 100.0 / (select count(*) from cases), 2)::double as share from grouped"""
_STEPS = f"""with {_CASES} select variant, n as step, event_type as type from grouped join numbered on k = variant"""


@add("e10_variants", _VARIANTS.format(key="user_id"))
def e10(spark, folder):
    return eventlog.variants(_events(spark, folder), "user_id")


@add("e10_variant_steps", _STEPS.format(key="user_id"))
def e10_steps(spark, folder):
    return eventlog.variant_steps(_events(spark, folder), "user_id")


def _hourly(spark, folder):
    return _events(spark, folder).withColumn("hour", F.date_trunc("hour", "ts"))


@add("e10_variants_by_hour", _VARIANTS.format(key="date_trunc('hour', ts)"))
def e10_hours(spark, folder):
    return eventlog.variants(_hourly(spark, folder), "hour", EventLayout(keys=(CaseKey("hour", "string"),)), split=True)


@add("e10_variant_steps_by_hour", _STEPS.format(key="date_trunc('hour', ts)"))
def e10_hour_steps(spark, folder):
    return eventlog.variant_steps(_hourly(spark, folder), "hour", EventLayout(keys=(CaseKey("hour", "string"),)))


def _slas(spark, folder):
    """SLAs told from the event types themselves, plus tables without an SLA."""
    kinds = _events(spark, folder).groupBy("event_type").agg(F.count("*").alias("n"))
    named = kinds.select(
        F.regexp_replace("event_type", "e?w?s?$", "").alias("table_name"),
        F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("n") * 5).cast("bigint").alias("max_delay_minutes"),
        F.when(F.col("event_type") == "view", F.lit(30)).cast("bigint").alias("max_delay_hours"),
    )
    return named.unionByName(
        kinds.agg(F.lit("Zebras").alias("table_name"), F.lit(9).cast("bigint").alias("max_delay_minutes"),
                  F.lit(None).cast("bigint").alias("max_delay_hours"))
    )


@add(
    "e11_freshness",
    r"""with kinds as (select event_type, count(*) as n from events group by 1),
          slas as (select regexp_replace(event_type, 'e?w?s?$', '') as table_name, case when event_type <> 'click' then n * 5 end as max_delay_minutes,
                          case when event_type = 'view' then 30 end as max_delay_hours from kinds
                   union all select 'Zebras', 9, null),
          aged as (select s.*, max(ts) as last from slas s left join (select event_type, max(ts) as ts from events where ts <= timestamp '2024-01-31' group by 1) e
                     on upper(substr(e.event_type, 1, 1)) || substr(e.event_type, 2) like upper(substr(table_name, 1, 1)) || substr(table_name, 2) || '%' group by 1, 2, 3),
          judged as (select *, case when max_delay_minutes is not null or max_delay_hours is not null then coalesce(max_delay_minutes, coalesce(max_delay_hours, 24) * 60) end as max_minutes,
                       cast(floor((epoch_us(timestamp '2024-01-31') - epoch_us(last)) / 60000000.0 + 0.5) as bigint) as age from aged)
        select table_name, max_delay_minutes, max_delay_hours, max_minutes, case when max_minutes is not null then age end as age_minutes,
               max_minutes is null or coalesce(age <= max_minutes, false) as fresh from judged""",
)
def e11(spark, folder):
    capitalised = _events(spark, folder).withColumn("event_type", F.initcap("event_type"))
    return eventlog.freshness_by_type(capitalised, _slas(spark, folder), AS_OF)


@add(
    "e11_freshness_own_time",
    """with t as (select 'orders' as table_name, max(o_orderdate) as last from orders where o_orderdate <= timestamp '2001-12-01' union all select 'lineitem', max(l_shipdate) from lineitem where l_shipdate <= timestamp '2001-12-01'),
            s(table_name, max_delay_minutes, max_delay_hours) as (values ('orders', 100000, null), ('lineitem', null, 1), ('events', 5, null), ('part', null, null)),
            j as (select s.*, case when s.max_delay_minutes is not null or s.max_delay_hours is not null then coalesce(s.max_delay_minutes, s.max_delay_hours * 60) end as max_minutes,
                    cast(floor((epoch_us(timestamp '2001-12-01') - epoch_us(last)) / 60000000.0 + 0.5) as bigint) as age from s left join t using (table_name))
       select table_name, max_delay_minutes::bigint as max_delay_minutes, max_delay_hours::bigint as max_delay_hours, max_minutes::bigint as max_minutes,
              case when max_minutes is not null then age end as age_minutes, max_minutes is null or coalesce(age <= max_minutes, false) as fresh from j""",
)
def e11_own(spark, folder):
    slas = spark.createDataFrame(
        [("orders", 100000, None), ("lineitem", None, 1), ("events", 5, None), ("part", None, None)],
        "table_name string, max_delay_minutes bigint, max_delay_hours bigint",
    )
    tables = {
        "orders": (load(spark, folder, "orders"), "o_orderdate"),
        "lineitem": (load(spark, folder, "lineitem"), "l_shipdate"),
    }
    return eventlog.freshness(tables, slas, "2001-12-01")
