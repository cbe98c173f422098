"""Usage, cost and conversation reports over the conversation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.operators import conversations, usage
from tallyward.functions import timecols
from tallyward.sources.tables import load
from tallyward.suite.common import AS_OF, Suite, rounded, view

SUITE = Suite()
add = SUITE.add

_COSTED = ["input_no_cache_cost", "input_cache_read_cost", "input_cache_write_cost", "output_cost", "total_cost"]
_VIEWS = ("v_messages", "v_chats", "v_parts", "v_prices")


def _report(spark, folder, grain, **options):
    m, c, p, prices = (view(spark, folder, v) for v in _VIEWS)
    return rounded(usage.usage(m, c, p, prices, grain, AS_OF, **options), 8, *_COSTED)


def _usage_sql(fmt, since, extra=""):
    return f"""
        select strftime(created_at, '{fmt}') as period, count(distinct case when role = 'user' then message_id end) as message_count,
               coalesce(sum(input_no_cache), 0)::bigint as input_no_cache, coalesce(sum(input_cache_read), 0)::bigint as input_cache_read,
               coalesce(sum(input_cache_write), 0)::bigint as input_cache_write, coalesce(sum(output_total), 0)::bigint as output_total,
               coalesce(sum(total), 0)::bigint as total,
               round(sum(coalesce(input_no_cache, 0) * coalesce(price_no_cache, 0) / 1000000.0)::double, 8) as input_no_cache_cost,
               round(sum(coalesce(input_cache_read, 0) * coalesce(price_cache_read, 0) / 1000000.0)::double, 8) as input_cache_read_cost,
               round(sum(coalesce(input_cache_write, 0) * coalesce(price_cache_write, 0) / 1000000.0)::double, 8) as input_cache_write_cost,
               round(sum(coalesce(output_total, 0) * coalesce(price_output, 0) / 1000000.0)::double, 8) as output_cost,
               round(sum((coalesce(input_no_cache, 0) * coalesce(price_no_cache, 0) + coalesce(input_cache_read, 0) * coalesce(price_cache_read, 0)
                        + coalesce(input_cache_write, 0) * coalesce(price_cache_write, 0) + coalesce(output_total, 0) * coalesce(price_output, 0)) / 1000000.0)::double, 8) as total_cost
        from v_messages join v_chats using (chat_id) join v_parts using (message_id) left join v_prices using (provider, model_id)
        where created_at between timestamp '2024-01-31' - interval '{since}' and timestamp '2024-01-31' {extra} group by 1"""


@add("u01_usage_by_day", _usage_sql("%Y-%m-%d", "30 days"), _VIEWS)
def u01(spark, folder):
    return _report(spark, folder, "day")


@add("u01_usage_by_month", _usage_sql("%Y-%m", "360 days", "and project_id = 'proj' and provider = 'p1'"), _VIEWS)
def u01_month(spark, folder):
    return _report(spark, folder, "month", project="proj", provider="p1")


@add(
    "u02_token_cost",
    """select message_id, round((coalesce(input_no_cache, 0) * coalesce(price_no_cache, 0) / 1000000.0 + coalesce(output_total, 0) * coalesce(price_output, 0) / 1000000.0)::double, 8) as cost
       from v_messages join v_parts using (message_id) left join v_prices using (provider, model_id)""",
    _VIEWS,
)
def u02(spark, folder):
    m, _, p, prices = (view(spark, folder, v) for v in _VIEWS)
    joined = m.join(p, "message_id").join(prices, ["provider", "model_id"], "left")
    total = usage.cost(F.col("input_no_cache"), F.col("price_no_cache")) + usage.cost(
        F.col("output_total"), F.col("price_output")
    )
    return joined.select("message_id", F.round(total, 8).alias("cost"))


@add(
    "u03_period_labels",
    """select strftime(ts, '%Y-%m-%d %H:00') as hour, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m') as month, count(*) as events
       from events group by 1, 2, 3""",
)
def u03(spark, folder):
    labels = [timecols.period_label(F.col("ts"), g).alias(g) for g in ("hour", "day", "month")]
    return load(spark, folder, "events").groupBy(*labels).agg(F.count("*").alias("events"))


@add(
    "u04_lookback",
    """select 'hour' as grain, count(*) as events from events where ts >= timestamp '2024-01-30 12:00:00' - interval '24 hours'
       union all select 'day', count(*) from events where ts >= timestamp '2024-02-20' - interval '30 days'
       union all select 'month', count(*) from events where ts >= timestamp '2025-01-10' - interval '360 days'""",
)
def u04(spark, folder):
    events = load(spark, folder, "events")
    kept = [
        events.agg(F.count_if(F.col("ts") >= timecols.lookback_start(at, g)).alias("events")).select(
            F.lit(g).alias("grain"), "events"
        )
        for g, at in (("hour", "2024-01-30 12:00:00"), ("day", "2024-02-20"), ("month", "2025-01-10"))
    ]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def _gaps(name, grain, fmt, step, as_of, n, trunc):
    @add(
        name,
        f"""with u as (select strftime(ts, '{fmt}') as period, count(*) as events, sum(event_id)::bigint as ids from events group by 1),
                 s as (select strftime(date_trunc('{trunc}', timestamp '{as_of}') - i * interval '1 {step}', '{fmt}') as period from range({n}) r(i))
            select period, coalesce(events, 0) as events, coalesce(ids, 0) as ids from s left join u using (period)""",
    )
    def gaps(spark, folder):
        label = timecols.period_label(F.col("ts"), grain).alias("period")
        counted = load(spark, folder, "events").groupBy(label).agg(
            F.count("*").alias("events"), F.sum("event_id").alias("ids")
        )
        return usage.fill_gaps(counted, grain, as_of)


_gaps("u05_fill_hours", "hour", "%Y-%m-%d %H:00", "hour", "2024-01-30 20:30:00", 24, "hour")
_gaps("u05_fill_days", "day", "%Y-%m-%d", "day", "2024-02-10 08:00:00", 30, "day")
_gaps("u05_fill_months", "month", "%Y-%m", "month", "2024-05-31 00:00:00", 12, "month")


@add("u06_used_providers", "select distinct provider from v_messages join v_chats using (chat_id) where provider is not null", _VIEWS)
def u06(spark, folder):
    m, c, _, _ = (view(spark, folder, v) for v in _VIEWS)
    return usage.used_providers(m, c, "proj")


def _text_parts(spark, folder):
    """Each line of a message as a part; short lines count as tool output."""
    turns = load(spark, folder, "conversations")
    return turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"),
        F.posexplode(F.split("text", "\n")).alias("part_no", "text"),
    ).select(
        "message_id",
        F.col("part_no").cast("bigint").alias("part_no"),
        F.when(F.length("text") > 20, "text").otherwise("tool").alias("type"),
        "text",
    )


_PARTS = """
    lines as (select message_id, i - 1 as part_no, l[i] as text, case when length(l[i]) > 20 then 'text' else 'tool' end as type
              from (select conv_id * 100 + turn as message_id, string_split(text, chr(10)) as l, unnest(generate_series(1, len(string_split(text, chr(10))))) as i from conversations))"""


@add(
    "u07_recent_feedback",
    f"""with {_PARTS}, newest as (
            select f.*, 'name of ' || c.user_id as user_name from v_feedback f join v_messages m using (message_id) join v_chats c using (chat_id)
            order by f.created_at desc, f.message_id desc limit 10)
        select message_id, vote, explanation, created_at, user_name,
               (select string_agg(text, ' ' order by part_no) from lines l where l.message_id = n.message_id and type = 'text') as message_text
        from newest n""",
    ("v_feedback", "v_messages", "v_chats"),
)
def u07(spark, folder):
    chats = view(spark, folder, "v_chats")
    users = chats.select("user_id", F.concat(F.lit("name of "), "user_id").alias("user_name")).distinct()
    return conversations.recent_feedback(
        view(spark, folder, "v_feedback"),
        view(spark, folder, "v_messages"),
        chats,
        users,
        _text_parts(spark, folder),
        "proj",
    )


@add(
    "u08_upsert_feedback",
    """with votes as (select message_id, vote, explanation, created_at from v_feedback
                     union all select message_id, 'up', 'second thoughts', created_at + interval '1' day from v_feedback where vote = 'down')
       select message_id, arg_max(vote, (created_at, vote)) as vote, arg_max(explanation, (created_at, vote)) as explanation, min(created_at) as created_at
       from votes group by 1""",
    ("v_feedback",),
)
def u08(spark, folder):
    votes = view(spark, folder, "v_feedback")
    again = votes.filter("vote = 'down'").select(
        "message_id",
        F.lit("up").alias("vote"),
        F.lit("second thoughts").alias("explanation"),
        (F.col("created_at") + F.expr("interval 1 day")).alias("created_at"),
    )
    return conversations.upsert_feedback(votes, again)


_SEARCH = """
    titled as (select chat_id, title, updated_at from v_chats where contains(lower(title), 'tion') order by updated_at desc, chat_id limit 6),
    content as (select c.chat_id, c.title, c.updated_at, l.text, message_id, part_no from lines l join v_messages using (message_id) join v_chats c using (chat_id)
                where contains(lower(l.text), 'tion') order by c.updated_at desc, c.chat_id, message_id, part_no limit 12),
    firsts as (select chat_id, title, updated_at, arg_min(text, (message_id, part_no)) as matched_text from content
               where chat_id not in (select chat_id from titled) group by 1, 2, 3),
    ranked as (select row_number() over (order by branch, updated_at desc, chat_id) as rank, chat_id, title, matched_text from (
        select 0 as branch, chat_id, title, updated_at, null as matched_text from titled union all select 1, * from firsts))"""


@add(
    "u09_search_chats",
    f"with {_PARTS}, {_SEARCH} select * from ranked where rank <= 6",
    ("v_messages", "v_chats"),
)
def u09(spark, folder):
    return conversations.search_chats(
        view(spark, folder, "v_chats"), view(spark, folder, "v_messages"), _text_parts(spark, folder), "TION", n=6
    )


@add(
    "u10_assemble",
    f"""with {_PARTS} select chat_id, title, message_id, role, part_no, text, vote,
               dense_rank() over (partition by chat_id order by m.created_at, message_id) as message_no
        from v_chats join v_messages m using (chat_id) join lines using (message_id) left join (select message_id, vote from v_feedback) f using (message_id)""",
    ("v_messages", "v_chats", "v_feedback"),
)
def u10(spark, folder):
    found = conversations.assemble(
        view(spark, folder, "v_chats"),
        view(spark, folder, "v_messages"),
        _text_parts(spark, folder),
        view(spark, folder, "v_feedback"),
    )
    return found.select("chat_id", "title", "message_id", "role", "part_no", "text", "vote", "message_no")


def _upserted(spark, folder):
    m = view(spark, folder, "v_messages").select("message_id", "chat_id", "role")
    p = _text_parts(spark, folder).select("message_id", "part_no", "text")
    old_m, old_p = m.filter("role <> 'assistant'"), p.filter("length(text) < 60")
    new_m = m.filter("role <> 'user'").withColumn("role", F.upper("role"))
    new_p = p.join(new_m.select("message_id"), "message_id", "left_semi").withColumn("text", F.lower("text"))
    return conversations.upsert_messages(old_m, old_p, new_m, new_p)


@add(
    "u11_upsert_messages",
    """select message_id, chat_id, role from v_messages where role <> 'assistant'
       union all select message_id, chat_id, upper(role) from v_messages where role = 'assistant'""",
    ("v_messages",),
)
def u11(spark, folder):
    return _upserted(spark, folder)[0]


@add(
    "u11_upsert_parts",
    f"""with {_PARTS} select message_id, part_no, text from lines join v_messages using (message_id) where role = 'user' and length(text) < 60
        union all select message_id, part_no, lower(text) from lines join v_messages using (message_id) where role <> 'user'""",
    ("v_messages",),
)
def u11_parts(spark, folder):
    return _upserted(spark, folder)[1]


@add(
    "u12_range_filter",
    " union all ".join(
        f"""select '{n}' as span, count(*) as orders, min(o_orderdate) as first_at from orders
            where o_orderdate >= (select max(o_orderdate) from orders) - interval '{i}'"""
        for n, i in (("7d", "7 days"), ("30d", "30 days"), ("3m", "3 months"), ("6m", "6 months"), ("1y", "1 year"))
    ),
)
def u12(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderdate")
    rows = usage.range_rows(orders, "o_orderdate", ["7d", "30d", "3m", "6m", "1y"])
    return rows.groupBy("span").agg(F.count("*").alias("orders"), F.min("o_orderdate").alias("first_at"))


@add(
    "u13_chart_series",
    """with g as (select o_orderpriority as x, count(*)::double as orders, round(avg(o_totalprice), 2) as value from orders group by 1)
       select x, 'orders' as series, orders as value from g union all select x, 'mean', value from g""",
)
def u13(spark, folder):
    grouped = load(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("orders"), F.round(F.avg("o_totalprice"), 2).alias("mean")
    )
    return usage.chart_series(grouped, "o_orderpriority", ["orders", "mean"])
