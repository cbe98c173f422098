"""Usage and cost of conversations, and chart preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward import fixed
from tallyward.functions import timecols

TOKENS = ["input_no_cache", "input_cache_read", "input_cache_write", "output_total"]
PRICES = ["price_no_cache", "price_cache_read", "price_cache_write", "price_output"]
COSTS = ["input_no_cache_cost", "input_cache_read_cost", "input_cache_write_cost", "output_cost"]


def cost(tokens: Column, price_per_million: Column) -> Column:
    return F.coalesce(tokens, F.lit(0)) * F.coalesce(price_per_million, F.lit(0.0)) / F.lit(1_000_000.0)


def usage(
    messages: DataFrame,
    chats: DataFrame,
    parts: DataFrame,
    prices: DataFrame,
    grain: str,
    as_of: str,
    project: str | None = None,
    provider: str | None = None,
) -> DataFrame:
    """User messages, tokens and cost per period label.

    ``messages``: message_id, chat_id, role, provider, model_id, created_at.
    ``parts`` carry the token counters and are summed per message before
    anything is joined, so a message is one row afterwards and user messages
    can be counted plainly; parts of messages outside the window are left out
    before that. ``prices`` are per million tokens; an unpriced model costs
    nothing.
    """
    created = F.col("created_at")
    recent = messages.filter((created >= timecols.lookback_start(as_of, grain)) & (created <= timecols.at(as_of)))
    if provider is not None:
        recent = recent.filter(F.col("provider") == provider)
    scoped = chats if project is None else chats.filter(F.col("project_id") == project)
    recent = recent.join(scoped.select("chat_id"), "chat_id")
    wanted = parts.join(recent.select("message_id"), "message_id", "left_semi")
    per_message = wanted.groupBy("message_id").agg(
        *[F.sum(t).alias(t) for t in [*TOKENS, "total"]]
    )
    joined = (
        recent.join(per_message, "message_id")
        .join(prices, ["provider", "model_id"], "left")
    )
    rows = joined.groupBy(timecols.period_label(F.col("created_at"), grain).alias("period")).agg(
        F.count_if(F.col("role") == "user").alias("message_count"),
        *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in [*TOKENS, "total"]],
        *[F.sum(cost(F.col(t), F.col(p))).alias(c) for t, p, c in zip(TOKENS, PRICES, COSTS)],
    )
    return rows.withColumn("total_cost", sum((F.col(c) for c in COSTS[1:]), F.col(COSTS[0])))


def period_series(spark, grain: str, as_of: str) -> DataFrame:
    """The labels of the last periods up to and including the one of ``as_of``."""
    steps = F.col("id").cast("int")
    start = timecols.truncate(grain, timecols.at(as_of))
    back = {
        "hour": lambda: start - F.make_dt_interval(F.lit(0), steps),
        "day": lambda: start - F.make_dt_interval(steps),
        "month": lambda: F.add_months(start, -steps).cast("timestamp_ntz"),
    }[grain]()
    return spark.range(fixed.PERIODS[grain]).select(timecols.period_label(back, grain).alias("period"))


def fill_gaps(rows: DataFrame, grain: str, as_of: str) -> DataFrame:
    """One row for every period of the series; missing ones are zero, others are dropped."""
    series = period_series(rows.sparkSession, grain, as_of)
    joined = series.join(rows, "period", "left")
    return joined.na.fill(0, [c for c in rows.columns if c != "period"])


def used_providers(messages: DataFrame, chats: DataFrame, project: str | None = None) -> DataFrame:
    scoped = chats if project is None else chats.filter(F.col("project_id") == project)
    named = messages.filter(F.col("provider").isNotNull()).select("provider", "chat_id").distinct()
    return named.join(scoped.select("chat_id"), "chat_id", "left_semi").select("provider").distinct()


def _span_start(newest: Column, span: str) -> Column:
    months = {"3m": 3, "6m": 6, "1y": 12}.get(span)
    if months is None:
        return newest - F.make_dt_interval(F.lit({"7d": 7, "30d": 30}[span]))
    return newest - F.make_ym_interval(F.lit(0), F.lit(months))


def range_filter(df: DataFrame, x: str, span: str) -> DataFrame:
    """Rows within 7d, 30d, 3m, 6m or 1y of the newest date; ``all`` keeps everything.

    Text that is no date is dropped. Months end on the last day where a day
    does not exist.
    """
    if span == "all":
        return df
    moment = F.col(x).try_cast("timestamp_ntz")
    return df.filter(moment >= _span_start(df.agg(F.max(moment)).scalar(), span))


def range_rows(df: DataFrame, x: str, spans: list[str]) -> DataFrame:
    """Rows with a column ``span``, once for each of ``spans`` that ``range_filter`` keeps them in.

    The newest date is worked out once for all of them.
    """
    moment = F.col(x).try_cast("timestamp_ntz")
    newest = df.agg(F.max(moment)).scalar()
    held = [F.lit(s) if s == "all" else F.when(moment >= _span_start(newest, s), F.lit(s)) for s in spans]
    return df.withColumn("span", F.explode(F.array_compact(F.array(*held))))


def chart_series(df: DataFrame, x: str, series: list[str]) -> DataFrame:
    """``x, series, value``: the chosen columns in long form."""
    pairs = F.array(
        *[F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("value")) for s in series]
    )
    return df.select(F.col(x).alias("x"), F.inline(pairs))
