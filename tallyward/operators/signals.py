"""Process signals over an event log within a window that ends at ``as_of``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions import timecols
from tallyward.operators.eventlog import EventLayout
from tallyward.plans.ordered import next_after

MAX_DAYS = 365


def whole_number(name: str, value, most: int | None = None) -> int:
    """Check of an integer parameter."""
    if isinstance(value, str):
        value = float(value) if value.strip() else float("nan")
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value != int(value):
        raise ValueError(f"{name} must be a whole number, not {value!r}")
    if most is not None and value > most:
        raise ValueError(f"{name} must be at most {most}")
    return int(value)


def _recent(frame: DataFrame, column: str, as_of: str, days, day: str | None = None) -> DataFrame:
    """Rows of the window, both ends included; of a log partitioned by ``day`` only the days it touches are read."""
    start = timecols.days_before(as_of, whole_number("days", days, MAX_DAYS))
    return timecols.within(frame, column, start, timecols.at(as_of), day)


def event_distribution(
    events: DataFrame, as_of: str, days: int = 30, layout: EventLayout = EventLayout(), top: int | None = 20
) -> DataFrame:
    """Events per type with their share of all events in the window; ``top=None`` keeps every type.

    The total is a window over the rows per type, so the events are read once.
    """
    counted = _recent(events, layout.ts, as_of, days, layout.day).groupBy(layout.type).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    share = F.round((F.col("count") * 100.0 / total).cast("double"), 1)
    return _head(counted.withColumn("percentage", share), [F.col("count").desc(), F.col(layout.type)], top)


def _head(df: DataFrame, order: list, top: int | None) -> DataFrame:
    return df if top is None else df.orderBy(*order).limit(top)


def failure_rates(
    events: DataFrame,
    as_of: str,
    kinds: dict[str, str],
    ratios: dict[str, tuple[str, str]] | None = None,
    days: int = 30,
    layout: EventLayout = EventLayout(),
) -> DataFrame:
    """One row: events per named type, counted in a single pass.

    ``kinds`` maps output names to event types, ``ratios`` an output name to
    a pair ``(part, rest)`` reported as part / (part + rest).
    """
    recent = _recent(events, layout.ts, as_of, days, layout.day)
    counts = recent.agg(*[F.count_if(F.col(layout.type) == t).alias(n) for n, t in kinds.items()])
    for name, (part, rest) in (ratios or {}).items():
        whole = F.nullif((F.col(part) + F.col(rest)).cast("double"), F.lit(0.0))
        counts = counts.withColumn(name, F.round(F.col(part) / whole, 4))
    return counts


def step_pairs(
    events: DataFrame,
    key: str,
    from_types: list[str],
    to_types: list[str],
    as_of: str,
    days: int = 30,
    layout: EventLayout = EventLayout(),
    split: bool = False,
) -> DataFrame:
    """``from_step, to_step, minutes, pairs``: each start with the next event of each target type.

    The next event is strictly later in the same case. Events of one case at
    one instant are first reduced to a row of counts per type, so ties weigh
    in as a product of counts and never as rows.
    """
    types = sorted(set(from_types) | set(to_types))
    stage = {t: f"t{i}" for i, t in enumerate(types)}
    moments = (
        _recent(events, layout.ts, as_of, days, layout.day)
        .filter(F.col(key).isNotNull() & F.col(layout.type).isin(*types))
        .groupBy(F.col(key).alias("case_id"), timecols.micros(F.col(layout.ts)).alias("us"))
        .agg(*[F.count_if(F.col(layout.type) == t).alias(c) for t, c in stage.items()])
    )
    nearest = next_after(
        moments,
        "case_id",
        "us",
        {
            f"next_{stage[t]}": F.when(F.col(stage[t]) > 0, F.struct(F.col("us"), F.col(stage[t]).alias("n")))
            for t in to_types
        },
        split,
    )
    pairs = [
        F.when(
            (F.col(stage[a]) > 0) & F.col(f"next_{stage[b]}").isNotNull(),
            F.struct(
                F.lit(a).alias("from_step"),
                F.lit(b).alias("to_step"),
                ((F.col(f"next_{stage[b]}.us") - F.col("us")) / F.lit(60_000_000.0)).alias("minutes"),
                (F.col(stage[a]) * F.col(f"next_{stage[b]}.n")).alias("pairs"),
            ),
        )
        for a in from_types
        for b in to_types
    ]
    return nearest.select(F.inline(F.array_compact(F.array(*pairs))))


def step_durations(
    events: DataFrame,
    key: str,
    from_types: list[str],
    to_types: list[str],
    as_of: str,
    days: int = 30,
    layout: EventLayout = EventLayout(),
    top: int | None = 10,
    split: bool = False,
) -> DataFrame:
    """Average, least and greatest minutes between process steps, slowest first."""
    pairs = step_pairs(events, key, from_types, to_types, as_of, days, layout, split)
    weighted = F.sum(F.col("minutes") * F.col("pairs")) / F.sum("pairs")
    result = pairs.groupBy("from_step", "to_step").agg(
        F.round(weighted, 1).alias("avg_minutes"),
        F.round(F.min("minutes"), 1).alias("min_minutes"),
        F.round(F.max("minutes"), 1).alias("max_minutes"),
        F.sum("pairs").alias("sample_size"),
    )
    if top is None:
        return result
    return result.orderBy(F.col("avg_minutes").desc(), "from_step", "to_step").limit(top)


def delay_patterns(
    facts: DataFrame,
    parents: DataFrame,
    fact_key: str,
    parent_key: str,
    time_column: str,
    reason: str,
    minutes: str,
    as_of: str,
    days: int = 30,
    top: int | None = 10,
) -> DataFrame:
    """Count and size of delays per reason for facts whose parent exists.

    Facts are combined per parent and reason before the join; a parent that
    is listed several times counts its facts as often.
    """
    combined = (
        _recent(facts, time_column, as_of, days)
        .groupBy(F.col(fact_key).alias("_key"), F.col(reason).alias("reason"))
        .agg(
            F.count("*").alias("_rows"),
            F.count(minutes).alias("_n"),
            F.sum(F.col(minutes).cast("double")).alias("_sum"),
            F.max(F.col(minutes).cast("double")).alias("_max"),
        )
    )
    present = parents.groupBy(F.col(parent_key).alias("_parent")).agg(F.count("*").alias("_times"))
    joined = combined.join(present, F.col("_key") == F.col("_parent"))
    result = joined.groupBy("reason").agg(
        F.sum(F.col("_rows") * F.col("_times")).alias("delay_count"),
        F.round(F.sum(F.col("_sum") * F.col("_times")) / F.sum(F.col("_n") * F.col("_times")), 1).alias("avg_minutes"),
        F.round(F.max("_max"), 1).alias("max_minutes"),
        F.round(F.sum(F.col("_sum") * F.col("_times")), 0).alias("total_minutes"),
    )
    return _head(result, [F.col("delay_count").desc(), F.col("reason")], top)


def status_distribution(
    frame: DataFrame, status: str, time_column: str, as_of: str, days: int = 30, top: int | None = 20
) -> DataFrame:
    counted = _recent(frame, time_column, as_of, days).groupBy(status).agg(F.count("*").alias("count"))
    return _head(counted, [F.col("count").desc(), F.col(status)], top)


def status_for(frame: DataFrame, status: str, column: str, value=None, top: int | None = 20) -> DataFrame:
    """Rows per status, optionally of one parent only; no value means no filter."""
    if value is not None:
        frame = frame.filter(F.col(column) == whole_number(column, value))
    counted = frame.groupBy(status).agg(F.count("*").alias("count"))
    return _head(counted, [F.col("count").desc(), F.col(status)], top)
