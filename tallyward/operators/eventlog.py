"""The append-only event log: ingest, case timelines, variants, freshness."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions import timecols
from tallyward.functions.literals import text_array
from tallyward.plans.ordered import number_rows


@dataclass(frozen=True)
class CaseKey:
    """A correlation key; ``kind`` is ``int`` or ``string``."""

    name: str
    kind: str = "int"


@dataclass(frozen=True)
class EventLayout:
    """Column names of an event table; ``day`` is the one it is partitioned by, if any."""

    id: str = "event_id"
    type: str = "event_type"
    ts: str = "ts"
    keys: tuple[CaseKey, ...] = (CaseKey("user_id"),)
    metadata: str | None = "props"
    day: str | None = None

    def by_day(self, day: str) -> EventLayout:
        return replace(self, day=day)

    def key(self, name: str) -> CaseKey:
        found = next((k for k in self.keys if k.name == name), None)
        if found is None:
            raise ValueError(f"unknown case key {name!r}, declared: {[k.name for k in self.keys]}")
        return found


def _key_value(key: CaseKey) -> Column:
    given = F.try_element_at("correlations", F.lit(key.name))
    if key.kind != "int":
        return given
    number = given.try_cast("double")
    whole = F.when(number == F.floor(number), number.try_cast("bigint"))
    return F.coalesce(given.try_cast("bigint"), whole)


def checked_events(incoming: DataFrame, layout: EventLayout, now: str | Column) -> DataFrame:
    """Incoming rows as event rows plus ``reject_reason`` (null when acceptable).

    ``incoming`` has ``event_type``, ``correlations`` (map of text to text)
    and, if the layout keeps it, ``metadata`` JSON text. ``now`` is the write
    time. Works on batches and streams alike.
    """
    known = text_array([k.name for k in layout.keys])
    unknown = F.array_except(F.map_keys("correlations"), known)
    odd = F.array_compact(
        F.array(
            *[
                F.when(
                    F.try_element_at("correlations", F.lit(k.name)).isNotNull() & _key_value(k).isNull(),
                    F.lit(k.name),
                )
                for k in layout.keys
            ]
        )
    )
    reason = (
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown key: "), F.array_join(unknown, ", ")))
        .when(F.size(odd) > 0, F.concat(F.lit("not an integer: "), F.array_join(odd, ", ")))
    )
    columns = [F.col("event_type").alias(layout.type), *[_key_value(k).alias(k.name) for k in layout.keys]]
    columns.append(timecols.at(now).alias(layout.ts))
    if layout.metadata:
        columns.append(F.coalesce("metadata", F.lit("{}")).alias(layout.metadata))
    carried = [c for c in incoming.columns if c not in ("event_type", "correlations", "metadata")]
    return incoming.select(*carried, *columns, "correlations", reason.alias("reject_reason"))


def ingest_events(incoming: DataFrame, layout: EventLayout, now: str | Column) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``."""
    checked = checked_events(incoming, layout, now)
    good = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason", "correlations")
    return good, checked.filter(F.col("reject_reason").isNotNull())


def case_timeline(events: DataFrame, key: str, case_id, layout: EventLayout = EventLayout(), limit: int = 100) -> DataFrame:
    """The first ``limit`` events of one case in time order.

    The top-n cut happens before the window, so the window sees at most
    ``limit`` rows.
    """
    layout.key(key)
    head = (
        events.filter(F.col(key) == case_id)
        .orderBy(layout.ts, layout.id)
        .limit(limit)
    )
    w = Window.partitionBy(key).orderBy(layout.ts, layout.id)
    gap = timecols.half_up(timecols.minutes_between(F.col(layout.ts), F.lag(layout.ts).over(w)))
    extra = [layout.metadata] if layout.metadata else []
    return head.select(
        F.row_number().over(w).cast("bigint").alias("step"),
        layout.id,
        layout.type,
        layout.ts,
        gap.alias("minutes_since_previous"),
        *[k.name for k in layout.keys],
        *extra,
    )


def case_timelines(
    events: DataFrame, key: str, layout: EventLayout = EventLayout(), split: bool = False
) -> DataFrame:
    """Step number and minutes since the previous event for every event of every case."""
    rows = events.filter(F.col(key).isNotNull())
    numbered = number_rows(rows, key, [layout.ts, layout.id], layout.ts, split)
    gap = timecols.half_up(timecols.minutes_between(F.col(layout.ts), F.col("prev")))
    return numbered.withColumn("minutes_since_previous", gap).withColumnRenamed("seq", "step").drop("prev")


def case_totals(events: DataFrame, key: str, layout: EventLayout = EventLayout()) -> DataFrame:
    """Events and total minutes per case; combined before the shuffle."""
    grouped = events.filter(F.col(key).isNotNull()).groupBy(key)
    totals = grouped.agg(
        F.count("*").alias("total_events"),
        F.min(layout.ts).alias("first_ts"),
        F.max(layout.ts).alias("last_ts"),
    )
    minutes = timecols.half_up(timecols.minutes_between(F.col("last_ts"), F.col("first_ts")))
    return totals.withColumn("total_minutes", minutes)


def _numbered_cases(events: DataFrame, key: str, layout: EventLayout, split: bool) -> tuple[DataFrame, DataFrame]:
    """Events with their place in the case, and per case its length and two order-aware hashes."""
    numbered = number_rows(
        events.filter(F.col(key).isNotNull()).select(key, layout.ts, layout.id, layout.type),
        key,
        [layout.ts, layout.id],
        layout.ts,
        split,
    )
    cases = numbered.groupBy(key).agg(
        F.count("*").alias("steps"),
        F.bit_xor(F.xxhash64("seq", layout.type)).alias("_h1"),
        F.bit_xor(F.xxhash64(layout.type, F.lit("second"), "seq")).alias("_h2"),
    )
    return numbered, cases


def _counted_variants(cases: DataFrame, key: str) -> DataFrame:
    return cases.groupBy("steps", "_h1", "_h2").agg(F.count("*").alias("cases"), F.min(key).alias("variant"))


def variants(events: DataFrame, key: str, layout: EventLayout = EventLayout(), split: bool = False) -> DataFrame:
    """Distinct type sequences with the number and share of the cases that follow them.

    Sequences are told apart over their whole length by two order-aware
    64-bit hashes that combine before the shuffle, so no case is ever
    gathered in one place. ``variant`` is the least case of each sequence;
    ``variant_steps`` gives its steps. The share is taken from a window over
    the variants, so the events are read once.
    """
    _, cases = _numbered_cases(events, key, layout, split)
    counted = _counted_variants(cases, key)
    share = F.round(F.col("cases") * 100.0 / F.sum("cases").over(Window.partitionBy()), 2)
    return counted.select("variant", "steps", "cases", share.cast("double").alias("share"))


def variant_steps(events: DataFrame, key: str, layout: EventLayout = EventLayout(), split: bool = False) -> DataFrame:
    """``variant, step, type``: the whole sequence of every variant, one row per step."""
    numbered, cases = _numbered_cases(events, key, layout, split)
    named = _counted_variants(cases, key).select("variant")
    rows = numbered.join(named, numbered[key] == named["variant"])
    return rows.select("variant", F.col("seq").alias("step"), F.col(layout.type).alias("type"))


def freshness_by_type(
    events: DataFrame, slas: DataFrame, as_of: str, layout: EventLayout = EventLayout(), prefix: Column | None = None
) -> DataFrame:
    """Age of the newest event up to ``as_of`` whose type starts with the capitalised table name.

    ``slas`` has ``table_name, max_delay_minutes, max_delay_hours``. A table
    without an SLA is fresh, one without events is stale. Plural table names
    do not match singular event types; ``prefix`` can give another pattern.
    The events are first reduced to one row per type.
    """
    until = timecols.within(events, layout.ts, None, timecols.at(as_of), layout.day)
    newest = until.groupBy(F.col(layout.type).alias("_type")).agg(F.max(layout.ts).alias("_last"))
    capitalised = F.concat(F.upper(F.substring("table_name", 1, 1)), F.expr("substring(table_name, 2)"))
    wanted = capitalised if prefix is None else prefix
    # a type belongs to a table when one of the type's own prefixes is the wanted text
    prefixes = F.transform(F.sequence(F.lit(1), F.length("_type")), lambda n: F.substring(F.col("_type"), F.lit(1), n))
    starts = (
        newest.filter(F.length("_type") > 0)
        .select(F.explode(prefixes).alias("_start"), "_last")
        .groupBy("_start")
        .agg(F.max("_last").alias("_last"))
    )
    joined = slas.withColumn("_wanted", wanted).join(starts, F.col("_wanted") == F.col("_start"), "left")
    return _judge(joined, F.col("_last"), as_of).drop("_wanted", "_start", "_last")


def freshness(tables: dict[str, tuple[DataFrame, str]], slas: DataFrame, as_of: str) -> DataFrame:
    """Age of each table at ``as_of`` by its own time column: ``{table: (frame, time_column)}``."""
    newest = None
    for name, (frame, column) in tables.items():
        until = frame.filter(F.col(column) <= timecols.at(as_of))
        part = until.agg(F.max(column).cast("timestamp_ntz").alias("_last")).select(F.lit(name).alias("_table"), "_last")
        newest = part if newest is None else newest.unionByName(part)
    joined = slas.join(newest, F.col("table_name") == F.col("_table"), "left")
    return _judge(joined, F.col("_last"), as_of).drop("_table", "_last")


def _judge(joined: DataFrame, last: Column, as_of: str) -> DataFrame:
    has_sla = F.col("max_delay_minutes").isNotNull() | F.col("max_delay_hours").isNotNull()
    allowed = F.coalesce("max_delay_minutes", F.coalesce("max_delay_hours", F.lit(24)) * 60)
    age = timecols.half_up(timecols.minutes_between(timecols.at(as_of), last))
    return (
        joined.withColumn("max_minutes", F.when(has_sla, allowed).cast("bigint"))
        .withColumn("age_minutes", F.when(has_sla, age))
        .withColumn("fresh", ~has_sla | F.coalesce(age <= allowed, F.lit(False)))
    )
