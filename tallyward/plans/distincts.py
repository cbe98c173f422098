"""Exact distinct counts that roll up: bitmaps per day, merged to any longer period without the facts.

A key that is a whole number has a bit in the bitmap of its bucket of 32,768
numbers. Bitmaps of a period are the union of those of its days, and the count
of a period is the number of its bits, summed over buckets. One pass over the
facts makes the day table; a week, month, quarter or year is read from it.
Null keys do not count; a period in which no row has a key has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions import timecols

GRAINS = ("day", "week", "month", "quarter", "year")


def day_bitmaps(facts: DataFrame, key: str, ts: str, dimensions: list[str] = ()) -> DataFrame:
    """``dimensions, day, bucket, bits``: the keys seen on each day, to be written and added to day by day."""
    held = facts.filter(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("bigint"))
    bucket = F.bitmap_bucket_number("_key")
    return held.groupBy(*dimensions, F.to_date(ts).alias("day"), bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_key")).alias("bits")
    )


def merged(days: DataFrame, grain: str, dimensions: list[str] = ()) -> DataFrame:
    """``dimensions, period, bucket, bits``: bitmaps of a day table united by period; the first day names it."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {', '.join(GRAINS)}, not {grain!r}")
    period = timecols.truncate(grain, F.col("day")).cast("date")
    return days.groupBy(*dimensions, period.alias("period"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(days: DataFrame, grain: str, dimensions: list[str] = (), name: str = "distinct") -> DataFrame:
    """``dimensions, period`` and the number of distinct keys as ``name``."""
    per_period = merged(days, grain, dimensions).groupBy(*dimensions, "period")
    return per_period.agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias(name))
