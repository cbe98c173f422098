"""Saved questions: ratios over metric requests, segments, cohort suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.plans.metrics import Tables, metric_query
from tallyward.plans.model import Request, Scope, Semantics


def ratio_query(
    tables: Tables,
    semantics: Semantics,
    request: Request,
    part: str,
    whole: str,
    name: str,
    scope: Scope | None = None,
    digits: int = 4,
) -> DataFrame:
    """A metric request plus ``name`` = part / whole; null when the whole is zero."""
    result = metric_query(tables, semantics, request, scope)
    share = F.col(part).cast("double") / F.nullif(F.col(whole).cast("double"), F.lit(0.0))
    return result.withColumn(name, F.round(share, digits))


def in_levels(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Segment of rows whose level is one of ``levels``."""
    return df.filter(F.col(column).isin(*levels))


def with_count(
    df: DataFrame, key: str, facts: DataFrame, fact_key: str, at_least: int, at_most: int | None = None
) -> DataFrame:
    """Segment of ``df`` whose key has between ``at_least`` and ``at_most`` rows in ``facts``."""
    counted = facts.groupBy(F.col(fact_key).alias("_k")).count().filter(F.col("count") >= at_least)
    if at_most is not None:
        counted = counted.filter(F.col("count") <= at_most)
    return df.join(counted, df[key] == counted["_k"], "left_semi")


def suppress_small(df: DataFrame, k: int, count_column: str) -> DataFrame:
    """Drop groups that stand for fewer than ``k`` members."""
    return df.filter(F.col(count_column) >= k)
