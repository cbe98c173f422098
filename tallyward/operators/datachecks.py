"""Checks over table data: keys, allowed values, declared business rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions import timecols
from tallyward.operators.rules import Rule
from tallyward.plans.metrics import compare


def data_check(spark: SparkSession, rule: Rule) -> DataFrame:
    """Run a rule's query and compare its column with the expected value.

    One row ``rule, checked_rows, observed, passed``; a query without rows fails.
    """
    column, op, value = rule.check.expect
    result = spark.sql(rule.check.sql)
    return result.agg(
        F.lit(rule.name).alias("rule"),
        F.count("*").alias("checked_rows"),
        F.max(F.col(column).cast("double")).alias("observed"),
        F.coalesce(F.bool_and(F.coalesce(compare(F.col(column), op, value), F.lit(False))), F.lit(False)).alias("passed"),
    )


def repeated_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return df.groupBy(*columns).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def missing_parents(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Foreign-key values without a parent row, with their row count.

    Child rows are reduced to one row per value before the join, so a value
    that fills a third of the table costs no more than any other.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_column).alias("_known")).distinct()
    return values.join(known, F.col(column) == F.col("_known"), "left_anti")


def check_keys(
    df: DataFrame, primary: list[str], foreign: dict[str, tuple[DataFrame, str]] | None = None
) -> DataFrame:
    """``constraint, kind, bad_values, bad_rows``: one row per key."""
    repeated = repeated_keys(df, primary)
    nulls = df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in primary]))
    found = [
        repeated.agg(
            F.lit(",".join(primary)).alias("constraint"),
            F.lit("unique").alias("kind"),
            F.count("*").alias("bad_values"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("bad_rows"),
        ),
        nulls.agg(
            F.lit(",".join(primary)).alias("constraint"),
            F.lit("not_null").alias("kind"),
            F.lit(0).cast("bigint").alias("bad_values"),
            F.count("*").alias("bad_rows"),
        ),
    ]
    for column, (parent, parent_column) in (foreign or {}).items():
        found.append(
            missing_parents(df, column, parent, parent_column).agg(
                F.lit(column).alias("constraint"),
                F.lit("foreign").alias("kind"),
                F.count("*").alias("bad_values"),
                F.coalesce(F.sum("rows"), F.lit(0)).alias("bad_rows"),
            )
        )
    return reduce(DataFrame.unionByName, found)


def check_domain(df: DataFrame, allowed: dict[str, list], tests: dict[str, Column] | None = None) -> DataFrame:
    """``check_name, bad_rows``: values outside their list, and failed row tests, in one pass.

    As in SQL, a null value passes.
    """
    counts = {c: F.count_if(~F.col(c).isin(*values)) for c, values in allowed.items()}
    counts |= {name: F.count_if(~test) for name, test in (tests or {}).items()}
    row = df.agg(*[c.alias(n) for n, c in counts.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("bad_rows")) for n in counts])
    return row.select(F.inline(pairs))


def over_capacity(
    used: DataFrame, used_key: str, owners: DataFrame, owner_key: str, capacity: str, factor: float = 1.05
) -> DataFrame:
    """Owners whose use exceeds ``factor`` times their capacity."""
    counted = used.groupBy(F.col(used_key).alias("_key")).agg(F.count("*").alias("used"))
    joined = owners.join(counted, owners[owner_key] == counted["_key"])
    return joined.filter(F.col("used") > F.col(capacity) * factor).select(owner_key, capacity, "used")


def too_late(
    facts: DataFrame, key: str, time_column: str, owners: DataFrame, owner_key: str, deadline: str, minutes: int = 45
) -> DataFrame:
    """Facts that happened less than ``minutes`` before their owner's deadline."""
    joined = facts.join(owners, facts[key] == owners[owner_key])
    lead = timecols.minutes_between(F.col(deadline), F.col(time_column))
    return joined.withColumn("lead_minutes", lead).filter(F.col("lead_minutes") < minutes)


def unconfirmed(
    claims: DataFrame, claim_key: str, proofs: DataFrame, proof_key: str
) -> DataFrame:
    """Claims without any proof row; proofs are reduced to their keys before the shuffle."""
    proven = proofs.select(F.col(proof_key).alias("_proven")).distinct()
    return claims.join(proven, F.col(claim_key) == F.col("_proven"), "left_anti")


def split_totals(df: DataFrame, amount: str, parts: dict[str, Column]) -> DataFrame:
    """One row with the total of each part, reported apart; nothing is netted."""
    return df.agg(*[F.round(F.sum(F.when(test, F.col(amount))), 2).alias(n) for n, test in parts.items()])


def with_tier(df: DataFrame, measure: str, steps: list[tuple[float, str]], otherwise: str, name: str = "tier") -> DataFrame:
    """Tier of a value: the first step whose threshold it exceeds, largest first."""
    tier = F.lit(otherwise)
    for above, label in sorted(steps):
        tier = F.when(F.col(measure) > above, label).otherwise(tier)
    return df.withColumn(name, tier)
