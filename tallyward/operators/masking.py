"""Masking of personal data in results and free text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward import fixed
from tallyward.functions.textcols import redact_words


def bare_names(pii_columns: Iterable[str]) -> list[str]:
    """Column names without their table, lower-cased."""
    return sorted({c.split(".")[-1].lower() for c in pii_columns})


def mask_pii(df: DataFrame, pii_columns: Iterable[str]) -> DataFrame:
    """Replace every column with a blocked name by a constant, nulls included."""
    blocked = set(bare_names(pii_columns))
    if not blocked.intersection(c.lower() for c in df.columns):
        return df
    return df.select(
        *[F.lit(fixed.MASK_VALUE).alias(c) if c.lower() in blocked else df[c] for c in df.columns]
    )


def redact(df: DataFrame, column: str, pii_columns: Iterable[str]) -> DataFrame:
    """Replace PII column names inside a text column, as whole words."""
    return df.withColumn(column, redact_words(F.col(column), bare_names(pii_columns)))


def pii_columns(catalog: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """``table_name, column_name`` that are personal by tag or by policy.

    ``catalog`` has ``table_name, column_name, tags``; a column is personal
    if any of its tags contains one of the tag words.
    """
    tagged = catalog.filter(
        F.exists("tags", lambda t: F.contains(t, F.lit(fixed.PII_TAG_WORDS[0])) | F.contains(t, F.lit(fixed.PII_TAG_WORDS[1])))
    ).select("table_name", "column_name")
    if policy is not None:
        tagged = tagged.unionByName(policy.select("table_name", "column_name"))
    return tagged.distinct()
