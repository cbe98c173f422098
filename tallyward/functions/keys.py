"""Derived keys for replay-safe writes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_list(values: Column) -> Column:
    """A list as comma-joined sorted text; an absent list is empty text."""
    return F.coalesce(F.array_join(F.array_sort(values), ","), F.lit(""))


def content_key(*parts: Column) -> Column:
    """sha256 over bar-joined parts; a missing part counts as empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def finding_key(session: Column, agent: Column, finding: Column, confidence: Column, sources: Column) -> Column:
    return content_key(session, agent, finding, confidence, sorted_list(sources))


def outcome_key(session: Column, question: Column, summary: Column, agents: Column) -> Column:
    return content_key(session, question, summary, sorted_list(agents))


def workflow_id(caller: Column, question: Column, version: Column) -> Column:
    return F.substring(content_key(caller, question, version), 1, 32)
