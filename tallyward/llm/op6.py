"""Query of the passage removal; tested against a plain loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.llm import passages
from tallyward.sources.tables import load

NAME = "op6_substring_dedup"
#: Words that a run of repeated units needs.
LEAST_WORDS = 13


def query(spark, folder):
    rows = passages.without_repeats(load(spark, folder, "documents").select("doc_id", "text"), LEAST_WORDS)
    length = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["stop"] - x["start"])
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["stop"])), ",")
    return rows.select(
        "doc_id",
        F.coalesce(length, F.lit(0)).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        spans.alias("spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
