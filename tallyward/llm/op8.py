"""Query of the exact substring removal; tested against a plain set of windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.llm import suffixes
from tallyward.sources.tables import load

NAME = "op8_suffix_array_dedup"


def query(spark, folder):
    rows = suffixes.without_repeats(load(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["stop"] - x["start"])
    return rows.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("bigint").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
