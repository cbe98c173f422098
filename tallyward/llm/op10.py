"""Query of the Jaccard join; tested against all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.llm import jaccard
from tallyward.sources.tables import load

NAME = "op10_jaccard_join"


def query(spark, folder):
    rows = jaccard.similar(load(spark, folder, "documents"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")
