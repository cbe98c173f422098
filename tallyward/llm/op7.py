"""Query of the packing; the choice of buckets is tested against trying all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.llm import packing
from tallyward.sources.tables import load

NAME = "op7_packing"


def query(spark, folder):
    rows = packing.packed(load(spark, folder, "documents"))
    return rows.select("doc_id", *packing.ADDED, F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
