"""Query of the main text of pages; tested against pages whose text is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.llm import articles
from tallyward.sources.tables import load

NAME = "op13_main_text"


def query(spark, folder):
    pages = load(spark, folder, "pages").select("page_id", "url", "html")
    return articles.extracted(pages).withColumn("n_chars", F.length("text").cast("bigint"))
