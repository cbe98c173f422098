"""From raw documents to packed training batches, one table written per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.

Odd rows: an empty table gives an empty table in every stage; a null text counts
as empty and null ids, languages and sources as values of their own; texts of
any length are worked on whole; rows equal in id and text are one document to
the stages that compare, and each is kept or dropped alike. All but the last
stage return the columns they were given. Columns beside doc_id, text, lang,
source and n_chars are carried along, but should not be named like the columns
that the operators of a stage add (``n_exact, n_near, copy, copies, place``):
those take the operator's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import jaccard, lines, mixing, packing
from tallyward.llm.common import stored
from tallyward.llm.quality import quality_filter
from tallyward.sources.tables import load


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their group's fences go; so do null and empty texts."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal to or within one word of an earlier line go, and documents of which nothing is left; texts empty from the start stay."""
    rows = lines.without_copies(docs)
    lost = (F.col("n_exact") + F.col("n_near") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = rows.filter(~F.coalesce(lost, F.lit(False)))
    changed = F.when(F.col("n_exact") + F.col("n_near") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared shingles, the first stays; a text without words is linked with nothing and stays."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources weigh the square root of their sizes; in shuffled order."""
    return mixing.mixed(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bucket, batch and place in it; an empty text is a piece of one end mark."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mix_sources", mix_sources),
    ("packing", pack),
]
#: The choice of buckets is no matter for SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
