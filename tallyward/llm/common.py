"""Shared pieces of the text operators: written tables, word splitting, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.session import scratch

#: White space that ends a word, the same for every operator.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's own switch to drop a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that lost executors cost no rework.

    Its shuffle files go when it is written: nothing reads them again, and the
    next step may need the disk.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a task's arrays stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def whole(text: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    """All words of a text in order."""
    return F.array_remove(F.split(text, SPACE), "")


def marks(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(0x5EED), text)]


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns of two tables."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition
