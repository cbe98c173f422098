"""Ordered work inside groups when one group may be very large.

A window partitioned by a key puts each key into one task, sorted and spilled
to disk as needed. The caller who knows of groups too large for that asks for
``split``: the rows are range-partitioned by key and order, which cuts a large
group into many chunks; each chunk is worked on by itself and the few values
that cross a cut are carried over. Both plans give the same rows. Keys that are
cut number less than the chunks, so the carried table is bounded by the
number of partitions and may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.session import cut

CHUNK = "_chunk"


def in_chunks(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows cut into evenly sized ordered chunks, numbered in ``_chunk``.

    The chunk of a row must not change when a task is repeated, so the
    numbered rows are written out before anything is derived from them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(max(parts, 2), key, *order)
    return cut(ranged.withColumn(CHUNK, F.spark_partition_id()))


def number_rows(
    df: DataFrame,
    key: str,
    order: list[str],
    previous: str,
    split: bool = False,
) -> DataFrame:
    """Add ``seq`` (1, 2, ... inside each key) and ``prev`` (``previous`` one row before).

    ``order`` must give each row of a key its own place and start with
    ``previous``.
    """
    if not split:
        w = Window.partitionBy(key).orderBy(*order)
        return df.withColumn("seq", F.row_number().over(w).cast("bigint")).withColumn(
            "prev", F.lag(previous).over(w)
        )

    chunks = in_chunks(df, key, order)
    local = Window.partitionBy(CHUNK, key).orderBy(*order)
    numbered = chunks.withColumn("_seq", F.row_number().over(local).cast("bigint")).withColumn(
        "_prev", F.lag(previous).over(local)
    )
    per_chunk = chunks.groupBy(key, CHUNK).agg(
        F.count("*").alias("_rows"), F.max(previous).alias("_last")
    )
    earlier = Window.partitionBy(key).orderBy(CHUNK)
    carried = per_chunk.select(
        key,
        CHUNK,
        F.sum("_rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.lag("_last").over(earlier).alias("_carried"),
    ).filter(F.col("_before").isNotNull())
    return (
        numbered.join(F.broadcast(carried), [key, CHUNK], "left")
        .withColumn("seq", F.col("_seq") + F.coalesce("_before", F.lit(0)))
        .withColumn("prev", F.coalesce("_prev", "_carried"))
        .select(*df.columns, "seq", "prev")
    )


def next_after(
    df: DataFrame,
    key: str,
    order: str,
    values: dict[str, Column],
    split: bool = False,
) -> DataFrame:
    """For each row and each name in ``values``: the nearest non-null value on a later row.

    ``order`` must be distinct inside each key. The frame runs over the
    reversed order because Spark evaluates a frame that grows from the start
    in one pass, but one that shrinks towards the end row by row.
    """
    with_values = df.select("*", *[c.alias(f"_v_{n}") for n, c in values.items()])
    if not split:
        later = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
        nearest = [F.last(f"_v_{n}", ignorenulls=True).over(later).alias(n) for n in values]
        return with_values.select(*df.columns, *nearest)

    chunks = in_chunks(with_values, key, [order])
    later = Window.partitionBy(CHUNK, key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = chunks.select(
        *df.columns, CHUNK, *[F.last(f"_v_{n}", ignorenulls=True).over(later).alias(f"_l_{n}") for n in values]
    )
    firsts = chunks.groupBy(key, CHUNK).agg(
        *[F.min_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_f_{n}") for n in values]
    )
    after = Window.partitionBy(key).orderBy(F.col(CHUNK).desc())
    carried = (
        firsts.select(
            key,
            CHUNK,
            F.row_number().over(after).alias("_back"),
            *[
                F.last(f"_f_{n}", ignorenulls=True)
                .over(after.rowsBetween(Window.unboundedPreceding, -1))
                .alias(f"_c_{n}")
                for n in values
            ],
        )
        .filter(F.col("_back") > 1)
        .drop("_back")
    )
    joined = local.join(F.broadcast(carried), [key, CHUNK], "left")
    return joined.select(*df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values])
