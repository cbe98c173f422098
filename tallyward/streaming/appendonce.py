"""Append once, whatever the delay: a stored table of keys beside the rows.

A watermark forgets keys; here every key that was ever appended is kept, in a
table partitioned by a hash of the key. Each batch of a stream keeps its first
row per key, drops those whose key is stored, and writes rows and keys under its
own source and number. A batch that runs again, as Spark repeats the last one
after a failure, overwrites what it wrote before and looks only at keys of other
batches, so it adds nothing.

A batch is small beside the key table: its keys go to the scan of the stored
ones, which is read in the partitions that the batch touches and is not
shuffled while the batch is small enough to be broadcast by Spark's own limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partitions of the key table.
PARTS = 64


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _place(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("source", T.StringType()), T.StructField("batch", T.LongType())])


def stored_keys(spark: SparkSession, folder: str, key: T.StructField) -> DataFrame:
    """The key, ``source, batch, part`` of everything appended so far."""
    schema = _place(T.StructType([key]))
    return spark.read.schema(schema.add(T.StructField("part", T.IntegerType()))).parquet(f"{folder}/keys")


def append_batch(batch: DataFrame, number: int, folder: str, source: str, key: str, order: list[str]) -> None:
    """Append the rows of one batch whose key was never appended before."""
    spark, field = batch.sparkSession, batch.schema[key]
    whole = F.struct(*batch.columns)
    first = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select("_row.*")
    place = f"source={source}/batch={number}"
    if _begun(spark, f"{folder}/keys"):
        mine = (F.col("source") == source) & (F.col("batch") >= number)
        other = stored_keys(spark, folder, field).filter(~mine).select(key, "part")
        asked = batch.select(key, _part(key).alias("part")).distinct()
        known = other.join(asked, [key, "part"], "left_semi").select(key)
        first = first.join(known, key, "left_anti")
    first.select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/rows/{place}")
    written = spark.read.schema(batch.schema).parquet(f"{folder}/rows/{place}")
    keys = written.select(key, _part(key).alias("part"))
    keys.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/keys/{place}")


def _begun(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append_once_stream(stream: DataFrame, folder: str, source: str, key: str, order: list[str]):
    """Append everything available in a stream; ``source`` names the stream for good and ``folder`` holds the table."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: append_batch(batch, number, folder, source, key, order))
        .option("checkpointLocation", f"{folder}/checkpoints/{source}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def appended(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows appended so far, with the source and batch that brought each."""
    return spark.read.schema(_place(schema)).parquet(f"{folder}/rows")
