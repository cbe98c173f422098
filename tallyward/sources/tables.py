"""Reading, copying and deriving tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT_TYPES = (
    T.IntegerType,
    T.LongType,
    T.StringType,
    T.DoubleType,
    T.DateType,
    T.BooleanType,
    T.TimestampType,
    T.TimestampNTZType,
)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def loader(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    return lambda name: load(spark, folder, name)


def append(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("append").parquet(f"{folder}/{name}.parquet")


def carried_type(column: T.StructField) -> Column:
    """A column in a type every target keeps; all others become text, nested ones as JSON."""
    if isinstance(column.dataType, KEPT_TYPES):
        return F.col(column.name)
    if isinstance(column.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column.name).alias(column.name)
    return F.col(column.name).cast("string").alias(column.name)


def copy_tables(spark: SparkSession, source: str, target: str, names: Iterable[str]) -> DataFrame:
    """Replace each table under ``target`` by a copy; ``table_name, rows, columns``.

    Rows are counted while they are written.
    """
    report = []
    for name in names:
        frame = load(spark, source, name)
        counted = Observation(f"copy_{name}")
        copy = frame.select(*[carried_type(f) for f in frame.schema.fields])
        copy.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(
            f"{target}/{name}.parquet"
        )
        report.append((name, counted.get["rows"], len(frame.columns)))
    return spark.createDataFrame(report, "table_name string, rows bigint, columns bigint")


def customer_mart(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Order statistics and lifetime value per customer, also for those without orders."""
    per_customer = orders.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order"),
        F.max("order_date").alias("most_recent_order"),
        F.count("*").alias("number_of_orders"),
        F.round(F.sum("amount"), 2).alias("customer_lifetime_value"),
    )
    return customers.join(per_customer, "customer_id", "left")


def order_mart(orders: DataFrame, payments: DataFrame, methods: list[str]) -> DataFrame:
    """Orders with one amount column per payment method and the total."""
    amounts = payments.groupBy("order_id").agg(
        *[
            F.round(F.coalesce(F.sum(F.when(F.col("payment_method") == m, F.col("amount"))), F.lit(0.0)), 2).alias(
                f"{m.lower()}_amount"
            )
            for m in methods
        ],
        F.round(F.sum("amount"), 2).alias("amount"),
    )
    return orders.join(amounts, "order_id", "left")


def stage_payments(raw: DataFrame, cents: str) -> DataFrame:
    """Amounts from whole cents to currency units."""
    return raw.withColumn("amount", F.col(cents) / F.lit(100.0)).drop(cents)
