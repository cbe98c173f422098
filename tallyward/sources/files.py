"""Inventory of files under a folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.corpus import path_test

_SCHEME = r"^[a-z0-9]+:/*"


def find_files(spark: SparkSession, root: str, glob: str = "*", ignore: list[str] = ()) -> DataFrame:
    """``path, dir, size`` of files that fit ``glob`` at any depth; contents are not read."""
    if glob.startswith("/") or ".." in glob:
        raise ValueError("the pattern must stay inside the folder")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # scheme and slashes go the same way on both sides, whatever the store
    base = re.sub(_SCHEME, "/", root).rstrip("/")
    inside = F.regexp_replace("path", _SCHEME, "/")
    relative = F.expr(f"substring(_full, {len(base) + 1})")
    found = files.select(inside.alias("_full"), F.col("length").alias("size")).select(relative.alias("path"), "size")
    return listed_files(found, glob, ignore)


def listed_files(listing: DataFrame, glob: str = "*", ignore: list[str] = ()) -> DataFrame:
    """``path, dir, size`` of the entries of a listing (``path, size``) that fit ``glob`` at any depth.

    For corpora that keep their texts in a table with a path column.
    """
    deep = glob if glob.startswith("**/") else f"**/{glob}"
    folder = F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("/"))
    return listing.filter(path_test(F.col("path"), deep, ignore)).select("path", folder.alias("dir"), "size")


def dir_summary(files: DataFrame) -> DataFrame:
    """``dir, files, folders, items, bytes`` of every folder, counting direct children."""
    direct = files.groupBy("dir").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    depths = F.sequence(F.lit(0), F.size("_parts") - 1)
    above = (
        direct.select(parts.alias("_parts"))
        .filter(F.size("_parts") > 0)
        .select(F.explode(depths).alias("_n"), "_parts")
        .select(
            F.concat(F.lit("/"), F.array_join(F.slice("_parts", F.lit(1), F.col("_n")), "/")).alias("dir"),
            F.element_at("_parts", F.col("_n") + 1).alias("_child"),
        )
        .distinct()
        .groupBy("dir")
        .agg(F.count("*").alias("folders"))
    )
    joined = direct.join(above, "dir", "full")
    filled = joined.na.fill(0, ["files", "folders", "bytes"])
    return filled.withColumn("items", F.col("files") + F.col("folders"))
