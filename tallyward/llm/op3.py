"""Query of the secret scan; its base spans are tested against plain patterns, the others on planted keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.llm import secrets
from tallyward.sources.tables import load

NAME = "op3_secret_scans"
KINDS = ["assign", "access", "hex", "random"]


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ","
    )


def _of_kind(kind):
    return lambda x: x["kind"] == kind


def query(spark, folder):
    rows = secrets.secret_spans(load(spark, folder, "documents"), ["doc_id"])
    base = F.filter("found", lambda x: x["kind"] < 3)
    counts = [F.size(F.filter("found", _of_kind(i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")
    )
