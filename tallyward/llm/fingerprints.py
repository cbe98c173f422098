"""Document fingerprints: the ``K`` smallest hashes of a text's five-word shingles.

Fingerprints of parts merge into that of the whole, and two of them estimate
resemblance, containment and the number of distinct shingles. Below ``K``
shingles all three are exact.

``fingerprinted`` also measures how well a fingerprint holds up: each text is
changed at its end with the start of the next document's text, and compared
with itself and with its neighbour. Neighbours are found by dealing the
documents into ranges of ids, each a task that reads its documents in order.
The first document of a range is sent to the range before it as well, and the
first of all to the last range, so no task needs another's result. The ranges'
first ids are found by one small aggregate, about one per thousand documents
at first and never more than ``RANGES``.

Defined cases: a null text counts as empty; an empty text has an empty
fingerprint, which is like another empty one (1.0) and unlike all else (0.0);
texts with fewer than five words are one shingle; rows with equal ids follow
each other by their texts; null ids come first; a single document is its own
neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import whole
from tallyward.llm.shingles import shingle_sets

K = 128
RANGES = 4096
DOCS_PER_RANGE = 1000


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest of sorted distinct hashes."""
    return hashes[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The fingerprint of the union of what two fingerprints stand for."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated size of the intersection over that of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1])) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first text's shingles that the second holds."""
    if not len(a):
        return 1.0
    union = distinct_count(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_count(a, k))


def encode(a: np.ndarray) -> str:
    """Sixteen hex digits for each hash."""
    return a.astype(">u8").tobytes().hex()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str | None]]:
    """(id, text, next text) for every row that is no guest; rows come by range and order."""
    held = None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("_range", "_guest", "doc_id", "text")]
        for part, guest, doc, text in zip(*columns, strict=True):
            if held is not None:
                yield held[1], held[2], text if held[0] == part else None
            held = None if guest else (part, doc, text)
    if held is not None:
        yield held[1], held[2], None


_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Works through the rows a few hundred at a time."""

    def out(rows: list) -> pa.RecordBatch:
        texts, edited = [r[1] for r in rows], []
        for _, text, after in rows:
            n = len(text) // 4
            edited.append(text[: len(text) - n] + (after or "")[:n])
        # the next text is the following row's, but for the last row of a range
        all_texts = [t.encode() for t in texts + edited]
        extra = {i: len(all_texts) for i in range(len(rows)) if i + 1 == len(rows) or rows[i + 1][1] is not rows[i][2]}
        for j, i in enumerate(extra):
            extra[i] = len(all_texts)
            all_texts.append((rows[i][2] or "").encode())
        prints = [sketch(s) for s in shingle_sets(all_texts)]
        n = len(rows)
        after = [prints[extra.get(i, i + 1)] for i in range(n)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in all_texts[n : 2 * n]]),
                pa.array([encode(p) for p in prints[:n]]),
                pa.array([encode(p) for p in prints[n : 2 * n]]),
                pa.array([resemblance(prints[i], prints[n + i]) for i in range(n)], pa.float64()),
                pa.array([resemblance(prints[i], after[i]) for i in range(n)], pa.float64()),
            ],
            names=[c.split()[0] for c in _SCHEMA.split(", ")],
        )

    rows, size = [], 0
    for row in _neighbours(batches):
        rows.append(row)
        size += len(row[1])
        if size > 1 << 20:
            yield out(rows)
            rows, size = [], 0
    if rows:
        yield out(rows)


def first_ids(docs: DataFrame) -> list[int | None]:
    """Ids at which ranges begin, ids that exist; the least id of all comes first, null where there is one."""
    rows = docs.count()
    n = max(1, min(RANGES, rows // DOCS_PER_RANGE))
    steps = [i / n for i in range(1, n)] or [0.5]
    row = docs.agg(
        F.min("doc_id").alias("least"),
        F.max(F.col("doc_id").isNull()).alias("nulls"),
        F.percentile_approx("doc_id", steps, 10 * n).alias("ids"),
    ).first()
    found = sorted({row["least"], *(row["ids"] if n > 1 else [])} - {None}) if row["least"] is not None else []
    return [None, *found] if row["nulls"] else found


def fingerprinted(docs: DataFrame) -> DataFrame:
    """One row per document; see the module for ``near_edited`` and ``near_next``."""
    docs = docs.select("doc_id", whole().alias("text"))
    starts = first_ids(docs)
    ids = F.array(*[F.lit(x) for x in starts if x is not None]).cast("array<bigint>")
    nulls = int(bool(starts) and starts[0] is None)
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(ids, lambda x: x <= F.col("doc_id"))) - 1 + nulls)
    last = len(starts) - 1
    begins = F.col("doc_id").isNull() | F.array_contains(ids, F.col("doc_id"))
    before = F.when(F.col("_own") == 0, last).otherwise(F.col("_own") - 1)
    here = F.struct(F.col("_own").alias("range"), F.lit(False).alias("guest"))
    there = F.struct(before.alias("range"), F.lit(True).alias("guest"))
    placed = docs.withColumn("_own", own).select(
        "doc_id", "text", F.explode(F.when(begins, F.array(here, there)).otherwise(F.array(here))).alias("_at")
    )
    ranged = placed.select(F.col("_at.range").alias("_range"), F.col("_at.guest").alias("_guest"), "doc_id", "text")
    return (
        ranged.repartition("_range")
        .sortWithinPartitions("_range", "_guest", F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(_compare, _SCHEMA)
    )
