"""Repeated units of text: lines or sentences, told apart by 128-bit digests.

A unit is known by its document and its number in it. A document is known by
its id and a hash of its text, so that rows with equal ids and different texts
do not mix; rows equal in both count as one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.common import whole
from tallyward.llm.shingles import mix

#: Splits a text into normalised units, empty where a unit does not count.
Splitter = Callable[[str], list[bytes]]

SEEN = "h1 bigint, h2 bigint, doc_id bigint, tag bigint, unit int, known boolean"


def tagged(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, text`` of each document; null texts are empty."""
    return docs.select("doc_id", F.xxhash64(whole()).alias("tag"), whole().alias("text"))


def digests(units: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each unit."""
    joined = b"".join(xxhash.xxh3_128_digest(u) for u in units)
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def turns(*columns: np.ndarray) -> np.ndarray:
    """How many rows before it are equal in all columns."""
    order = np.lexsort((np.arange(len(columns[0])), *columns))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    starts = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))
    return out


def scattered(h: np.ndarray) -> np.ndarray:
    """Keys for rows that need not meet any other."""
    return mix(h.view(np.uint64) + np.arange(len(h), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def once(rows: Iterable[tuple]) -> list[tuple]:
    """Rows that start with id and text hash in order of these, one for each document.

    What is told inside a batch must not take a repeated row for a later copy of
    itself: removals go by id and hash, so both rows would lose the text.
    """
    out: list[tuple] = []
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if not out or row[:2] != out[-1][:2]:
            out.append(row)
    return out


def in_order(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, str]]:
    """Documents of a batch by id, text hash; rows equal in both come once."""
    return iter(once(zip(*[batch.column(n).to_pylist() for n in ("doc_id", "tag", "text")], strict=True)))


def _seen(split: Splitter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags, numbers, units = [], [], [], []
            for doc, tag, text in in_order(batch):
                for i, unit in enumerate(split(text)):
                    if unit:
                        docs.append(doc), tags.append(tag), numbers.append(i), units.append(unit)
            if not units:
                continue
            h = digests(units)
            # the first of equal units in this batch may be the first of all, the others cannot
            known = turns(h[:, 0], h[:, 1]) > 0
            h1 = np.where(known, scattered(h[:, 1]), h[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h[:, 1]), pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array(numbers, pa.int32()), pa.array(known)],
                names=[c.split()[0] for c in SEEN.split(", ")],
            )

    return run


def later_copies(docs: DataFrame, split: Splitter) -> DataFrame:
    """``doc_id, tag, unit`` of every unit equal to one earlier in order of id and number.

    Copies inside one batch of rows are told at once and only travel past the
    shuffle, each on its own. What meets at a digest is one row for each batch
    at most, so a unit that a third of all documents hold makes no large group.
    """
    rows = tagged(docs).mapInArrow(_seen(split), SEEN)
    rank = F.struct(F.col("doc_id"), F.col("tag"), F.col("unit"))
    first = F.min(F.when(~F.col("known"), rank)).over(Window.partitionBy("h1", "h2"))
    return rows.withColumn("_first", first).filter(F.col("known") | (rank != F.col("_first"))).select("doc_id", "tag", "unit")
