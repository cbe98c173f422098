"""Line dedup by a deletion neighbourhood over words.

Lines are compared as sequences of lower-case words. A line goes if an earlier
line of the corpus is equal to it, or within one word of it: one word changed,
put in or left out. Earlier means smaller document id, then text hash, then
line number, and lines are judged on the input, so the earliest of each chain
stays. Lines of fewer than ``LEAST_WORDS`` words have to be equal: one word is
too much of them.

Within one edit, two lines have an equal variant with at most one word left
out. All variants are keys: the position left out with what remains (two lines
that differ in that word meet there), what remains alone (a line meets one that
has a word more), and the whole line. The edit distance is verified in the
key: equal remains with different positions may be two edits apart, so the
position is part of the first kind of key, and in the second kind, the keys of
longer lines meet whole lines only. So all lines at a key that are compared
are within one edit of each other, the least rank there settles all of them,
and no pairs are made. In each batch of documents all but the first of the lines
at a key are settled at once, so a key that a third of all documents share
gathers one row per batch.

Only lines that can have a partner emit variants. An edit lies in one half of
a line, so partners share the other half: a line whose halves no other line
shares has none. Each line gives four such half keys, for its own length and
for one word less, and only half keys with two different lines on them count.
A line then leaves out the words of its unshared half alone.

Defined cases: a null text counts as empty; lines without words are never
copies and stay; a line of any length is compared whole; rows equal in id and
text are one document and get equal results; an empty table gives an empty
result; other columns are carried, and columns with the names added here are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.llm.common import sliced, stored, whole
from tallyward.llm.units import in_order, later_copies, once, scattered, tagged, turns

LEAST_WORDS = 8
ADDED = ["n_lines", "n_exact", "n_near"]


def lines(text: str) -> list[bytes]:
    """The words of every line, in lower case and a blank apart."""
    return [b" ".join(line.split()) for line in text.encode().lower().split(b"\n")]


_HALF = "k1 bigint, k2 bigint, h bigint, side int, doc_id bigint, tag bigint, unit int, known boolean"


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Half keys of the first occurrence of each line in the batch; ``side`` tells which half is shared.

    Of the lines on one key in a batch, two go to meet others; the rest are known to have partners.
    """
    for batch in batches:
        seen, keys, owners, hashes = set(), [], [], []
        for doc, tag, text in in_order(batch):
            for i, unit in enumerate(lines(text)):
                n = unit.count(b" ") + 1
                if n < LEAST_WORDS or unit in seen:
                    continue
                seen.add(unit)
                ends = [len(w) for w in unit.split(b" ")]
                for k in range(1, n):
                    ends[k] += ends[k - 1] + 1
                for m in (n, n - 1):
                    half = m // 2
                    keys.append(xxhash.xxh3_128_digest(unit[: ends[half - 1]], seed=2 * m))
                    keys.append(xxhash.xxh3_128_digest(unit[ends[n - (m - half) - 1] + 1 :], seed=2 * m + 1))
                owners.append((doc, tag, i))
                hashes.append(xxhash.xxh3_64_intdigest(unit))
        if not owners:
            continue
        k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        known = turns(k[:, 0], k[:, 1]) > 1
        four = np.repeat(np.arange(len(owners)), 4)
        docs, tags, units = (pa.array(c, t).take(pa.array(four)) for c, t in zip(zip(*owners, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True))
        h = np.array(hashes, np.uint64).view(np.int64)[four]
        sides = np.tile(np.array([0, 1], np.int32), 2 * len(owners))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(known, scattered(k[:, 1]), k[:, 0])), pa.array(k[:, 1]), pa.array(h), pa.array(sides), docs, tags, units, pa.array(known)],
            names=[c.split()[0] for c in _HALF.split(", ")],
        )


_VARIANT = "k1 bigint, k2 bigint, kind int, doc_id bigint, tag bigint, unit int, known boolean"
WHOLE, SHORTER, CHANGED = 0, 1, 2


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All keys of the candidate lines of each document; ``_c`` holds twice the line number plus the shared side.

    Of the lines of one batch that differ in the same word, the first goes to
    meet others; the rest are known to be near an earlier one.
    """
    for batch in sliced(batches, 1000):
        keys, kinds, owners = [], [], []
        rows = zip(*[batch.column(n).to_pylist() for n in ("doc_id", "tag", "text", "_c")], strict=True)
        for doc, tag, text, wanted in once(rows):
            all_lines = lines(text)
            shared: dict[int, set[int]] = {}
            for c in wanted:
                shared.setdefault(c >> 1, set()).add(c & 1)
            for i in sorted(shared):
                words = all_lines[i].split(b" ")
                n = len(words)
                places: set[int] = set()
                # of the halves for either length, the shorter one is shared at least
                if 0 in shared[i]:
                    places.update(range((n - 1) // 2, n))
                if 1 in shared[i]:
                    places.update(range(n - (n - 1 - (n - 1) // 2)))
                before = len(keys)
                keys.append(xxhash.xxh3_128_digest(all_lines[i], seed=0))
                kinds.append(WHOLE)
                for p in places:
                    rest = b" ".join(words[:p] + words[p + 1 :])
                    keys.append(xxhash.xxh3_128_digest(rest, seed=p + 1))
                    kinds.append(CHANGED)
                    if p - 1 not in places or words[p] != words[p - 1]:
                        keys.append(xxhash.xxh3_128_digest(rest, seed=0))
                        kinds.append(SHORTER)
                owners += [(doc, tag, i)] * (len(keys) - before)
        if not keys:
            continue
        k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        kind = np.array(kinds, np.int32)
        known = (turns(k[:, 0], k[:, 1], kind) > 0) & (kind == CHANGED)
        docs, tags, units = zip(*owners, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(known, scattered(k[:, 1]), k[:, 0])), pa.array(k[:, 1]), pa.array(kind), pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array(units, pa.int32()), pa.array(known)],
            names=[c.split()[0] for c in _VARIANT.split(", ")],
        )


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, unit`` of lines within one word of an earlier line; for each line, the first occurrence is among them.

    Each of the two key tables is shuffled once; what meets there has been cut down in the batches.
    """
    texts = tagged(docs)
    meeting = Window.partitionBy("k1", "k2")
    halves = texts.mapInArrow(_halves, _HALF).withColumn("_two", F.min("h").over(meeting) != F.max("h").over(meeting))
    candidates = stored(
        halves.filter("known or _two")
        .groupBy(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"))
        .agg(F.collect_set(F.col("unit") * 2 + F.col("side")).alias("_c")),
        "line-candidates",
    )
    chosen = texts.join(candidates.hint("merge"), texts.doc_id.eqNullSafe(candidates._doc) & (texts.tag == candidates._tag))
    variants = chosen.select("doc_id", "tag", "text", "_c").mapInArrow(_variants, _VARIANT)
    rank = F.struct(F.col("doc_id"), F.col("tag"), F.col("unit"))
    least = {k: F.min(F.when(F.col("kind") == k, rank)).over(meeting) for k in (WHOLE, SHORTER, CHANGED)}
    other = (
        F.when(F.col("kind") == WHOLE, least[SHORTER]).when(F.col("kind") == SHORTER, least[WHOLE]).otherwise(least[CHANGED])
    )
    near = variants.withColumn("_other", other).filter(F.col("known") | (F.col("_other") < rank))
    return stored(near.select("doc_id", "tag", "unit").distinct(), "near-lines")


def _kept(schema: T.StructType):
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            columns = [batch.column(n).to_pylist() for n in ("text", "_exact", "_near")]
            for text, exact, near in zip(*columns, strict=True):
                exact, near = set(exact or ()), set(near or ())
                counts.append(((text or "").count("\n") + 1 if text else 0, len(exact), len(near - exact)))
                if exact or near:
                    text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in exact and i not in near)
                texts.append(text)
            columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(texts, pa.string())}
            columns |= {n: pa.array([c[i] for c in counts], pa.int64()) for i, n in enumerate(ADDED)}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def without_copies(docs: DataFrame) -> DataFrame:
    """All rows with ``text`` as it remains and ``n_lines, n_exact, n_near``: lines, and lines taken out."""
    docs = docs.drop(*ADDED)
    exact = stored(later_copies(docs, lines), "equal-lines").withColumn("near", F.lit(False))
    gone = exact.unionByName(near_copies(docs).withColumn("near", F.lit(True)))
    lists = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag")).agg(
        F.collect_list(F.when(~F.col("near"), F.col("unit"))).alias("_exact"),
        F.collect_list(F.when(F.col("near"), F.col("unit"))).alias("_near"),
    )
    marked = docs.withColumn("_own", F.xxhash64(whole()))
    joined = marked.join(lists.hint("merge"), marked.doc_id.eqNullSafe(lists._doc) & (marked._own == lists._tag), "left")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in ADDED]])
    return joined.select(*docs.columns, "_exact", "_near").mapInArrow(_kept(schema), schema)
