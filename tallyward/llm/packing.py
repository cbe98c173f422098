"""Packing by optimal length buckets.

Documents are measured in words plus one end mark; what exceeds ``max_tokens``
goes on in a further piece. The global histogram of piece lengths has
``max_tokens`` entries at most, so it is the only thing that the driver sees.
Dynamic programming over it chooses the bucket lengths with the least padding,
and inside a bucket, pieces fill batches whose padded size stays within
``budget`` tokens.

Pieces are numbered inside a bucket without a task that holds the bucket: a
hash deals them into cells of some ten thousand pieces, cells are numbered each
by themselves, and the cell counts, summed up in order, shift the numbers. So
only the last batch of a bucket is not full, however large the bucket is.

Defined cases: a null or empty text is a piece of one token, the end mark; a
text of any length is cut into as many pieces as it needs, and the pieces put
together are the text; repeated rows are packed each by themselves; an empty
table gives an empty result; other columns are carried, and columns with the
names added here are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.llm.common import stored, whole, words_of

MAX_TOKENS = 2048
BUCKETS = 16
BUDGET = 65_536
#: Pieces for which a cell of the numbering is meant.
CELL = 20_000
ADDED = ["piece", "n_tokens", "bucket_tokens", "batch", "slot"]


def optimal_buckets(histogram: dict[int, int], buckets: int) -> list[int]:
    """The at most ``buckets`` lengths, the longest included, that pad the fewest tokens in all.

    ``best[j]`` is the least padding of all pieces up to the j-th length with
    that length as a bucket; each round allows one bucket more.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    pieces = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    m = len(lengths)
    best = lengths * pieces[1:] - tokens[1:]
    choices = [np.full(m, -1)]
    for _ in range(min(buckets, m) - 1):
        now, chosen = best.copy(), np.full(m, -2)
        for j in range(1, m):
            # bucket j takes the lengths after i
            cost = best[:j] + lengths[j] * (pieces[j + 1] - pieces[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(np.argmin(cost))
            if cost[i] < now[j]:
                now[j], chosen[j] = cost[i], i
        choices.append(chosen)
        best = now
    j, picked = m - 1, []
    for chosen in reversed(choices):
        if chosen[j] == -2:  # no bucket more was needed here
            continue
        picked.append(int(lengths[j]))
        j = int(chosen[j])
        if j < 0:
            break
    return sorted(picked)


def _cell(cells: int, piece: Column) -> Column:
    """The hash that orders pieces, as an unsigned fraction, gives the cell."""
    return F.floor(_order(piece) * cells).cast("bigint")


def _order(piece: Column) -> Column:
    h = F.xxhash64(F.lit("pack"), F.col("doc_id"), F.col("_h"), piece)
    return F.shiftrightunsigned(h, 11) / F.lit(float(2**53))


def _pieces(max_tokens: int, schema: T.StructType):
    """Rows for each piece with its own part of the text; white space stays with the word before it."""

    word = re.compile(r"[^\x20\x09-\x0D]+")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows, piece, sizes, parts = [], [], [], []
            for row, text in enumerate(texts):
                total = len((text or "").encode("utf-8", "surrogatepass").split()) + 1
                if total <= max_tokens:
                    rows.append(row), piece.append(0), sizes.append(total), parts.append(text)
                    continue
                starts = [m.start() for i, m in enumerate(word.finditer(text)) if i % max_tokens == 0]
                cuts = [0, *starts[1:], len(text)]
                if (total - 1) % max_tokens == 0:
                    cuts.append(len(text))
                for k in range(len(cuts) - 1):
                    rows.append(row), piece.append(k), parts.append(text[cuts[k] : cuts[k + 1]])
                    sizes.append(min(max_tokens, total - k * max_tokens))
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = {n: taken.column(n) for n in taken.schema.names}
            columns |= {"text": pa.array(parts, pa.string()), "piece": pa.array(piece, pa.int32()), "n_tokens": pa.array(sizes, pa.int32())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def packed(
    docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """Rows of ``docs`` per piece, ``text`` being the piece, plus ``piece, n_tokens, bucket_tokens, batch, slot``.

    ``batch`` counts inside its bucket from 0; ``slot`` is the place in the batch.
    """
    docs = docs.drop(*ADDED)
    marked = docs.withColumn("_h", F.xxhash64(whole()))
    rows = docs.count()
    cells = max(1, -(-rows // CELL))

    # the histogram needs no text: the pieces' lengths follow from the number of words
    total = F.size(words_of(whole())) + 1
    measured = marked.select("doc_id", "_h", total.alias("_total")).select(
        "*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_total") / F.lit(max_tokens)).cast("int") - 1)).alias("piece")
    )
    length = F.least(F.lit(max_tokens), F.col("_total") - F.col("piece") * max_tokens)
    counted = stored(
        measured.groupBy(length.alias("n_tokens"), _cell(cells, F.col("piece")).alias("_cell")).agg(F.count("*").alias("n")),
        "lengths",
    )
    histogram = {r["n_tokens"]: r["n"] for r in counted.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    edges = optimal_buckets(histogram, buckets)
    bucket = F.lit(None).cast("int")
    for edge in reversed(edges):
        bucket = F.when(F.col("n_tokens") <= edge, edge).otherwise(bucket)

    before = Window.partitionBy("bucket_tokens").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        counted.groupBy(bucket.alias("bucket_tokens"), "_cell")
        .agg(F.sum("n").alias("n"))
        .select("bucket_tokens", "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    )
    shifts = stored(shifts, "shifts")

    schema = T.StructType([*marked.schema.fields, T.StructField("piece", T.IntegerType()), T.StructField("n_tokens", T.IntegerType())])
    pieces = marked.mapInArrow(_pieces(max_tokens, schema), schema)
    placed = pieces.select(
        *docs.columns, "piece", "n_tokens", bucket.alias("bucket_tokens"), _order(F.col("piece")).alias("_order"), _cell(cells, F.col("piece")).alias("_cell")
    )
    inside = Window.partitionBy("bucket_tokens", "_cell").orderBy("_order", "doc_id", "piece")
    numbered = placed.withColumn("_n", F.row_number().over(inside) - 1).join(shifts, ["bucket_tokens", "_cell"])
    number = F.col("_n") + F.col("_shift")
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    return numbered.select(
        *docs.columns, "piece", "n_tokens", "bucket_tokens", F.floor(number / fit).alias("batch"), (number % fit).cast("int").alias("slot")
    )
