"""Repeated passages: units are hashed, grouped globally, and all but the earliest removed.

A unit is a line, or a sentence of it, as passages are often set into longer
lines. Long sentences are cut further, since a passage may start and end inside
them: after each word whose pair with the next one has the least hash within
``REACH`` pairs on both sides. Such a cut depends on these words alone, so it
falls at the same words of a passage wherever that is set, and no piece of a
sentence has ``REACH`` words or fewer. Units are compared in lower case with
white space runs as one blank. A unit that occurs earlier is taken out where it
is part of a run of ``least_words`` words of such units, one line or several: a
short sentence or line that two texts share by chance or habit is no passage.
With 1, every later unit goes. The removed pieces keep their offsets in the
original text.

Defined cases: a null text counts as empty and stays as it is; a text of any
length is worked on whole; the earliest unit is that of the smallest id (null
first), then text hash, then place; rows equal in id and text are one document
and get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.llm.common import whole
from tallyward.llm.units import later_copies

LEAST_WORDS = 1
#: Word pairs on either side of a cut inside a sentence.
REACH = 5
# A sentence ends with its mark and the white space after it, a line with its break.
_WORD = re.compile(r"\S+")
_UNIT = re.compile(r"[^\n]*?(?:[.!?][)\"'»”]*[\x20\t\r]+|\n|\Z)")


def _cuts(words: list[str]) -> list[int]:
    """The numbers of the words that start a piece of a sentence, beside the first."""
    of = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    one = [of[w] for w in words]
    h = [(a * 0x9E3779B97F4A7C15 + b) & 0xFFFFFFFFFFFFFFFF for a, b in zip(one, one[1:], strict=False)]
    # of equal hashes the first is the least; most pairs are told by their neighbours
    return [
        i + 1
        for i in range(REACH, len(h) - REACH)
        if h[i - 1] > h[i] <= h[i + 1] and h[i] == min(h[i - REACH : i + REACH + 1]) and h[i] not in h[i - REACH : i]
    ]


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Units that together are the text."""
    out = []
    for m in _UNIT.finditer(text):
        a, b = m.span()
        words = m.group().lower().split()
        cuts = _cuts(words) if len(words) > 2 * REACH + 1 else []
        if cuts:
            starts = [w.start() for w in _WORD.finditer(text, a, b)]
            for i, j in zip([0, *cuts], [*cuts, len(words)], strict=True):
                out.append((starts[i] if i else a, starts[j] if j < len(words) else b, " ".join(words[i:j])))
        elif b > a:
            out.append((a, b, " ".join(words)))
    return out


def _units(text: str) -> list[bytes]:
    return [unit.encode() for _, _, unit in sentences(text)]


def cut_spans(text: str, later: set[int], least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Spans of runs of repeated units with enough words; units without words neither end nor start a run."""
    spans: list[tuple[int, int]] = []
    start = stop = words = 0
    for i, (a, b, unit) in enumerate(sentences(text)):
        if i in later:
            if not words:
                start = a
            stop, words = b, words + len(unit.split())
        elif unit:
            if words >= least_words:
                spans.append((start, stop))
            words = 0
    if words >= least_words:
        spans.append((start, stop))
    return spans


def _removed(least_words: int, schema: T.StructType):
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text, later in zip(batch.column("text").to_pylist(), batch.column("_later").to_pylist(), strict=True):
                found = cut_spans(text, set(later), least_words) if later else []
                if found:
                    edges = [0, *[x for span in found for x in span], len(text)]
                    text = "".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                texts.append(text)
                spans.append([{"start": a, "stop": b} for a, b in found])
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(texts, pa.string())
            columns["removed"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows with ``text`` as it remains and ``removed``, the spans taken out (code points of the original)."""
    docs = docs.drop("removed")
    later = later_copies(docs, _units).groupBy("doc_id", "tag").agg(F.collect_list("unit").alias("_later"))
    later = later.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), "_later")
    marked = docs.withColumn("_own", F.xxhash64(whole()))
    joined = marked.join(later, marked.doc_id.eqNullSafe(later._doc) & (marked._own == later._tag), "left").select(*docs.columns, "_later")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("removed", spans)])
    return joined.mapInArrow(_removed(least_words, schema), schema)
