"""Exact removal of repeated byte strings with suffix arrays built by two-stage sorting.

Every byte that a string of ``LENGTH`` bytes covers is removed if that string
also starts earlier: in a document with a smaller id, or further up in the same
one. Strings are judged on the input.

One suffix array over a corpus would have to be sorted as a whole, so equal
strings are brought together first. Each window of ``LENGTH`` bytes has a
least hash among its grams of ``GRAM`` bytes, its anchor. Equal windows have
equal anchors, and neighbouring windows mostly share one, so a text falls into
runs of windows with one anchor, about one for each 39 bytes. Only runs whose
anchor occurs elsewhere matter. Of these, runs with the same bytes as an earlier
run are removed outright, and where an anchor has one content only, that
settles it. What remains, different texts around a shared anchor, is sorted:
the first run of each content goes to the task of its anchor, and each task
builds suffix arrays over some hundred thousand bytes of such runs.

The sort is the two-stage one. Suffixes smaller than their successors are
sorted directly, by words of eight bytes down to ``LENGTH``. The rest is induced
by scanning the buckets of the first byte in order: what stands before a
suffix goes next into its own bucket's front part. Adjacent suffixes are then
compared to find common prefixes of ``LENGTH``, and in each class of equal
windows all but the earliest are removed.

Equal runs in one batch of documents are told at once, so a passage that a third
of all documents hold comes to its task once per batch, and its content once
in all. Where a very common passage ends, its last anchors have as many
contents as documents. The runs of an anchor with more than ``HOT`` contents
are cut into their windows, which go to tasks by their own hashes, equal ones
of a batch once; so no anchor makes a large group.

Defined cases: a null text counts as empty; texts shorter than ``LENGTH`` are
never touched; a text of any length is worked on whole; repeated rows with
equal ids and texts count as one document, equal ids with different texts go by
the hash of the text; a null id comes first; an empty table gives an empty
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
from tallyward.llm.shingles import _powers, blocks, mix
from tallyward.llm.units import once

LENGTH = 100
GRAM = 24
#: Contents around one anchor beyond which their windows are told apart one by one.
HOT = 1000
#: Bytes of runs that one suffix array is built over; a group of one anchor is not parted.
CHUNK = 1 << 19
ADDED = ["kept", "spans"]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first byte, number of windows, anchor, content mark, whether the anchor recurs inside.

    ``data`` holds texts one after another, ``ends`` where each ends.
    """
    grams = LENGTH - GRAM + 1
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    up, down = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    h = mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    least, width = h, 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n], least[grams - width : grams - width + n])
    # a window must not reach into the next text
    text = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + LENGTH <= ends[text]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(new & inside)
    stops = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]])) + 1
    anchor, length = least[starts], stops - starts
    content = mix((total[stops + LENGTH - 1] - total[starts]) * down[starts] + length.astype(np.uint64))
    # how often the anchor occurs among the grams of the run
    spans = length + grams - 1
    first = np.concatenate([[0], np.cumsum(spans)[:-1]])
    at = np.repeat(starts - first, spans) + np.arange(int(spans.sum()))
    hits = np.add.reduceat((h[at] == np.repeat(anchor, spans)).astype(np.int32), first) if len(starts) else spans
    return starts, length, anchor, content, hits > 1


_RUN = "v bigint, c bigint, doc_id bigint, tag int, start int, n int, again boolean, sure boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*[batch.column(x).to_pylist() for x in ("doc_id", "tag", "text")], strict=True)
        rows = once(r for r in rows if len(r[2]) >= LENGTH)
        ids = [r[0] for r in rows]
        tags = np.array([r[1] for r in rows], np.int32)
        found = []
        for a, b in blocks([r[2] for r in rows]):
            data = np.frombuffer(b"".join(r[2] for r in rows[a:b]), np.uint8)
            ends = np.cumsum([len(r[2]) for r in rows[a:b]])
            starts, length, anchor, content, again = anchors(data, ends)
            text = np.searchsorted(ends, starts, side="right")
            begin = ends[text] - np.array([len(r[2]) for r in rows[a:b]])[text]
            found.append((text + a, starts - begin, length, anchor, content, again))
        if not found:
            continue
        text, start, length, anchor, content, again = (np.concatenate(x) for x in zip(*found, strict=True))
        # rows are in order, so of equal runs all but the first are removed for sure
        order = np.lexsort((np.arange(len(anchor)), content, anchor))
        same = np.zeros(len(order), bool)
        same[1:] = (anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1])
        sure = np.zeros(len(order), bool)
        sure[order] = same
        spread = np.where(sure, mix(np.arange(len(anchor), dtype=np.uint64) ^ content), anchor)
        arrays = [
            pa.array(spread.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids, pa.int64()).take(pa.array(text)),
            pa.array(tags[text]), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(again), pa.array(sure),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _RUN.split(", ")])


def sort_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """``wanted`` positions ordered by their first ``depth`` bytes, by two-stage sorting.

    ``text`` is padded with ``depth`` zeros or more. Positions are ascending.
    """
    n = len(text) - 8
    step = np.sign(text[1 : n + 1].astype(np.int16) - text[:n].astype(np.int16))
    step[n - 1] = 1  # the zeros at the end are as small as can be
    # equal neighbours have the type of what follows the run
    last = np.where(step != 0, np.arange(n), n - 1)
    last = np.minimum.accumulate(last[::-1])[::-1]
    small = step[last] > 0  # smaller than its successor
    # larger ones need their successors, up to the first smaller one
    member = np.zeros(n + 1, bool)
    member[wanted] = True
    edge = wanted
    while len(edge):
        edge = edge[~small[edge] & (edge + 1 < n)] + 1
        edge = edge[~member[edge]]
        member[edge] = True
    positions = np.flatnonzero(member[:n])
    direct = positions[small[positions] | (positions + 1 >= n)]
    word = np.ndarray(shape=(len(text) - 7,), dtype=">u8", buffer=text.tobytes(), strides=(1,))
    order = direct[np.argsort(word[direct].astype(np.uint64), kind="stable")]
    group = np.cumsum(np.concatenate([[0], np.diff(word[order].astype(np.uint64)) != 0])) if len(order) else order
    for offset in range(8, depth, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1) if len(group) else group
        if not len(tied):
            break
        at = np.minimum(order[tied] + offset, len(word) - 1)
        w = word[at].astype(np.uint64)
        by = np.lexsort((w, group[tied]))
        order[tied] = order[tied][by]
        w = w[by]
        new = np.zeros(len(order), bool)
        new[0] = True
        new[1:] = group[1:] != group[:-1]
        g = group[tied]
        new[tied[1:]] |= (w[1:] != w[:-1]) | (g[1:] != g[:-1])
        group = np.cumsum(new) - 1
    # scan the buckets of the first byte; the front part of each is filled by then
    values = text[positions]
    present = np.unique(values)
    front: dict[int, list[np.ndarray]] = {int(c): [] for c in present}
    first_of = np.searchsorted(text[order], np.arange(257)) if len(order) else np.zeros(257, np.int64)
    induced = member[:n] & ~small
    induced[direct] = False
    out = []

    def before(these: np.ndarray) -> np.ndarray:
        prior = these[these > 0] - 1
        return prior[induced[prior]]

    for c in present.tolist():
        part = np.concatenate(front[c]) if front[c] else np.zeros(0, np.int64)
        fresh = part
        while len(fresh):
            prior = before(fresh)
            fresh = prior[text[prior] == c]
            part = np.concatenate([part, fresh])
        part = np.concatenate([part, order[first_of[c] : first_of[c + 1]]])
        out.append(part)
        prior = before(part)
        prior = prior[text[prior] > c]
        byte = text[prior]
        by = np.argsort(byte, kind="stable")
        prior, byte = prior[by], byte[by]
        cuts = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1], [True]])) if len(byte) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            front[int(byte[a])].append(prior[a:b])
    ranked = np.concatenate(out) if out else positions
    chosen = np.zeros(n + 1, bool)
    chosen[wanted] = True
    return ranked[chosen[ranked]]


def same_prefix(text: np.ndarray, ranked: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each adjacent pair of ranked suffixes: whether their common prefix has ``length`` bytes."""
    word = np.ndarray(shape=(len(text) - 7,), dtype=">u8", buffer=text.tobytes(), strides=(1,))
    same = np.ones(max(0, len(ranked) - 1), bool)
    for offset in [*range(0, length - 7, 8), length - 8]:
        live = np.flatnonzero(same)
        same[live] = word[ranked[live] + offset] == word[ranked[live + 1] + offset]
    return same


def later_windows(contents: list[bytes]) -> list[list[tuple[int, int]]]:
    """For runs in order of their places: ranges (first window, number) of windows that start earlier as well."""
    text = np.frombuffer(b"\0".join(contents) + bytes(LENGTH + 16), np.uint8)
    sizes = np.array([len(c) for c in contents])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    windows = sizes - LENGTH + 1
    first = np.concatenate([[0], np.cumsum(windows)[:-1]])
    wanted = np.repeat(begins - first, windows) + np.arange(int(windows.sum()))
    ranked = sort_suffixes(text, wanted)
    same = same_prefix(text, ranked)
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    # positions are in order of place, so the least of a class is the earliest
    least = np.minimum.reduceat(ranked, starts)
    later = ranked != np.repeat(least, np.diff(np.concatenate([starts, [len(ranked)]])))
    gone = np.zeros(len(text) + 1, np.int8)
    gone[ranked[later]] = 1
    edge = np.diff(gone, prepend=np.int8(0))
    ups, downs = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(begins, ups, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    for i, a, b in zip(owner.tolist(), ups.tolist(), downs.tolist(), strict=True):
        out[i].append((a - int(begins[i]), b - a))
    return out


_SEGMENT = "v bigint, doc_id bigint, tag int, start int, content binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed runs of each document, or of each window of them where the anchor is hot.

    A window that came up before in the batch is sent without its bytes: it is removed in any case.
    """
    for batch in sliced(batches):
        rows: list = []
        seen: set[bytes] = set()
        columns = zip(*[batch.column(x).to_pylist() for x in ("doc_id", "tag", "text", "_runs")], strict=True)
        for doc, tag, text, runs in sorted(columns, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            for r in sorted(runs, key=lambda r: r["start"]):
                start = r["start"]
                if not r["hot"]:
                    rows.append((r["v"], doc, tag, start, text[start : start + r["n"] + LENGTH - 1]))
                    continue
                for i in range(start, start + r["n"]):
                    window = text[i : i + LENGTH]
                    if window in seen:
                        rows.append((xxhash.xxh3_64_intdigest(window, seed=i + len(rows)) - (1 << 63), doc, tag, i, None))
                    else:
                        seen.add(window)
                        rows.append((xxhash.xxh3_64_intdigest(window) - (1 << 63), doc, tag, i, window))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for a in range(0, len(rows), 50_000):
            part = zip(*rows[a : a + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], names=[c.split()[0] for c in _SEGMENT.split(", ")])


_GONE = "doc_id bigint, tag int, start int, n int"


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over whole groups of anchors, which come in order, each by place."""

    def out(rows: list) -> pa.RecordBatch:
        # across anchors nothing is equal, so one order by place serves all groups
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        gone = []
        for row, found in zip(rows, later_windows([r[4] for r in rows]), strict=True):
            gone += [(row[1], row[2], row[3] + a, k) for a, k in found]
        return table(gone)

    def table(gone: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        columns = list(zip(*gone, strict=True)) if gone else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _GONE.split(", ")])

    rows, sure, size, held = [], [], 0, None
    for batch in batches:
        for row in zip(*[batch.column(c.split()[0]).to_pylist() for c in _SEGMENT.split(", ")], strict=True):
            if size > CHUNK and row[0] != held:
                yield out(rows)
                rows, size = [], 0
            held = row[0]
            if row[4] is None:
                sure.append((row[1], row[2], row[3], 1))
                continue
            rows.append(row)
            size += len(row[4])
        if sure:
            yield table(sure)
            sure = []
    if rows:
        yield out(rows)


def _cut(schema: T.StructType):
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for text, gone in zip(batch.column("_bytes").to_pylist(), batch.column("_gone").to_pylist(), strict=True):
                found: list[list[int]] = []
                for start, n in sorted((g["start"], g["n"]) for g in gone or ()):
                    if found and start <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], start + n + LENGTH - 1)
                    else:
                        found.append([start, start + n + LENGTH - 1])
                edges = [0, *[x for span in found for x in span], len(text)]
                kept.append(b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
                spans.append([{"start": a, "stop": b} for a, b in found])
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["kept"] = pa.array(kept, pa.binary())
            columns["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows with ``kept``, the remaining bytes, and ``spans``, the removed ones (byte offsets in the original)."""
    docs = docs.drop(*ADDED)
    tag = F.shiftright(F.xxhash64(whole()), 32).cast("int")
    marked = docs.select("*", tag.alias("_own"), whole().cast("binary").alias("_bytes"))
    texts = docs.select("doc_id", tag.alias("tag"), whole().cast("binary").alias("text"))
    runs = texts.mapInArrow(_runs, _RUN)
    rank = F.struct("doc_id", "tag", "start")
    group, content = Window.partitionBy("v"), Window.partitionBy("v", "c")
    placed = runs.select(
        "*",
        F.min(rank).over(content).alias("_first"),
        ((F.min("c").over(group) != F.max("c").over(group)) | F.max("again").over(group)).alias("_mixed"),
    ).withColumn("gone", F.col("sure") | (rank != F.col("_first")))
    contents = F.count(F.when(~F.col("gone"), True)).over(group)
    found = stored(
        placed.withColumn("hot", contents > HOT).filter("gone or _mixed").select("v", "doc_id", "tag", "start", "n", "gone", "hot"),
        "runs",
    )
    wanted = (
        found.filter("not gone")
        .groupBy(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"))
        .agg(F.collect_set(F.struct("v", "start", "n", "hot")).alias("_runs"))  # repeated rows in other batches list the same runs
    )
    segments = (
        texts.join(wanted.hint("merge"), texts.doc_id.eqNullSafe(wanted._doc) & (texts.tag == wanted._tag))
        .dropDuplicates(["doc_id", "tag"])
        .select("doc_id", "tag", "text", "_runs")
        .mapInArrow(_segments, _SEGMENT)
    )
    sorted_out = stored(segments.repartition("v").sortWithinPartitions("v").mapInArrow(_sorted, _GONE), "later-windows")
    every = found.filter("gone").select("doc_id", "tag", "start", "n").unionByName(sorted_out)
    lists = every.groupBy(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag")).agg(
        F.collect_list(F.struct("start", "n")).alias("_gone")
    )
    joined = marked.join(lists.hint("merge"), marked.doc_id.eqNullSafe(lists._doc) & (marked._own == lists._tag), "left")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("kept", T.BinaryType()), T.StructField("spans", spans)])
    return joined.select(*docs.columns, "_bytes", "_gone").mapInArrow(_cut(schema), schema)
