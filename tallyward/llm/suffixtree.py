"""A language model with contexts of variable length: a probabilistic suffix tree over bytes.

A text is its lower-case words, each closed by a blank, then an end mark. A
context is what stands before a symbol in its word, at most ``DEPTH`` bytes,
the blank before the word included; contexts do not reach into the word
before. So a word's probability is a property of the word: the model learns
from the table of counted words, each distinct word is scored once, and a
text's score is the sum over its words.

A context is a candidate if at least the share ``LEAST_SHARE`` of all symbols
follows it. That bounds the candidates by ``(DEPTH + 1) / LEAST_SHARE`` for any
corpus, which makes the model small enough to send to every executor. A
candidate is kept if the distribution after it diverges from that after its
longest suffix by more than its own description costs, or if a kept context
ends in it. Distributions are smoothed towards that of the next shorter
context, in proportion to how many different symbols follow, and the root
towards an even spread over all bytes. The longest kept suffix of what was read
is the state that gives the next symbol its probability.

Words that make up at least ``FREQUENT`` of all tokens number at most
``1 / FREQUENT``; they are looked up where the text is read. Only the other
words of each document go through a join.

Defined cases: a null text counts as empty and consists of the end mark; a text
of any length is scored whole; a null id counts as the empty text when
documents are held out; repeated rows count and are scored each by themselves;
with no training text at all, every token has the even probability; an empty
table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import stored, whole

DEPTH = 6
LEAST_SHARE = 5e-6
FREQUENT = 1e-5
#: Distinct words that a task holds before it hands them on.
HELD = 300_000
BLANK, END = b" ", b"\n"


def held_out(folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-case words; exactly the white space of the contract parts them."""
    return (text or b"").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        words = list(all_words)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([trained[w] for w in words], pa.int64()), pa.array([all_words[w] for w in words], pa.int64())],
            names=["word", "c", "n"],
        )

    trained, all_words = Counter(), Counter()
    for batch in batches:
        for text, held in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
            words = tokens(text)
            all_words.update(words)
            if not held:
                trained.update(words)
            if len(all_words) > HELD:
                yield out()
                trained, all_words = Counter(), Counter()
    if all_words:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, c, n``: how often each word occurs in training texts and in all; ``docs`` has ``text`` (binary), ``held_out``."""
    counted = docs.select("text", "held_out").mapInArrow(_count, "word binary, c bigint, n bigint")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _grams(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([g[:-1] for g in held], pa.binary()), pa.array([g[-1] for g in held], pa.int32()), pa.array(list(held.values()), pa.int64())],
                names=["context", "symbol", "n"],
            )

        held: dict[bytes, int] = {}
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True):
                s = BLANK + word + BLANK
                for i in range(1, len(s)):
                    gram = s[i - depth if i > depth else 0 : i + 1]
                    held[gram] = held.get(gram, 0) + c
            if len(held) > HELD:
                yield out()
                held = {}
        if held:
            yield out()

    return run


def contexts(words: DataFrame, texts: int, depth: int = DEPTH, least_share: float = LEAST_SHARE) -> DataFrame:
    """``context, symbol, n, total, kinds`` of the kept contexts; the root is the empty context."""
    spark = words.sparkSession
    longest = words.filter("c > 0").mapInArrow(_grams(depth), "context binary, symbol int, n bigint")
    longest = longest.groupBy("context", "symbol").agg(F.sum("n").alias("n"))
    ends = spark.range(1).select(F.lit(BLANK).alias("context"), F.lit(END[0]).alias("symbol"), F.lit(texts).cast("bigint").alias("n"))
    suffixes = F.transform(
        F.sequence(F.lit(0), F.length("context")), lambda k: F.substring(F.col("context"), k + 1, F.lit(depth + 1))
    )
    every = longest.unionByName(ends).select(F.explode(suffixes).alias("context"), "symbol", "n").filter("n > 0")
    counted = every.groupBy("context", "symbol").agg(F.sum("n").alias("n"))
    with_totals = counted.join(
        counted.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "context"
    )
    rows = stored(with_totals, "contexts")
    symbols = rows.filter(F.length("context") == 0).agg(F.max("total")).first()[0] or 0
    rows = rows.filter(F.col("total") >= least_share * symbols)
    shorter = rows.select(
        F.col("context").alias("_shorter"), F.col("symbol").alias("_symbol"), (F.col("n") / F.col("total")).alias("_p")
    )
    child = rows.filter(F.length("context") > 0).withColumn("_suffix", F.substring("context", 2, depth))
    joined = child.join(shorter, (child._suffix == shorter._shorter) & (child.symbol == shorter._symbol))
    tested = joined.groupBy("context").agg(
        F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("_p"))).alias("gain"),
        F.max(0.5 * (F.col("kinds") - 1) * F.log("total") + 1.0).alias("cost"),
    )
    kept = (
        tested.filter("gain > cost")
        .select(F.explode(F.transform(F.sequence(F.lit(0), F.length("context")), lambda k: F.substring(F.col("context"), k + 1, F.lit(depth + 1)))).alias("context"))
        .distinct()
    )
    root = spark.range(1).select(F.lit(b"").alias("context"))
    return rows.join(kept.union(root).distinct(), "context", "left_semi")


class Tree:
    """The kept contexts with smoothed distributions; log10 throughout."""

    def __init__(self, log: dict[bytes, float], less: dict[bytes, float], depth: int = DEPTH):
        self.log, self.less, self.depth = log, less, depth

    @classmethod
    def grown(cls, rows: list, depth: int = DEPTH) -> Tree:
        """From rows of ``contexts``, shorter contexts first."""
        self = cls({}, {}, depth)
        seen: dict[bytes, list] = {}
        for r in rows:
            seen.setdefault(bytes(r["context"]), []).append(r)
        if b"" not in seen:
            self.less[b""] = 0.0
        for context in sorted(seen, key=len):
            total, kinds = seen[context][0]["total"], seen[context][0]["kinds"]
            self.less[context] = math.log10(kinds / (total + kinds))
            for r in seen[context]:
                gram = context + bytes([r["symbol"]])
                lower = 10 ** self._shorter(gram)
                self.log[gram] = math.log10((r["n"] + kinds * lower) / (total + kinds))
        return self

    def _shorter(self, gram: bytes) -> float:
        """The symbol after the next shorter context."""
        return self.symbol(gram[1:]) if len(gram) > 1 else -math.log10(256)

    def symbol(self, gram: bytes) -> float:
        """log10 probability of the last byte after the longest kept suffix of the others."""
        found = self.log.get(gram)
        if found is not None:
            return found
        less = self.less.get(gram[:-1])
        return self._shorter(gram) + (less or 0.0) if less is not None or len(gram) > 1 else -math.log10(256)

    def word(self, word: bytes) -> float:
        s, d = BLANK + word + BLANK, self.depth
        return sum(self.symbol(s[i - d if i > d else 0 : i + 1]) for i in range(1, len(s)))

    def end(self) -> float:
        return self.symbol(BLANK + END)


def _scored(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tree(*tree.value)
        for batch in batches:
            scores = [model.word(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


_PARTS = "row bigint, doc_id bigint, held_out boolean, word binary, times bigint, n_tokens bigint, n_known bigint, base double, score double"


def _documents(frequent, end: tuple[int, float, float]):
    """A row for each document with what is known here, and one for each of its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            rows = []
            columns = [batch.column(n).to_pylist() for n in ("row", "doc_id", "held_out", "text")]
            for row, doc, held, text in zip(*columns, strict=True):
                words = Counter(tokens(text))
                total, n_known, base, score = 1, int(end[0] > 0), end[1], end[2]
                for word, times in words.items():
                    total += times
                    found = known.get(word)
                    if found is None:
                        rows.append((row, None, None, word, times, 0, 0, 0.0, 0.0))
                    else:
                        n_known += times if found[0] else 0
                        base += times * found[1]
                        score += times * found[2]
                # a key of its own, which no word has, spreads these rows over the join
                rows.append((row, doc, held, END + str(row).encode(), 0, total, n_known, base, score))
                if len(rows) > 100_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    def out(rows: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in _PARTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def scored(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row."""
    spark = docs.sparkSession
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", held_out(folds, fold).alias("held_out"), whole().cast("binary").alias("text")
    )
    ends = docs.filter(~held_out(folds, fold)).count()
    words = stored(vocabulary(texts), "vocabulary")
    sums = words.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    train = (sums["c"] or 0) + ends
    v = sums["v"] + (ends > 0)
    log_all = math.log10(train + v + 1)

    tree = Tree.grown(contexts(words, ends).collect())  # at most (DEPTH + 1) / LEAST_SHARE contexts
    table = stored(words.mapInArrow(_scored(spark.sparkContext.broadcast((tree.log, tree.less))), "word binary, c bigint, n bigint, score double"), "words")
    often = table.filter(F.col("n") >= FREQUENT * (sums["n"] or 0)).collect()  # at most 1 / FREQUENT words
    frequent = {bytes(r["word"]): (r["c"], math.log10(r["c"] + 1) - log_all, r["score"]) for r in often}
    end = (ends, math.log10(ends + 1) - log_all, tree.end())
    parts = texts.mapInArrow(_documents(spark.sparkContext.broadcast(frequent), end), _PARTS)
    rare = table.filter(F.col("n") < FREQUENT * (sums["n"] or 0)).select(
        "word", "c", (F.log10(F.col("c") + 1.0) - log_all).alias("_base"), F.col("score").alias("_score")
    )
    joined = parts.join(rare, "word", "left")
    times = F.col("times")
    sums_of = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, times).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(times * F.col("_base"), F.lit(0.0))).alias("base_score"),
        F.sum(F.col("score") + F.coalesce(times * F.col("_score"), F.lit(0.0))).alias("score"),
    )
    return sums_of.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
