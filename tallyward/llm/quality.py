"""Quality rules whose thresholds follow the data.

Each document gets a few whole-number measures. Per language and source, every
measure is summarised by a quantile sketch with logarithmic buckets: a bucket
holds all values within one factor ``GAMMA``, so a quantile read from it is off
by at most one percent of its value, and sketches merge by adding counts. A
document fails when a measure lies outside the fences that its own group's
quartiles set: twelve times the distance from median to quartile beyond that
quartile, which is eight standard deviations of a normal measure, and as a quarter of
a group may be junk without moving them. Where a measure is the same for most of
a group that distance is 0; a distance counts as no less than the two percent
that a bucket spans, and a document may pass the quartile by two occurrences. A group with few documents uses the merged sketch of its
language, and a rare language that of the whole corpus.

Only built-in functions are used. The bucket counts combine before they are
shuffled, so a source with a third of all rows is no larger than any other; a
group has some hundred buckets at most, whatever its size.

Defined cases: a null text counts as empty and fails; null languages and
sources form groups of their own; repeated rows are judged each by themselves;
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.common import SPACE, marks, same, stored, whole, words_of

GAMMA = 1.02
#: Documents a group needs for thresholds of its own.
LEAST_GROUP = 200
#: Fences lie this many spreads outside the outer quartiles; a spread is what lies between quartile and median.
REACH = 12
#: A document is never rejected for so few occurrences beyond the quartile.
OCCURRENCES = 2
#: Measure: (what one occurrence adds to it, whether low values fail as well).
MEASURES = {
    "symbols": ("1000 / n_words", False),
    "dup_lines": ("1000 / n_lines", False),
    "line_words": ("10 / n_lines", True),
    "capitals": ("1000 / word_chars", False),
    "word_length": ("100 / n_words", True),
}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and ``base_failed`` to each row; one pass, no shuffle."""
    t = whole(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select("*", words_of(t).alias("_words"), lines.alias("_lines"))
    windows = F.when(
        F.size("_words") >= 5,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - 5),
            lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(5)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    two = one.select(
        *docs.columns,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.size(F.split(t, "[#*$%&|<>]")) - 1).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        (F.size(F.split(t, "[A-Z]")) - 1).cast("bigint").alias("n_capitals"),
        windows.alias("_windows"),
    )
    # only documents that repeat a window pay for the sort
    three = two.select(
        *[c for c in two.columns if c != "_windows"],
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    )
    again = F.filter(
        F.col("_sorted"),
        lambda x, i: (F.get(F.col("_sorted"), i - 1)["h"] == x["h"]) | (F.get(F.col("_sorted"), i + 1)["h"] == x["h"]),
    )
    four = three.select(
        *[c for c in three.columns if c != "_sorted"],
        F.sort_array(F.transform(again, lambda x: x["i"])).alias("_starts"),
    )
    # each repeated window adds the words that the one before it does not cover
    added = F.transform(
        F.col("_starts"),
        lambda s, i: F.when(i == 0, F.lit(5)).otherwise(F.least(F.lit(5), s - F.get(F.col("_starts"), i - 1))),
    )
    covered = F.aggregate(added, F.lit(0), lambda a, x: a + x)
    five = four.select(
        *[c for c in four.columns if c != "_starts"],
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )
    return five.withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def _measures() -> dict[str, Column]:
    """Whole numbers per thousand words, lines or characters; tenths of words a line, hundredths of characters a word."""
    return {
        "symbols": F.expr("1000 * n_symbols div nullif(n_words, 0)"),
        "dup_lines": F.expr("1000 * n_dup_lines div nullif(n_lines, 0)"),
        "line_words": F.expr("10 * n_words div nullif(n_lines, 0)"),
        "capitals": F.expr("1000 * n_capitals div nullif(word_chars, 0)"),
        "word_length": F.expr("100 * word_chars div nullif(n_words, 0)"),
    }


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n``: one mergeable sketch per group and measure.

    ``rows`` are measured rows that passed the base rules.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("v")) for m, v in _measures().items()])
    each = rows.select("lang", "source", F.explode(pairs).alias("x"))
    bucket = F.when(F.col("x.v") <= 0, F.lit(-1)).otherwise(F.ceil(F.log("x.v") / F.lit(math.log(GAMMA))))
    return each.groupBy("lang", "source", "x.measure", bucket.cast("int").alias("bucket")).agg(
        F.count("*").alias("n")
    )


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, q1, q2, q3, total`` read from sketches merged over ``keys``."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy(*keys, "measure").orderBy("bucket")
    upto = merged.select(
        "*",
        F.sum("n").over(ordered).alias("upto"),
        F.sum("n").over(Window.partitionBy(*keys, "measure")).alias("total"),
    )
    value = F.when(F.col("bucket") < 0, 0.0).otherwise(
        F.lit(2.0 / (GAMMA + 1)) * F.pow(F.lit(GAMMA), F.col("bucket").cast("double"))
    )
    return upto.groupBy(*keys, "measure").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("total"), value)).alias("q1"),
        F.min(F.when(2 * F.col("upto") >= F.col("total"), value)).alias("q2"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), value)).alias("q3"),
        F.max("total").alias("total"),
    )


def fences(sketch: DataFrame) -> DataFrame:
    """For each ``lang, source`` and measure the upper quartile ``top_`` and the way ``up_`` from it to the fence, and the same downwards."""
    level = {
        "g": quartiles(sketch, ["lang", "source"]),
        "l": quartiles(sketch, ["lang"]),
        "a": quartiles(sketch, []),
    }
    g, la, al = (
        q.select(
            *[F.col(c).alias(f"{name}_{c}") for c in q.columns if c in ("lang", "source", "measure")],
            F.struct("q1", "q2", "q3", "total").alias(name),
        )
        for name, q in level.items()
    )
    joined = g.join(
        la, g.g_lang.eqNullSafe(la.l_lang) & (g.g_measure == la.l_measure)
    ).join(al, g.g_measure == al.a_measure)
    used = (
        F.when(F.col("g.total") >= LEAST_GROUP, F.col("g"))
        .when(F.col("l.total") >= LEAST_GROUP, F.col("l"))
        .otherwise(F.col("a"))
    )
    rows = joined.select(
        F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), F.col("g_measure").alias("measure"), used.alias("q")
    )
    picked = []
    for name, (_, both) in MEASURES.items():
        mine = F.col("measure") == name
        picked.append(F.max(F.when(mine, F.col("q.q3"))).alias(f"top_{name}"))
        picked.append(F.max(F.when(mine, REACH * F.greatest(F.col("q.q3") - F.col("q.q2"), (GAMMA - 1) * F.col("q.q3")))).alias(f"up_{name}"))
        if both:
            picked.append(F.max(F.when(mine, F.col("q.q1"))).alias(f"bottom_{name}"))
            picked.append(F.max(F.when(mine, REACH * F.greatest(F.col("q.q2") - F.col("q.q1"), (GAMMA - 1) * F.col("q.q1")))).alias(f"down_{name}"))
    return rows.groupBy("lang", "source").agg(*picked)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Measured rows with ``kept``; ``limits`` has a row for each group that any row passed the base rules in."""
    limits = limits.select(*[F.col(c).alias(f"_f_{c}") for c in limits.columns])
    joined = rows.join(
        limits, rows.lang.eqNullSafe(limits._f_lang) & rows.source.eqNullSafe(limits._f_source), "left"
    )
    inside = ~F.col("base_failed")
    for name, value in _measures().items():
        one, both = MEASURES[name]
        rounding = OCCURRENCES * F.expr(f"cast({one.replace(' / ', ' as double) / nullif(')}, 0)")
        inside = inside & (value <= F.col(f"_f_top_{name}") + F.greatest(F.col(f"_f_up_{name}"), rounding))
        if both:
            inside = inside & (value >= F.col(f"_f_bottom_{name}") - F.greatest(F.col(f"_f_down_{name}"), rounding))
    return joined.select(*rows.columns, F.coalesce(inside, F.lit(False)).alias("kept"))


def quality_verdicts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``lang``, ``source``, all counts, ``base_failed`` and ``kept`` per document.

    The counts are written once: the sketches and the final filter both read
    them, and they are small where the texts are not.
    """
    text = docs.select(*keep, "lang", "source", "text")
    rows = stored(measured(text).drop("text"), "quality")
    return judged(rows, fences(sketches(rows.filter(~F.col("base_failed")))))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    The verdict depends on text, language and source alone, so it is joined
    back on these (texts by two hashes) and on the id, all null-safe.
    """
    h1, h2 = marks(whole())
    keys = ["doc_id", "lang", "source", "_h1", "_h2"]
    marked = docs.select("doc_id", "lang", "source", "text", h1.alias("_h1"), h2.alias("_h2"))
    verdicts = quality_verdicts(marked, ["doc_id", "_h1", "_h2"])
    passed = verdicts.filter("kept").select(*keys)
    full = docs.select("*", h1.alias("_h1"), h2.alias("_h2"))
    return full.join(passed, same(full, passed, *keys), "left_semi").select(*docs.columns)
