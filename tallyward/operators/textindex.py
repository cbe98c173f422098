"""An n-gram index over a corpus, so that a search reads only texts that can match.

``write_index`` lays a corpus out in blocks of neighbouring paths and lists for
every trigram the texts that hold it, one row each, every file sorted by trigram.
A search takes the literals that every match of its pattern must contain, turns them into
trigrams, intersects their postings, and hands the remaining texts to the
line search, which decides. Spark skips the row groups of other trigrams and, by
dynamic partition pruning, the blocks without a candidate. A pattern that needs
no literal of three characters scans all texts, with the same result.

Trigrams are lower-cased and of ASCII characters, so one index serves both ways
of treating case; other characters are left to the search itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators import corpus

GRAM = 3
#: Characters of text that one task lists the trigrams of; some hundred megabytes of rows to sort.
TASK_CHARACTERS = 1 << 23
#: Escapes that stand for a kind of character or a place; any other letter or digit after a backslash ends the analysis.
_KINDS = set("wWdDsSbBhHvVRAzZGtnrfae")


@dataclass(frozen=True)
class TextIndex:
    """A written corpus and its postings."""

    spark: SparkSession
    folder: str

    @property
    def texts(self) -> DataFrame:
        """``path, text, block``; partitioned by block."""
        return self.spark.read.schema("path string, text string, block int").parquet(f"{self.folder}/texts")

    @property
    def postings(self) -> DataFrame:
        """``gram, block, path``; every file sorted by gram."""
        return self.spark.read.schema("gram string, block int, path string").parquet(f"{self.folder}/postings")


def write_index(docs: DataFrame, path: str, text: str, folder: str, blocks: int = 64) -> TextIndex:
    """Write the texts in blocks of paths, and their trigrams; rows of one path count as one text in a search.

    The length of the texts is summed first, since it tells into how many tasks
    a block and its postings have to be dealt. A task sorts the postings of its
    own texts, so no posting is shuffled.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    characters = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    pieces = 1 + characters // (blocks * TASK_CHARACTERS)
    # the block of a row comes from the written copy, as ranges may be drawn anew
    ranged = named.repartitionByRange(blocks * pieces, "path")
    ranged = ranged.withColumn("block", F.floor(F.spark_partition_id() / pieces).cast("int"))
    ranged.write.partitionBy("block").parquet(f"{folder}/texts")
    index = TextIndex(spark, folder)
    grams = F.regexp_extract_all(F.lower("text"), F.lit(r"(?s)(?=([\x00-\x7F]{%d}))" % GRAM), F.lit(1))
    dealt = index.texts.repartition(1 + characters // TASK_CHARACTERS, "block", "path", F.xxhash64("text"))
    listed = dealt.select(F.explode(F.array_distinct(grams)).alias("gram"), "block", "path")
    listed.sortWithinPartitions("gram", "block", "path").write.parquet(f"{folder}/postings")
    return index


def needed_literals(pattern: str) -> list[str]:
    """Runs of ASCII characters that every match of a regular expression contains, lower-cased.

    Only what stands outside of groups, classes and choices is taken, and a
    character that may be missing is not. When in doubt there is none.
    """
    runs, run, depth, i = [], "", 0, 0
    flags = {"(?i)": 4}
    i = next((n for head, n in flags.items() if pattern.startswith(head)), 0)
    while i < len(pattern):
        c, literal = pattern[i], None
        if c == "\\":
            i += 1
            if i == len(pattern) or (pattern[i].isalnum() and pattern[i] not in _KINDS):
                return []
            literal = None if pattern[i] in _KINDS else pattern[i]
        elif c == "[":
            start = i + 1 + pattern.startswith("^", i + 1)
            end = start + 1
            while end < len(pattern) and pattern[end] != "]":
                # nested classes and escaped brackets are not followed
                if pattern[end] in "[\\" and pattern[end + 1 : end + 2] in ("[", "]", "Q", "E", ""):
                    return []
                end += 2 if pattern[end] == "\\" else 1
            if pattern[start : start + 1] in ("]", "[") or "[" in pattern[start:end]:
                return []
            i = end
        elif c == "(":
            if pattern.startswith("(?", i) and not pattern.startswith(("(?:", "(?=", "(?!", "(?<"), i):
                return []
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            return []
        elif c not in ".^$*+?{}":
            literal = c
        elif c == "{":
            i = pattern.find("}", i)
            if i < 0:
                return []
        i += 1
        follows = pattern[i : i + 1]
        if literal is not None and depth == 0 and literal.isascii():
            if follows in ("?", "*", "{") and follows:
                runs.append(run)
                run = ""
            else:
                run += literal
                if follows == "+":
                    runs.append(run)
                    run = ""
        else:
            runs.append(run)
            run = ""
    return [r.lower() for r in [*runs, run] if len(r) >= GRAM]


def needed_grams(pattern: str) -> list[str]:
    """The trigrams of all literals a match needs."""
    return sorted({run[k : k + GRAM] for run in needed_literals(pattern) for k in range(len(run) - GRAM + 1)})


def candidates(index: TextIndex, pattern: str) -> DataFrame | None:
    """``block, path`` of the texts that hold all trigrams a match needs; ``None`` if it needs none."""
    grams = needed_grams(pattern)
    if not grams:
        return None
    # a gram comes once for each row of a path
    held = index.postings.filter(F.col("gram").isin(grams)).groupBy("block", "path").agg(F.count_distinct("gram").alias("_held"))
    return held.filter(F.col("_held") == len(grams)).select("block", "path")


def searched(index: TextIndex, pattern: str) -> DataFrame:
    """``path, text`` of all texts that can match."""
    found = candidates(index, pattern)
    texts = index.texts
    return (texts if found is None else texts.join(found, ["block", "path"], "left_semi")).select("path", "text")


def matching_lines(index: TextIndex, pattern: str, **options) -> DataFrame:
    """``corpus.matching_lines`` over the texts that can match."""
    return corpus.matching_lines(searched(index, pattern), "path", "text", pattern, **options)


def grep(index: TextIndex, pattern: str, max_results: int | None = 100, **options) -> DataFrame:
    """``corpus.grep`` over the texts that can match."""
    return corpus.grep(searched(index, pattern), "path", "text", pattern, max_results, **options)


def grep_totals(index: TextIndex, pattern: str, max_results: int = 100, **options) -> DataFrame:
    """``corpus.grep_totals`` over the texts that can match."""
    return corpus.grep_totals(searched(index, pattern), "path", "text", pattern, max_results, **options)
