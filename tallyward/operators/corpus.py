"""Line search over a corpus of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A path pattern as a regular expression.

    ``**`` crosses folders, ``*`` and ``?`` stay inside a name; a pattern
    without a slash fits the file name in any folder.
    """
    anywhere = "/" not in glob
    out, i = "", 0
    glob = glob.lstrip("/")
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return ("^(?:.*/)?" if anywhere else "^/?") + out + "$"


def path_test(path: Column, glob: str | None = None, ignore: list[str] = ()) -> Column:
    """Whether a path fits ``glob`` and neither it nor a folder above it is ignored."""
    test = path.rlike(glob_regex(glob)) if glob else F.lit(True)
    for pattern in ignore:
        clean = pattern.rstrip("/").lstrip("/")
        inside = glob_regex(f"**/{clean}")[:-1] + "(?:/.*)?$"
        test = test & ~path.rlike(inside)
    return test


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)


def matching_lines(
    docs: DataFrame,
    path: str,
    text: str,
    pattern: str,
    ignore_case: bool = False,
    glob: str | None = None,
    ignore: list[str] = (),
    context: int = 0,
) -> DataFrame:
    """``path, line_number, line_content, submatches``, with ``context`` lines around each.

    Matching happens inside the array of a text's lines, so only lines that
    match become rows and no text is copied per line.
    """
    regex = f"(?i){pattern}" if ignore_case else pattern
    chosen = docs.filter(path_test(F.col(path).cast("string"), glob, ignore))
    lined = chosen.select(F.col(path).alias("path"), _lines(F.col(text)).alias("_lines"))

    def hit(line: Column, i: Column) -> Column:
        fields = [
            (i + 1).cast("bigint").alias("line_number"),
            line.alias("line_content"),
            F.regexp_count(line, F.lit(regex)).cast("bigint").alias("submatches"),
        ]
        if context:
            first = F.greatest(i - context, F.lit(0))
            fields.append(F.slice("_lines", first + 1, i - first).alias("context_before"))
            fields.append(F.slice("_lines", i + 2, F.lit(context)).alias("context_after"))
        return F.when(line.rlike(regex), F.struct(*fields))

    found = F.filter(F.transform("_lines", hit), lambda h: h.isNotNull())
    return lined.select("path", F.inline(found))


def grep(docs: DataFrame, path: str, text: str, pattern: str, max_results: int | None = 100, **options) -> DataFrame:
    """One row per submatch in path and line order; the first ``max_results``."""
    lines = matching_lines(docs, path, text, pattern, **options)
    rows = lines.select(
        "*", F.explode(F.sequence(F.lit(1), F.col("submatches").cast("int"))).alias("submatch")
    ).drop("submatches")
    if max_results is None:
        return rows
    return rows.orderBy("path", "line_number", "submatch").limit(max_results)


def grep_totals(docs: DataFrame, path: str, text: str, pattern: str, max_results: int = 100, **options) -> DataFrame:
    """One row: all submatches, lines and texts hit, and whether ``grep`` cuts the list."""
    lines = matching_lines(docs, path, text, pattern, **options)
    total = F.coalesce(F.sum("submatches"), F.lit(0))
    per_text = lines.groupBy("path").agg(F.count("*").alias("_lines"), F.sum("submatches").alias("submatches"))
    return per_text.agg(
        total.alias("total_matches"),
        F.coalesce(F.sum("_lines"), F.lit(0)).alias("lines"),
        F.count("*").alias("texts"),
        (total > max_results).alias("truncated"),
    )
