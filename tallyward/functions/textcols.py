"""Column expressions over query text and free text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyward import fixed
from tallyward.functions.literals import places

#: Up to so many names are compared with all words of a text.
FEW_NAMES = 16


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often and however deep ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sql_tables(lowered: Column) -> Column:
    """Distinct names after FROM or JOIN in lower-cased text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(fixed.TABLE_PATTERN), F.lit(1)))


def identifiers(lowered: Column) -> Column:
    """The distinct words of lower-cased text that could be names."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9_]+"), F.lit(0)))


def names_in(words: Column, lowered: Column, names: list[str]) -> Column:
    """Those of ``names`` (lower case) that occur as whole words.

    The distinct words of a text are taken once. A few plain names are
    intersected with them; in many names each word is looked up by its hash, so
    that their number does not matter. Only names with other characters are
    searched for.
    """
    plain = sorted({n for n in names if re.fullmatch("[a-z0-9_]+", n)})
    odd = sorted(set(names) - set(plain))
    if len(plain) > FEW_NAMES:
        find = places(plain)
        found = F.filter(words, lambda w: F.size(find(w)) > 0)
    else:
        found = F.array_intersect(words, F.from_json(F.lit(json.dumps(plain)), "array<string>"))
    if not odd:
        return found
    hits = [F.when(lowered.rlike(word_pattern([n])), F.lit(n)) for n in odd]
    return F.concat(found, F.array_compact(F.array(*hits)))


def sql_select_list(lowered: Column) -> Column:
    """The text between the first SELECT and its FROM; empty if there is none."""
    return F.regexp_extract(lowered, fixed.SELECT_LIST_PATTERN, 1)


def sql_columns(select_list: Column) -> Column:
    """Output names of a select list; empty for ``*`` or no select.

    A name is the last word before a comma or the end, without quotes.
    """
    last_words = F.regexp_extract_all(select_list, F.lit(fixed.LAST_WORD_PATTERN), F.lit(1))
    names = F.filter(F.transform(last_words, lambda w: F.translate(w, "\"'", "")), lambda n: n != "")
    none = F.array().cast("array<string>")
    return F.when((select_list == "") | (F.trim(select_list) == "*"), none).otherwise(names)


def sql_joins(lowered: Column) -> Column:
    """Column pairs of ``JOIN x y ON a = b`` without their first qualifier."""
    pattern = F.lit(fixed.JOIN_PATTERN)
    left = F.regexp_extract_all(lowered, pattern, F.lit(1))
    right = F.regexp_extract_all(lowered, pattern, F.lit(2))

    def bare(name: Column) -> Column:
        return F.regexp_replace(name, r"^(.*?)\w+\.(.*)$", "$1$2")

    pairs = F.zip_with(
        left, right, lambda a, b: F.struct(bare(a).alias("left_col"), bare(b).alias("right_col"))
    )
    none = F.array().cast("array<struct<left_col:string,right_col:string>>")
    return F.when(F.contains(lowered, F.lit("join")), pairs).otherwise(none)


def sql_limit_digits(lowered: Column) -> Column:
    """The digits after the first LIMIT; empty if there is none."""
    return F.regexp_extract(lowered, fixed.LIMIT_PATTERN, 1)


def sql_limit(digits: Column) -> Column:
    # more digits than a long holds still mean a limit, and one above any ceiling
    return F.when(digits != "", F.coalesce(digits.try_cast("bigint"), F.lit(2**63 - 1)))


def sql_read_only(text: Column, strict: bool = False) -> Column:
    """True when no write word occurs.

    By default a word counts anywhere in the text, so ``created_at`` trips
    CREATE; ``strict`` asks for whole words.
    """
    if strict:
        return ~text.rlike("(?i)" + word_pattern(fixed.WRITE_WORDS))
    upper = F.upper(text)
    return ~reduce(or_, [F.contains(upper, F.lit(w)) for w in fixed.WRITE_WORDS])


def sql_statements(text: Column) -> Column:
    """Pieces between semicolons that hold more than white space."""
    several = F.regexp_count(text, F.lit(r"[^;\s][^;]*"))
    return F.when(F.contains(text, F.lit(";")), several).otherwise(text.rlike(r"\S").cast("int"))


def word_pattern(words: list[str]) -> str:
    """Any of ``words`` between characters that are no ASCII letter, digit or underscore.

    The character before is tested last, so that most places in a text are
    passed over after one comparison.
    """
    longest_first = [re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w))]
    return "|".join(rf"{w}(?<![A-Za-z0-9_]{w})(?![A-Za-z0-9_])" for w in longest_first)


def redact_words(text: Column, words: list[str]) -> Column:
    if not words:
        return text
    return F.regexp_replace(text, "(?i)" + word_pattern(words), fixed.REDACTED)


def keywords(text: Column, longer_than: int = 3, first: int = 5) -> Column:
    """The first few lower-cased words longer than ``longer_than`` characters."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > longer_than)
    return F.slice(words, 1, first)
