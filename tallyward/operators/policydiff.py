"""Replaying only the decisions that a change of policy can touch.

``decision_index`` lists once what each logged decision depends on: its agent,
tables, column pairs, words, and a few properties of its text. ``changes`` tells
which of these a new policy treats differently from the one the log was judged
by. A decision that depends on none of them keeps its verdict, so only the rest
is judged again. What is touched may be more than what changes, never less.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward import fixed
from tallyward.functions import textcols
from tallyward.operators.policy import INPUT, _newest, drift_rate, replay
from tallyward.plans.model import Policy

ANY_TEXT = ("text", "any")


def decision_index(log: DataFrame) -> DataFrame:
    """``kind, element, decision_id``: what each decision of a log depends on.

    To be written once beside the log, as ``sorted_index`` gives it.
    """
    given = log.select("decision_id", F.explode(F.array(F.from_json("input", INPUT))).alias("_in"))
    sql = F.lower(F.coalesce("_in.sql", F.lit("")))
    parsed = F.col("_in.parsed")
    bare = F.array_distinct(F.transform(parsed["tables"], lambda t: F.regexp_replace(t, r"^public\.", "")))
    none = F.array().cast("array<string>")

    def listed(kind: str, elements: Column) -> Column:
        return F.transform(F.coalesce(elements, none), lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("element")))

    def when(test: Column, element: str) -> Column:
        return F.when(test, F.lit(element))

    properties = F.array_compact(
        F.array(
            when(F.length(sql) > 0, ANY_TEXT[1]),
            when(parsed["statement_count"] > 1, "several statements"),
            when(parsed["has_limit"], "limit"),
            when(~parsed["has_limit"], "no limit"),
        )
    )
    elements = F.concat(
        listed("agent", F.array(F.coalesce("_in.agent_id", F.lit("")))),
        listed("table", F.array_distinct(parsed["tables"])),
        listed("pair", F.array_distinct(F.transform(parsed["joins"], lambda j: F.concat_ws("=", j["left_col"], j["right_col"])))),
        listed("word", textcols.identifiers(sql)),
        listed("star", F.when(sql.rlike(fixed.SELECT_STAR_PATTERN), bare)),
        listed(ANY_TEXT[0], properties),
    )
    return given.select("decision_id", F.inline(elements)).select("kind", "element", "decision_id")


#: One file of the index holds the elements of so many decisions on average, and an element comes in shares of the other number.
FILE_DECISIONS, SHARE_DECISIONS = 100_000, 250_000


def sorted_index(log: DataFrame) -> DataFrame:
    """``decision_index`` of a written log, sorted by kind and element in every partition.

    A common element, such as a word that every query has, holds a row of nearly
    every decision, so each element is dealt out in shares of bounded size. The
    rows go by hash: ranges would take the log apart a second time to draw them.
    """
    decisions = log.count()
    share = F.pmod(F.xxhash64("decision_id"), F.lit(1 + decisions // SHARE_DECISIONS))
    dealt = decision_index(log).repartition(1 + decisions // FILE_DECISIONS, "kind", "element", share)
    return dealt.sortWithinPartitions("kind", "element")


def _personal(pairs: set[tuple[str, str]]) -> set[tuple[str, str]]:
    out = set()
    for table, column in pairs:
        # a name that is no plain word is searched for in the text itself
        out |= {("word", column.lower()) if re.fullmatch("[a-z0-9_]+", column.lower()) else ANY_TEXT, ("star", table.lower())}
    return out


def changes(old: Policy, new: Policy) -> list[tuple[str, str]]:
    """``(kind, element)`` of everything that the two policies treat differently."""
    out: set[tuple[str, str]] = set()
    before, after = ({a.name: a for a in p.agents} for p in (old, new))
    out |= {("agent", name) for name in before.keys() | after.keys() if before.get(name) != after.get(name)}
    for name in {b.name for p in (old, new) for b in p.bundles}:
        mine = [p.bundle(name) for p in (old, new)]
        tables = [{t.lower() for t in b.tables} if b else set() for b in mine]
        for table in tables[0] ^ tables[1]:
            out |= {("table", table), ("table", f"public.{table}")}
        pairs = [{frozenset((j.left_column.lower(), j.right_column.lower())) for j in b.links} if b else set() for b in mine]
        for pair in pairs[0] ^ pairs[1]:
            first, last = min(pair), max(pair)
            out |= {("pair", f"{first}={last}"), ("pair", f"{last}={first}")}
    personal = [{(t, c) for t, columns in p.pii.items() for c in columns} for p in (old, new)]
    out |= _personal(personal[0] | personal[1] if old.pii_mode != new.pii_mode else personal[0] ^ personal[1])
    if (old.max_rows, old.enforce_limit) != (new.max_rows, new.enforce_limit):
        out |= {("text", "limit"), ("text", "no limit")}
    if old.single_statement != new.single_statement:
        out.add(("text", "several statements"))
    if old.allow_execute != new.allow_execute:
        out.add(ANY_TEXT)
    return sorted(out)


def touched(log: DataFrame, index: DataFrame, old: Policy, new: Policy) -> DataFrame:
    """The rows of a log judged by ``old`` that ``new`` may judge otherwise."""
    elements = changes(old, new)
    if not elements:
        return log.filter(F.lit(False))
    # the literal elements reach the scan of the index as filters
    kinds = {kind: [e for k, e in elements if k == kind] for kind, _ in elements}
    hit = F.lit(False)
    for kind, names in kinds.items():
        hit = hit | ((F.col("kind") == kind) & F.col("element").isin(names))
    found = index.filter(hit).select("decision_id").distinct()
    return log.join(found, "decision_id", "left_semi")


def replay_changed(log: DataFrame, index: DataFrame, old: Policy, new: Policy) -> DataFrame:
    """``policy.replay`` of the decisions that the change can touch."""
    return replay(touched(log, index, old, new), new)


def policy_drift(
    log: DataFrame, index: DataFrame, old: Policy, new: Policy, since: str | None = None, limit: int | None = 100
) -> DataFrame:
    """``policy.policy_drift`` of a log judged by ``old``, judging only what the change can touch."""
    asked = _newest(log, since, limit)
    judged = replay_changed(asked, index, old, new)
    counts = asked.agg(F.count("*").alias("total"), F.lit(0).cast("bigint").alias("changed"))
    counts = counts.unionByName(judged.agg(F.lit(0).cast("bigint").alias("total"), F.count_if("changed").alias("changed")))
    return drift_rate(counts, F.sum("total"), F.sum("changed"))


def drift_examples(
    log: DataFrame, index: DataFrame, old: Policy, new: Policy, since: str | None = None, limit: int | None = 100, examples: int = 10
) -> DataFrame:
    """``policy.drift_examples`` of a log judged by ``old``, judging only what the change can touch."""
    judged = replay_changed(_newest(log, since, limit), index, old, new).filter("changed")
    return (
        judged.select("decision_id", "ts", "agent_id", "allowed", "replay_allowed")
        .orderBy(F.col("ts").desc(), F.col("decision_id").desc())
        .limit(examples)
    )
