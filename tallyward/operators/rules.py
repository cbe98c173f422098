"""Business rules checked over answers: query text, result text, and sessions.

An answer row has ``answer_id, agent_id, sql_text, result_text``. Rules are a
small list of the caller; each becomes column expressions on the row, so a
table of answers is checked in one projection.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward import fixed
from tallyward.functions import textcols
from tallyward.functions.literals import list_map, lookup, places_of_any, text_array, text_map
from tallyward.plans.model import Policy


def holds(lowered: Column, token: str) -> Column:
    return F.contains(lowered, F.lit(token.lower()))


@dataclass(frozen=True)
class Tokens:
    """Token conditions on a text; an empty condition always holds."""

    require_all: tuple[str, ...] = ()
    require_any: tuple[str, ...] = ()
    forbid_any: tuple[str, ...] = ()

    def test(self, lowered: Column) -> Column:
        parts = [holds(lowered, t) for t in self.require_all]
        if self.require_any:
            parts.append(reduce(or_, [holds(lowered, t) for t in self.require_any]))
        parts += [~holds(lowered, t) for t in self.forbid_any]
        return reduce(and_, parts, F.lit(True))

    def why_not(self, lowered: Column) -> Column:
        """The first condition that does not hold, as text."""
        reasons = [
            F.when(~holds(lowered, t), F.lit(f'required token "{t}" is missing')) for t in self.require_all
        ]
        if self.require_any:
            none = ~reduce(or_, [holds(lowered, t) for t in self.require_any])
            reasons.append(F.when(none, F.lit(f"none of these tokens occurs: {', '.join(self.require_any)}")))
        reasons += [F.when(holds(lowered, t), F.lit(f'forbidden token "{t}" occurs')) for t in self.forbid_any]
        return F.coalesce(*reasons, F.lit(""))


@dataclass(frozen=True)
class Check:
    """``kind`` is sql_pattern, text_pattern, pii_columns, query_result or manual."""

    kind: str
    applies_when: Tokens | None = None
    require: Tokens | None = None
    message: str | None = None
    sql: str | None = None
    expect: tuple[str, str, object] | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    applies_to: tuple[str, ...] = ()
    check: Check | None = None
    guidance: str = ""

    @property
    def method(self) -> str:
        if self.check is None:
            return "none"
        return "manual" if self.check.kind == "query_result" else self.check.kind

    @property
    def tables(self) -> list[str]:
        return sorted({ref.split(".")[0].lower() for ref in self.applies_to} - {""})


PASS, FAIL, SKIP, MANUAL = "pass", "fail", "not_applicable", "manual"


def _identifier_hits(lowered_sql: Column, names: list[str]) -> Column:
    lowered = F.coalesce(lowered_sql, F.lit(""))
    found = textcols.names_in(textcols.identifiers(lowered), lowered, [n.lower() for n in names])
    at = places_of_any([n.lower() for n in names], found)
    listed = F.from_json(F.lit(json.dumps(names)), "array<string>")
    return F.transform(at, lambda i: F.get(listed, i))


def rule_status(rule: Rule, sql: Column, text: Column, pii_names: list[str]) -> Column:
    """Status of one rule on the lower-cased query and result text."""
    check = rule.check
    if check is None or check.kind in ("manual", "query_result"):
        return F.lit(MANUAL)
    if check.kind == "pii_columns":
        if not pii_names:
            return F.lit(SKIP)
        return F.when(F.size(_identifier_hits(sql, pii_names)) > 0, FAIL).otherwise(PASS)
    candidate = sql if check.kind == "sql_pattern" else text
    gate = check.applies_when.test(candidate) if check.applies_when else F.lit(True)
    required = check.require.test(candidate) if check.require else F.lit(True)
    return F.when(candidate.isNull(), SKIP).when(~gate, SKIP).when(required, PASS).otherwise(FAIL)


def rule_detail(rule: Rule, sql: Column, text: Column, pii_names: list[str]) -> Column:
    """Why a rule failed, or what is left to review."""
    check = rule.check
    if check is None or check.kind in ("manual", "query_result"):
        return F.lit((check.message if check else None) or "needs review")
    if check.message:
        return F.lit(check.message)
    if check.kind == "pii_columns":
        return F.concat(F.lit("personal columns: "), F.array_join(_identifier_hits(sql, pii_names), ", "))
    return (check.require or Tokens()).why_not(sql if check.kind == "sql_pattern" else text)


def in_scope(rule: Rule, query_tables: Column | None, lowered_text: Column) -> Column:
    """Whether a table of the rule is queried or its name occurs in the answer text."""
    tests = []
    for table in rule.tables:
        if query_tables is not None:
            tests.append(F.array_contains(query_tables, table))
        tests.append(F.coalesce(holds(lowered_text, table), F.lit(False)))
    return reduce(or_, tests, F.lit(False))


def _staged(answers: DataFrame) -> DataFrame:
    """Answers with ``_sql`` and ``_text`` in lower case and ``_tables``, each worked out once."""
    names = textcols.sql_tables(F.coalesce("_sql", F.lit("")))
    return (
        answers.withColumn("_sql", F.lower("sql_text"))
        .withColumn("_text", F.lower("result_text"))
        .withColumn("_tables", F.transform(names, lambda t: F.regexp_replace(t, r"^public\.", "")))
    )


def check_rules(answers: DataFrame, rules: list[Rule], pii_names: list[str]) -> DataFrame:
    """``answer_id, rule, severity, method, status, detail`` for every answer and rule."""
    sql, text = F.col("_sql"), F.col("_text")
    staged = _staged(answers).select(
        "answer_id", "_sql", "_text", *[rule_status(r, sql, text, pii_names).alias(f"_s{i}") for i, r in enumerate(rules)]
    )
    results = []
    for i, rule in enumerate(rules):
        status = F.col(f"_s{i}")
        detail = F.when(status.isin(FAIL, MANUAL), rule_detail(rule, sql, text, pii_names))
        results.append(
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.method).alias("method"),
                status.alias("status"),
                detail.cast("string").alias("detail"),
            )
        )
    return staged.select("answer_id", F.inline(F.array(*results)))


def rules_in_scope(answers: DataFrame, rules: list[Rule]) -> DataFrame:
    """``answer_id, rule`` for the rules that concern each answer."""
    names = [F.when(in_scope(r, F.col("_tables"), F.col("_text")), F.lit(r.name)) for r in rules]
    return _staged(answers).select("answer_id", F.explode(F.array_compact(F.array(*names))).alias("rule"))


def _names(rules: list[Rule], wanted: str, value=lambda r: r.name) -> Column:
    """Names of the rules whose staged status is ``wanted``."""
    parts = [F.when(F.col(f"_s{i}") == wanted, F.lit(value(r))) for i, r in enumerate(rules)]
    return F.array_compact(F.array(*parts)) if parts else text_array([])


def verify_answers(answers: DataFrame, rules: list[Rule], policy: Policy) -> DataFrame:
    """``answer_id, agent_id, verified``, the rules by result, ``out_of_scope`` and ``warnings``.

    Covers the caller's bundle and every error rule in scope. An answer that
    no rule concerns is verified unless it left its bundle.
    """
    strict = [r for r in rules if r.severity == "error"]
    bundle = lookup(text_map({a.name: a.bundle for a in policy.agents}), F.col("agent_id"))
    allowed = lookup(list_map({b.name: [t.lower() for t in b.tables] for b in policy.bundles}), bundle)
    statuses = [
        F.when(
            in_scope(r, F.col("_tables"), F.col("_text")),
            rule_status(r, F.col("_sql"), F.col("_text"), policy.pii_names),
        ).alias(f"_s{i}")
        for i, r in enumerate(strict)
    ]
    staged = _staged(answers).select("answer_id", "agent_id", "_tables", allowed.alias("_allowed"), *statuses)
    outside = F.coalesce(F.array_except("_tables", "_allowed"), text_array([]))
    return (
        staged.select(
            "answer_id",
            "agent_id",
            outside.alias("out_of_scope"),
            _names(strict, PASS).alias("passed_rules"),
            _names(strict, FAIL).alias("failed_rules"),
            _names(strict, MANUAL).alias("manual_rules"),
            _names(strict, FAIL, lambda r: r.guidance).alias("warnings"),
        )
        .withColumn("verified", (F.size("out_of_scope") == 0) & (F.size("failed_rules") == 0))
        .withColumn(
            "no_rule", (F.size("passed_rules") + F.size("failed_rules") + F.size("manual_rules")) == 0
        )
    )


def consistency(
    answers: DataFrame, rules: list[Rule], pii_names: list[str], applicable: list[str] | None = None
) -> DataFrame:
    """Answer text against all rules, or against a given list without scoping."""
    chosen = [r for r in rules if applicable is None or r.name in applicable]
    text, no_sql = F.col("_text"), F.lit(None).cast("string")
    statuses = []
    for i, rule in enumerate(chosen):
        status = rule_status(rule, no_sql, text, pii_names)
        if applicable is None:
            status = F.when(in_scope(rule, None, text), status)
        statuses.append(status.alias(f"_s{i}"))
    staged = answers.withColumn("_text", F.lower("result_text")).select("answer_id", *statuses)
    return staged.select(
        "answer_id",
        F.lit(len(chosen)).cast("bigint").alias("rules_checked"),
        _names(chosen, FAIL).alias("violated_rules"),
        _names(chosen, MANUAL).alias("manual_rules"),
    ).withColumn("consistent", F.size("violated_rules") == 0)


def match_rules(contexts: DataFrame, rules: list[Rule]) -> DataFrame:
    """``context_id, rule, matched_on``: what in a context each rule matched.

    A context has ``tables`` and ``metric_refs`` (arrays) and ``sql_text``. A
    plain text match counts only while no table or metric has matched.
    """
    tables = F.transform(
        F.coalesce("tables", text_array([])), lambda t: F.lower(F.element_at(F.split(t, r"\."), -1))
    )
    metrics = F.transform(F.coalesce("metric_refs", text_array([])), F.lower)
    sql = F.lower(F.coalesce("sql_text", F.lit("")))
    found = []
    for rule in rules:
        parts, stronger = [], F.lit(False)
        for target in (t.lower() for t in rule.applies_to):
            table = target.split(".")[0]
            by_table = F.array_contains(tables, table)
            by_metric = F.array_contains(metrics, target)
            stronger = stronger | by_table | by_metric
            in_text = (sql != "") & (F.contains(sql, F.lit(table)) | F.contains(sql, F.lit(target)))
            parts += [
                F.when(by_table, F.lit(f"table: {table}")),
                F.when(by_metric, F.lit(f"metric: {target}")),
                F.when(in_text & ~stronger, F.lit(f"sql_text: {target}")),
            ]
        matched = F.array_compact(F.array(*parts)) if parts else text_array([])
        found.append(F.struct(F.lit(rule.name).alias("rule"), matched.alias("matched_on")))
    rows = contexts.select("context_id", F.inline(F.array(*found)))
    return rows.filter(F.size("matched_on") > 0)


def confidence(
    sessions: DataFrame,
    outcomes: DataFrame,
    sla_tables: list[str],
    error_rules: int,
    domain_agents: int,
) -> DataFrame:
    """Composite score per session row.

    ``sessions`` has ``session_id`` and the arrays ``tables_used,
    rules_checked, agents_consulted``; precedents are the outcomes of all
    other sessions.
    """
    own = outcomes.groupBy(F.col("session_id").alias("_sid")).agg(F.count("*").alias("_own"))
    all_outcomes = outcomes.agg(F.count("session_id")).scalar()
    joined = sessions.join(own, F.col("session_id") == F.col("_sid"), "left")
    others = all_outcomes - F.coalesce("_own", F.lit(0))
    bare = F.transform("tables_used", lambda t: F.regexp_replace(t, r"^public\.", ""))
    under_sla = F.arrays_overlap(bare, text_array(sla_tables))
    precedent = F.lit(fixed.PRECEDENT_NONE)
    for above, level in reversed(fixed.PRECEDENT_LEVELS):
        precedent = F.when(others > above, level).otherwise(precedent)
    scored = joined.select(
        "session_id",
        F.when(under_sla, fixed.SLA_FRESHNESS).otherwise(1.0).alias("freshness"),
        (F.least(F.size("rules_checked") / F.lit(float(error_rules)), F.lit(1.0)) if error_rules else F.lit(1.0)).alias("rules"),
        (F.size("agents_consulted") / F.lit(float(domain_agents)) if domain_agents else F.lit(1.0)).alias("coverage"),
        precedent.alias("precedent"),
    )
    total = reduce(lambda a, b: a + b, [F.col(n) * w for n, w in fixed.CONFIDENCE_WEIGHTS.items()])
    level = F.lit("low")
    for least, name in reversed(fixed.SCORE_LEVELS):
        level = F.when(F.col("_total") >= least, name).otherwise(level)
    return (
        scored.withColumn("_total", total)
        .withColumn("score", F.floor(F.col("_total") * 100 + 0.5) / 100)
        .withColumn("confidence", level)
        .drop("_total")
    )
