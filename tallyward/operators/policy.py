"""Policy checks over query logs.

A log row has ``query_id, ts, agent_id, tool_name, sql_text``. The policy is a
small object of the caller, so each check is a column expression built from
literals; judging a log is one projection without any shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward import fixed
from tallyward.functions import textcols
from tallyward.functions.literals import list_map, lookup, places_of_any, text_array, text_map
from tallyward.operators.masking import mask_pii
from tallyward.plans.model import Policy, Refused

PARSED = (
    "struct<tables:array<string>,columns:array<string>,has_limit:boolean,limit_value:bigint,"
    "is_read_only:boolean,statement_count:int,joins:array<struct<left_col:string,right_col:string>>>"
)
VIOLATION = "struct<check:string,detail:string>"
RESULT = f"struct<allow:boolean,violations:array<{VIOLATION}>>"
INPUT = f"struct<agent_id:string,tool_name:string,sql:string,parsed:{PARSED}>"


def parse_sql(log: DataFrame, column: str = "sql_text", strict: bool = False) -> DataFrame:
    """Add ``parsed``: what the checks need to know about each query text.

    ``strict`` counts write words only as whole words. Shared pieces are
    columns of their own so that each pattern runs once per text.
    """
    text = F.col(column)
    staged = (
        log.withColumn("_lowered", F.lower(text))
        .withColumn("_select_list", textcols.sql_select_list(F.col("_lowered")))
        .withColumn("_digits", textcols.sql_limit_digits(F.col("_lowered")))
    )
    parsed = F.struct(
        textcols.sql_tables(F.col("_lowered")).alias("tables"),
        textcols.sql_columns(F.col("_select_list")).alias("columns"),
        (F.col("_digits") != "").alias("has_limit"),
        textcols.sql_limit(F.col("_digits")).alias("limit_value"),
        textcols.sql_read_only(text, strict).alias("is_read_only"),
        textcols.sql_statements(text).alias("statement_count"),
        textcols.sql_joins(F.col("_lowered")).alias("joins"),
    )
    # through a generator, so that a later filter on the verdict is not pushed below
    # and does not repeat the parsing
    return staged.select(*log.columns, F.explode(F.array(parsed)).alias("parsed"))


def _violation(check: str, *values: Column) -> Column:
    text = F.format_string(fixed.DETAIL_TEXT[check], *values) if values else F.lit(fixed.DETAIL_TEXT[check])
    return F.struct(F.lit(check).alias("check"), text.alias("detail"))


def violations_column(policy: Policy, agent: Column, sql: Column, parsed: Column) -> Column:
    """All failed checks of one query, in reporting order and without repeats."""
    agents = policy.agents
    known = text_array([a.name for a in agents])
    role = lookup(text_map({a.name: a.role for a in agents}), agent)
    mute = text_array([a.name for a in agents if not a.can_query])
    bundle_name = lookup(text_map({a.name: a.bundle for a in agents}), agent)
    has_sql = F.length(sql) > 0

    tables_of = list_map(
        {b.name: sorted({n for t in b.tables for n in (t.lower(), f"public.{t.lower()}")}) for b in policy.bundles}
    )
    pairs_of = list_map(
        {
            b.name: sorted(
                {
                    p
                    for j in b.links
                    for p in (
                        f"{j.left_column.lower()}={j.right_column.lower()}",
                        f"{j.right_column.lower()}={j.left_column.lower()}",
                    )
                }
            )
            for b in policy.bundles
        }
    )
    none = F.array().cast(f"array<{VIOLATION}>")
    in_scope = has_sql & bundle_name.isNotNull()
    allowed_tables = F.coalesce(lookup(tables_of, bundle_name), text_array([]))
    allowed_pairs = F.coalesce(lookup(pairs_of, bundle_name), text_array([]))

    def one(check: str, failed: Column, *values: Column) -> Column:
        return F.when(failed, F.array(_violation(check, *values))).otherwise(none)

    outside = F.transform(
        F.sort_array(F.array_except(parsed["tables"], allowed_tables)),
        lambda t: _violation("bundle_scope", t, bundle_name),
    )
    unlisted = F.filter(
        parsed["joins"],
        lambda j: ~F.array_contains(allowed_pairs, F.concat_ws("=", j["left_col"], j["right_col"])),
    )
    odd_joins = F.transform(
        F.sort_array(F.array_distinct(unlisted)),
        lambda j: _violation("join_allowlist", j["left_col"], j["right_col"]),
    )
    lowered = F.lower(sql)
    star = lowered.rlike(fixed.SELECT_STAR_PATTERN)
    bare_tables = F.transform(parsed["tables"], lambda t: F.regexp_replace(t, r"^public\.", ""))
    listed = [
        {"t": table, "c": column, "lt": table.lower(), "lc": column.lower()}
        for table, columns in sorted(policy.pii.items())
        for column in sorted(columns)
    ]
    named = textcols.names_in(textcols.identifiers(lowered), lowered, [p["lc"] for p in listed])
    personal = F.from_json(F.lit(json.dumps(listed)), "array<struct<t:string,c:string,lt:string,lc:string>>")

    def blocked(of: Column) -> Column:
        named_at = places_of_any([p["lc"] for p in listed], of["names"])
        queried_at = places_of_any([p["lt"] for p in listed], of["tables"])
        starred_at = F.when(of["star"], queried_at).otherwise(F.array().cast("array<int>"))
        hit = F.sort_array(F.array_union(named_at, starred_at))
        return F.transform(hit, lambda at: _violation("pii_check", F.get(personal, at)["t"], F.get(personal, at)["c"]))

    # what a query names is bound once, or the words would be taken again for every personal column
    of_query = F.struct(named.alias("names"), star.alias("star"), bare_tables.alias("tables"))
    # most queries name no personal column and end here
    pii_hits = F.when((F.size(named) > 0) | star, textcols.bound(of_query, blocked)).otherwise(none) if listed else none

    count, top = parsed["statement_count"], F.lit(policy.max_rows)
    found = {
        "authenticate": one("authenticate", ~F.array_contains(known, agent), agent),
        "can_query": one("can_query", F.array_contains(mute, agent), agent, role),
        "read_only": one("read_only", has_sql & ~parsed["is_read_only"]),
        "bundle_scope": F.when(in_scope & (F.size(parsed["tables"]) > 0), outside).otherwise(none),
        "join_allowlist": F.when(in_scope & (F.size(parsed["joins"]) > 0), odd_joins).otherwise(none),
    }
    if policy.single_statement:
        found["single_statement"] = one("single_statement", has_sql & (count > 1), count)
    if not policy.allow_execute:
        found["execution_permission"] = one("execution_permission", has_sql)
    if policy.pii_mode == "block":
        found["pii_check"] = F.when(has_sql, pii_hits).otherwise(none)
    if policy.enforce_limit:
        limit, limited = parsed["limit_value"], parsed["has_limit"]
        found["limit_check"] = one("limit_check", has_sql & ~limited, top)
        found["limit_value"] = one("limit_value", has_sql & limited & (limit > top), limit, top)
    return F.concat(*[found[check] for check in fixed.CHECK_ORDER if check in found])


def with_verdict(df: DataFrame, violations: Column) -> DataFrame:
    """Add ``violations, allow, reason, blocked_columns``."""
    blocked = F.transform(
        F.filter("violations", lambda v: v["check"] == "pii_check"),
        lambda v: F.regexp_replace(v["detail"], "^PII column | is blocked$", ""),
    )
    return (
        df.withColumn("violations", violations)
        .withColumn("allow", F.size("violations") == 0)
        .withColumn("reason", F.try_element_at("violations", F.lit(1))["detail"])
        .withColumn("blocked_columns", blocked)
    )


def evaluate(log: DataFrame, policy: Policy, strict: bool = False) -> DataFrame:
    """Judge every query of a log."""
    parsed = parse_sql(log.withColumn("sql_text", F.coalesce("sql_text", F.lit(""))), strict=strict)
    return with_verdict(
        parsed, violations_column(policy, F.col("agent_id"), F.col("sql_text"), F.col("parsed"))
    )


def personal_columns_used(log: DataFrame, personal: DataFrame) -> DataFrame:
    """``query_id, table_name, column_name`` of a log against a table of personal columns.

    ``personal`` (table_name, column_name) may be of any size, for instance
    what ``pii_columns`` finds in a catalog: the distinct words of each query
    are joined with it, and the queried tables where a query selects ``*``.
    """
    text = F.lower(F.coalesce("sql_text", F.lit("")))
    words = log.select("query_id", text.alias("_text")).select("query_id", "_text", textcols.identifiers(F.col("_text")).alias("_words"))
    keyed = personal.select("table_name", "column_name").distinct()
    named = words.select("query_id", F.explode("_words").alias("_word")).join(
        keyed.withColumn("_word", F.lower("column_name")), "_word"
    )
    bare = F.transform(textcols.sql_tables(F.col("_text")), lambda t: F.regexp_replace(t, r"^public\.", ""))
    starred = words.filter(F.col("_text").rlike(fixed.SELECT_STAR_PATTERN)).select("query_id", F.explode(F.array_distinct(bare)).alias("_table"))
    whole = starred.join(keyed.withColumn("_table", F.lower("table_name")), "_table")
    columns = ["query_id", "table_name", "column_name"]
    return named.select(*columns).unionByName(whole.select(*columns)).distinct()


def violation_rows(evaluated: DataFrame) -> DataFrame:
    """``query_id, check, detail``: one row per failed check."""
    return evaluated.select("query_id", F.inline("violations"))


def decision_log(evaluated: DataFrame, revision: str) -> DataFrame:
    """One row per judged query, with input and result as JSON for later replay."""
    given = F.struct("agent_id", "tool_name", F.col("sql_text").alias("sql"), "parsed")
    return evaluated.select(
        F.col("query_id").alias("decision_id"),
        "ts",
        "agent_id",
        "tool_name",
        F.when(F.length("sql_text") > 0, F.sha2("sql_text", 256)).alias("sql_hash"),
        F.to_json(given).alias("input"),
        F.to_json(F.struct("allow", "violations")).alias("result"),
        F.col("allow").alias("allowed"),
        F.lit(revision).alias("revision"),
    )


def replay(log: DataFrame, policy: Policy) -> DataFrame:
    """Judge logged inputs again; ``replay_*`` columns stand beside the original verdict."""
    given = log.select("*", F.explode(F.array(F.from_json("input", INPUT))).alias("_in"))
    again = violations_column(
        policy,
        F.col("_in.agent_id"),
        F.coalesce("_in.sql", F.lit("")),
        F.col("_in.parsed"),
    )
    return (
        given.withColumn("replay_violations", again)
        .withColumn("replay_allowed", F.size("replay_violations") == 0)
        .withColumn("original_violations", F.from_json("result", RESULT)["violations"])
        .withColumn("changed", F.col("allowed") != F.col("replay_allowed"))
        .drop("_in")
    )


def _newest(log: DataFrame, since: str | None, limit: int | None) -> DataFrame:
    if since is not None:
        log = log.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if limit is not None:
        log = log.orderBy(F.col("ts").desc(), F.col("decision_id").desc()).limit(limit)
    return log


def policy_drift(log: DataFrame, policy: Policy, since: str | None = None, limit: int | None = 100) -> DataFrame:
    """One row: decisions replayed, how many changed and the rate; ``limit=None`` takes the whole log."""
    return drift_rate(replay(_newest(log, since, limit), policy), F.count("*"), F.count_if("changed"))


def drift_rate(judged: DataFrame, total: Column, changed: Column) -> DataFrame:
    """``total, changed, drift_rate`` from aggregates over ``judged``."""
    rate = F.format_string("%.1f%%", F.coalesce(changed * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)))
    return judged.agg(total.alias("total"), changed.alias("changed"), rate.alias("drift_rate"))


def drift_examples(
    log: DataFrame, policy: Policy, since: str | None = None, limit: int | None = 100, examples: int = 10
) -> DataFrame:
    """The newest changed decisions."""
    judged = replay(_newest(log, since, limit), policy).filter("changed")
    return (
        judged.select("decision_id", "ts", "agent_id", "allowed", "replay_allowed")
        .orderBy(F.col("ts").desc(), F.col("decision_id").desc())
        .limit(examples)
    )


def governed_sql(spark: SparkSession, sql: str, agent: str, policy: Policy, strict: bool = False) -> DataFrame:
    """Run one query if the policy allows it and mask its result."""
    asked = spark.range(1).select(
        F.lit("0").alias("query_id"), F.lit(agent).alias("agent_id"), F.lit(sql).alias("sql_text")
    )
    verdict = evaluate(asked, policy, strict).first()
    if not verdict["allow"]:
        raise Refused(
            "governance_blocked",
            verdict["reason"],
            checks=[v["check"] for v in verdict["violations"]],
            blocked_columns=list(verdict["blocked_columns"]),
        )
    return mask_pii(spark.sql(sql), policy.pii_names)
