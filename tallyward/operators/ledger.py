"""The decision ledger: proposals, approvals, actions, outcomes, findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward import fixed
from tallyward.functions.literals import list_map, lookup, text_map
from tallyward.functions.textcols import redact_words
from tallyward.plans.model import Policy
from tallyward.plans.ordered import number_rows


def missing_evidence(
    decisions: DataFrame,
    id_column: str,
    evidence: dict[str, tuple[str, DataFrame, str]],
) -> DataFrame:
    """``id, kind, missing``: cited ids that do not exist.

    ``evidence`` maps a kind to ``(array column, existing rows, their key)``.
    """
    found = []
    for kind, (column, existing, key) in evidence.items():
        cited = decisions.select(id_column, F.explode(F.array_distinct(column)).alias("_ref"))
        known = existing.select(F.col(key).alias("_key")).distinct()
        dangling = cited.join(known, F.col("_ref") == F.col("_key"), "left_anti")
        found.append(
            dangling.select(id_column, F.lit(kind).alias("kind"), F.col("_ref").cast("string").alias("missing"))
        )
    return reduce(DataFrame.unionByName, found)


def classify_actions(
    actions: DataFrame, risk_of: dict[str, str], approval_of: dict[str, str], column: str = "action_type"
) -> DataFrame:
    """Add ``risk_class`` and ``approval``; an unlisted action is high risk."""
    risk = F.coalesce(lookup(text_map(risk_of), F.col(column)), F.lit(fixed.DEFAULT_RISK))
    approval = F.coalesce(lookup(text_map(approval_of), F.col("risk_class")), F.lit(fixed.DEFAULT_APPROVAL))
    return actions.withColumn("risk_class", risk).withColumn("approval", approval)


def permission_violations(log: DataFrame, permissions: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Rows whose actor may not ``propose``, ``approve`` or ``execute`` their risk class.

    ``log`` has ``actor, verb, risk_class``. ``auto``, ``human:`` actors and
    actors without an entry pass.
    """
    may = list_map({f"{a}|{v}": classes for a, verbs in permissions.items() for v, classes in verbs.items()})
    allowed = lookup(may, F.concat_ws("|", "actor", "verb"))
    exempt = (F.col("actor") == "auto") | F.col("actor").startswith("human:")
    return log.withColumn("allowed_classes", F.array_join(allowed, ",")).filter(
        ~exempt & allowed.isNotNull() & ~F.array_contains(allowed, F.col("risk_class"))
    )


def proposal_status(
    proposals: DataFrame, approvals: DataFrame, actions: DataFrame, outcomes: DataFrame
) -> DataFrame:
    """Current status of each proposal and whether it was executed unapproved.

    The ledgers are reduced to one row per proposal before they are joined.
    """
    approved = approvals.groupBy("proposal_id").agg(
        F.max_by("approved", F.struct("created_at", "approval_id")).alias("_approved"),
        F.min(F.when(F.col("approved"), F.col("created_at"))).alias("_approved_at"),
    )
    acted = actions.groupBy("proposal_id").agg(F.min("created_at").alias("_acted_at"))
    closed = (
        outcomes.select(F.explode("evidence_proposal_ids").alias("proposal_id"))
        .distinct()
        .withColumn("_closed", F.lit(True))
    )
    joined = proposals.join(approved, "proposal_id", "left").join(acted, "proposal_id", "left").join(
        closed, "proposal_id", "left"
    )
    status = (
        F.when(F.col("_closed"), "completed")
        .when(F.col("_acted_at").isNotNull(), "executed")
        .when(F.col("_approved"), "approved")
        .when(~F.col("_approved"), "rejected")
        .otherwise("pending")
    )
    early = F.col("_acted_at").isNotNull() & (
        F.col("_approved_at").isNull() | (F.col("_approved_at") > F.col("_acted_at"))
    )
    return joined.select(*proposals.columns, status.alias("status"), early.alias("executed_unapproved"))


def append_once(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Existing rows plus the first new row of every key not stored yet.

    The first row per key is an aggregate, so repeats of one key are combined
    before the shuffle.
    """
    whole = F.struct(*[F.col(c) for c in new.columns])
    first = new.groupBy(key).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select("_row.*")
    fresh = first.join(existing.select(F.col(key).alias("_stored")), F.col(key) == F.col("_stored"), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def original_rows(replays: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Give each replayed row the columns of the row stored under its key."""
    kept = stored.select(key, *[F.col(c).alias(f"stored_{c}") for c in columns])
    return replays.join(kept, key, "left")


def findings_digest(
    findings: DataFrame, agent: str | None = None, split: bool = False
) -> DataFrame:
    """Findings of every session numbered in time order, one row each."""
    chosen = findings if agent is None else findings.filter(F.col("agent_id") == agent)
    rows = chosen.filter(F.col("session_id").isNotNull())
    return number_rows(rows, "session_id", ["created_at", "finding_id"], "created_at", split).drop("prev")


def findings_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("session_id").agg(
        F.count("*").alias("findings"),
        F.count_distinct("agent_id").alias("agents"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )


#: Ledger rows that one task of a whole audit joins.
TASK_ROWS = 500_000


def audit_decisions(
    outcomes: DataFrame,
    proposals: DataFrame,
    approvals: DataFrame,
    actions: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    confidence: str | None = None,
    agent: str | None = None,
    limit: int | None = 20,
) -> DataFrame:
    """Newest decisions with their proposals, approvals and actions, one row per combination.

    Equal approvals and equal actions of a proposal are counted first, and
    ``copies`` tells how many ledger combinations a row stands for.
    """
    chosen = outcomes
    if date_from is not None:
        chosen = chosen.filter(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        chosen = chosen.filter(F.col("created_at") <= F.lit(date_to).cast("timestamp_ntz"))
    if confidence is not None:
        chosen = chosen.filter(F.col("confidence") == confidence)
    if agent is not None:
        chosen = chosen.filter(F.array_contains("agents_involved", agent))
    if limit is not None:
        chosen = chosen.orderBy(F.col("created_at").desc(), F.col("outcome_id").desc()).limit(limit)

    cited = chosen.select(
        "outcome_id", "session_id", "confidence", "created_at",
        F.explode_outer(F.array_distinct("evidence_proposal_ids")).alias("_pid"),
    )
    known = proposals.select("proposal_id", "risk_class")
    whole = limit is None and date_from is None and date_to is None and confidence is None and agent is None
    if not whole:
        # the ledgers are cut to the proposals that the shown outcomes cite before they are combined
        wanted = cited.select(F.col("_pid").alias("proposal_id")).filter("proposal_id is not null").distinct()
        known = known.join(wanted, "proposal_id", "left_semi")
        approvals = approvals.join(wanted, "proposal_id", "left_semi")
        actions = actions.join(wanted, "proposal_id", "left_semi")
    said = approvals.groupBy("proposal_id", "approved_by", "approved").agg(F.count("*").alias("_said"))
    done = actions.groupBy("proposal_id", "action_type", F.col("status").alias("action_status")).agg(
        F.count("*").alias("_done")
    )
    if whole:
        # one task sorts all four ledgers for its proposals, and their compressed size does not tell how much that is
        ones = [df.select(F.lit(1)) for df in (chosen, proposals, approvals, actions)]
        tasks = 1 + reduce(DataFrame.unionByName, ones).count() // TASK_ROWS
        cited = cited.repartition(tasks, "_pid")
        known, said, done = (df.repartition(tasks, "proposal_id") for df in (known, said, done))
    combined = known.join(said, "proposal_id", "left").join(done, "proposal_id", "left")
    joined = cited.join(combined, F.col("_pid") == F.col("proposal_id"), "left").drop("_pid")
    copies = F.coalesce("_said", F.lit(1)) * F.coalesce("_done", F.lit(1))
    return joined.withColumn("copies", copies).drop("_said", "_done")


def autonomy_stats(ledger: DataFrame) -> DataFrame:
    """Decisions per risk class; ``ledger`` has ``risk_class`` and ``status``."""
    return ledger.groupBy("risk_class").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "completed").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def autonomy_promotion(stats: DataFrame, needed: dict[str, int], max_error_rate: float) -> DataFrame:
    """Whether a class may run without approval: enough successes, few enough failures.

    A negative number of needed successes means never.
    """
    wanted = lookup(text_map({k: str(v) for k, v in needed.items()}), F.col("risk_class")).cast("bigint")
    rate = F.coalesce(F.col("failed") / F.nullif(F.col("total").cast("double"), F.lit(0.0)), F.lit(0.0))
    promoted = (wanted >= 0) & (F.col("successful") >= wanted) & (rate <= max_error_rate)
    return stats.withColumn("error_rate", F.round(rate, 4)).withColumn(
        "promoted", F.coalesce(promoted, F.lit(False))
    )


def ledger_stats(tables: dict[str, DataFrame], settings: dict[str, int] | None = None) -> DataFrame:
    """``name, total`` for ledger tables, plus sizes of the configuration."""
    spark = next(iter(tables.values())).sparkSession
    counts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("total")) for n, df in tables.items()]
    for name, size in (settings or {}).items():
        counts.append(spark.range(1).select(F.lit(name).alias("name"), F.lit(size).cast("bigint").alias("total")))
    return reduce(DataFrame.unionByName, counts)


def capture_memory(outcomes: DataFrame, policy: Policy) -> DataFrame:
    """One episodic memory per outcome, scoped to the first agent's bundle or global."""
    bundle = lookup(
        text_map({a.name: a.bundle for a in policy.agents}), F.try_element_at("agents_involved", F.lit(1))
    )
    confidence: Column = F.lit(fixed.CONFIDENCE_OTHER)
    for level, value in fixed.CONFIDENCE_VALUE.items():
        confidence = F.when(F.col("confidence") == level, value).otherwise(confidence)
    summary = redact_words(F.col("decision_summary"), policy.pii_names)
    reasoning = redact_words(F.col("reasoning"), policy.pii_names)
    content = F.to_json(
        F.struct(
            "question",
            summary.alias("decision"),
            reasoning.alias("reasoning"),
            F.col("agents_involved").alias("agents"),
            "session_id",
        )
    )
    return outcomes.select(
        F.lit("episodic").alias("memory_type"),
        F.when(bundle.isNotNull(), "bundle").otherwise("global").alias("scope_type"),
        F.coalesce(bundle, F.lit("global")).alias("scope_id"),
        F.lit("candidate").alias("status"),
        F.substring("question", 1, 200).alias("title"),
        summary.alias("summary"),
        content.alias("content"),
        confidence.alias("confidence"),
        F.col("outcome_id").alias("source_outcome_id"),
    )
