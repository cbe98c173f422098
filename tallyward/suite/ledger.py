"""Decision ledger, memory and precedents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.functions import keys
from tallyward.operators import ledger, memory
from tallyward.sources.tables import load
from tallyward.suite.common import POLICY, Suite, view, words

SUITE = Suite()
add = SUITE.add

RISKS = {
    "send_note": "low",
    "raise_flag": "medium",
    "move_order": "high",
    "stop_order": "critical",
}
APPROVALS = {"low": "auto", "medium": "auto", "high": "human_required", "critical": "senior_required"}
PERMISSIONS = {
    "sales": {"propose": ["low", "medium"], "approve": ["low"], "execute": ["low"]},
    "support": {"propose": ["low"], "approve": [], "execute": ["low", "medium", "high"]},
}


@add(
    "d01_missing_evidence",
    """with cited as (select proposal_id, evidence_event_id as ref from v_proposals union select proposal_id, proposal_id from v_proposals)
       select proposal_id, 'event' as kind, cast(ref as varchar) as missing from cited where ref not in (select event_id from events)
       union all select proposal_id, 'rule', risk_class from v_proposals
           where risk_class not in (select confidence from v_outcomes)""",
    ("v_proposals", "v_outcomes"),
)
def d01(spark, folder):
    proposals = view(spark, folder, "v_proposals").select(
        "proposal_id",
        F.array("evidence_event_id", "proposal_id", "proposal_id").alias("events"),
        F.array("risk_class").alias("rules"),
    )
    rules = view(spark, folder, "v_outcomes").select(F.col("confidence").alias("rule")).distinct()
    return ledger.missing_evidence(
        proposals,
        "proposal_id",
        {"event": ("events", load(spark, folder, "events"), "event_id"), "rule": ("rules", rules, "rule")},
    )


@add(
    "d02_classify_actions",
    """select action_type, risk_class, case risk_class when 'low' then 'auto' when 'medium' then 'auto' when 'high' then 'human_required' else 'senior_required' end as approval,
              count(*) as actions
       from (select action_type, case action_type when 'send_note' then 'low' when 'raise_flag' then 'medium' when 'stop_order' then 'critical' else 'high' end as risk_class
             from v_proposals) group by 1, 2, 3""",
    ("v_proposals",),
)
def d02(spark, folder):
    classified = ledger.classify_actions(view(spark, folder, "v_proposals").drop("risk_class"), RISKS, APPROVALS)
    return classified.groupBy("action_type", "risk_class", "approval").agg(F.count("*").alias("actions"))


@add(
    "d03_permissions",
    """with log as (
            select proposal_id, agent_id as actor, 'propose' as verb, risk_class from v_proposals
            union all select a.proposal_id, approved_by, 'approve', risk_class from v_approvals a join v_proposals p using (proposal_id)
            union all select a.proposal_id, p.agent_id, 'execute', risk_class from v_actions a join v_proposals p using (proposal_id))
       select proposal_id, actor, verb, risk_class,
              case actor || '|' || verb when 'sales|propose' then 'low,medium' when 'sales|approve' then 'low' when 'sales|execute' then 'low'
                   when 'support|propose' then 'low' when 'support|approve' then '' else 'low,medium,high' end as allowed_classes
       from log where actor = 'sales' and verb = 'propose' and risk_class not in ('low', 'medium')
          or actor = 'sales' and verb in ('approve', 'execute') and risk_class <> 'low'
          or actor = 'support' and (verb = 'propose' and risk_class <> 'low' or verb = 'approve' or verb = 'execute' and risk_class not in ('low', 'medium', 'high'))""",
    ("v_proposals", "v_approvals", "v_actions"),
)
def d03(spark, folder):
    proposals = view(spark, folder, "v_proposals").select("proposal_id", "agent_id", "risk_class")
    log = proposals.select("proposal_id", F.col("agent_id").alias("actor"), F.lit("propose").alias("verb"), "risk_class")
    approved = view(spark, folder, "v_approvals").join(proposals, "proposal_id")
    acted = view(spark, folder, "v_actions").join(proposals, "proposal_id")
    log = log.unionByName(
        approved.select("proposal_id", F.col("approved_by").alias("actor"), F.lit("approve").alias("verb"), "risk_class")
    ).unionByName(
        acted.select("proposal_id", F.col("agent_id").alias("actor"), F.lit("execute").alias("verb"), "risk_class")
    )
    return ledger.permission_violations(log, PERMISSIONS)


def _outcomes(spark, folder):
    raw = view(spark, folder, "v_outcomes")
    return raw.withColumn("agents_involved", words("agents_text")).withColumn(
        "evidence_proposal_ids", F.array("evidence_proposal_id")
    )


@add(
    "d04_lifecycle",
    """with ap as (select proposal_id, arg_max(approved, (created_at, approval_id)) as ok, min(created_at) filter (where approved) as ok_at from v_approvals group by 1),
            ac as (select proposal_id, min(created_at) as at from v_actions group by 1),
            oc as (select distinct evidence_proposal_id as proposal_id from v_outcomes)
       select p.proposal_id, p.risk_class,
              case when oc.proposal_id is not null then 'completed' when ac.at is not null then 'executed' when ok then 'approved' when not ok then 'rejected' else 'pending' end as status,
              ac.at is not null and (ok_at is null or ok_at > ac.at) as executed_unapproved
       from v_proposals p left join ap using (proposal_id) left join ac using (proposal_id) left join oc on oc.proposal_id = p.proposal_id""",
    ("v_proposals", "v_approvals", "v_actions", "v_outcomes"),
)
def d04(spark, folder):
    return ledger.proposal_status(
        view(spark, folder, "v_proposals").select("proposal_id", "risk_class"),
        view(spark, folder, "v_approvals"),
        view(spark, folder, "v_actions"),
        _outcomes(spark, folder),
    )


def _findings(spark, folder):
    raw = view(spark, folder, "v_findings")
    key = keys.finding_key(
        F.col("session_id"), F.col("agent_id"), F.col("finding"), F.col("confidence"), words("sources_text")
    )
    return raw.withColumn("idempotency_key", key)


_KEYED = """
    keyed as (select *, sha256(session_id || '|' || agent_id || '|' || finding || '|' || confidence || '|' ||
                    coalesce(array_to_string(list_sort(string_split(sources_text, ',')), ','), '')) as idempotency_key from v_findings)"""


@add(
    "d05_append_once",
    f"""with {_KEYED}, old as (select arg_min(finding_id, (created_at, finding_id)) as finding_id, idempotency_key from keyed where confidence = 'high' group by 2),
             fresh as (select arg_min(finding_id, (created_at, finding_id)) as finding_id, idempotency_key from keyed
                       where idempotency_key not in (select idempotency_key from old) group by 2)
        select * from old union all select * from fresh""",
    ("v_findings",),
)
def d05(spark, folder):
    keyed = _findings(spark, folder).select("finding_id", "created_at", "confidence", "idempotency_key")
    empty = keyed.limit(0)
    old = ledger.append_once(empty, keyed.filter("confidence = 'high'"), "idempotency_key", ["created_at", "finding_id"])
    appended = ledger.append_once(old, keyed, "idempotency_key", ["created_at", "finding_id"])
    return appended.select("finding_id", "idempotency_key")


@add(
    "d05_replayed_rows",
    f"""with {_KEYED}, old as (select arg_min(finding_id, (created_at, finding_id)) as stored_finding_id, idempotency_key from keyed group by 2)
        select finding_id, stored_finding_id from keyed join old using (idempotency_key)""",
    ("v_findings",),
)
def d05_replays(spark, folder):
    keyed = _findings(spark, folder).select("finding_id", "created_at", "idempotency_key")
    stored = ledger.append_once(keyed.limit(0), keyed, "idempotency_key", ["created_at", "finding_id"])
    replays = ledger.original_rows(keyed, stored, "idempotency_key", ["finding_id"])
    return replays.select("finding_id", "stored_finding_id")


@add(
    "d05_workflow_ids",
    "select proposal_id, substr(sha256(agent_id || '|' || action_type || '|' || risk_class), 1, 32) as workflow_id from v_proposals",
    ("v_proposals",),
)
def d05_workflow(spark, folder):
    proposals = view(spark, folder, "v_proposals")
    ident = keys.workflow_id(F.col("agent_id"), F.col("action_type"), F.col("risk_class"))
    return proposals.select("proposal_id", ident.alias("workflow_id"))


@add(
    "d06_findings_digest",
    "select session_id, finding_id, agent_id, finding, row_number() over (partition by session_id order by created_at, finding_id) as seq from v_findings",
    ("v_findings",),
)
def d06(spark, folder):
    digest = ledger.findings_digest(view(spark, folder, "v_findings"))
    return digest.select("session_id", "finding_id", "agent_id", "finding", "seq")


@add(
    "d06_findings_of_agent",
    """select session_id, finding_id, row_number() over (partition by session_id order by created_at, finding_id) as seq
       from v_findings where agent_id = 'sales'""",
    ("v_findings",),
)
def d06_agent(spark, folder):
    digest = ledger.findings_digest(view(spark, folder, "v_findings"), "sales", split=True)
    return digest.select("session_id", "finding_id", "seq")


@add(
    "d06_findings_totals",
    "select session_id, count(*) as findings, count(distinct agent_id) as agents, min(created_at) as first_at, max(created_at) as last_at from v_findings group by 1",
    ("v_findings",),
)
def d06_totals(spark, folder):
    return ledger.findings_totals(view(spark, folder, "v_findings"))


_AUDIT_JOIN = """
    select o.outcome_id, o.session_id, o.confidence, o.created_at, p.proposal_id, p.risk_class, a.approved_by, a.approved, t.action_type, t.status as action_status
    from chosen o left join v_proposals p on p.proposal_id = o.evidence_proposal_id
    left join v_approvals a on a.proposal_id = p.proposal_id left join v_actions t on t.proposal_id = p.proposal_id"""


@add(
    "d07_audit_newest",
    f"""with chosen as (select * from v_outcomes where created_at >= timestamp '2024-01-05' and created_at <= timestamp '2024-01-25' and confidence = 'high'
                          and list_contains(string_split(agents_text, ','), 'sales') order by created_at desc, outcome_id desc limit 20),
        j as ({_AUDIT_JOIN}) select *, count(*) as copies from j group by all""",
    ("v_proposals", "v_approvals", "v_actions", "v_outcomes"),
)
def d07(spark, folder):
    return ledger.audit_decisions(
        _outcomes(spark, folder),
        view(spark, folder, "v_proposals"),
        view(spark, folder, "v_approvals"),
        view(spark, folder, "v_actions"),
        date_from="2024-01-05",
        date_to="2024-01-25",
        confidence="high",
        agent="sales",
    )


@add(
    "d07_audit_all",
    f"with chosen as (select * from v_outcomes), j as ({_AUDIT_JOIN}) select *, count(*) as copies from j group by all",
    ("v_proposals", "v_approvals", "v_actions", "v_outcomes"),
)
def d07_all(spark, folder):
    return ledger.audit_decisions(
        _outcomes(spark, folder),
        view(spark, folder, "v_proposals"),
        view(spark, folder, "v_approvals"),
        view(spark, folder, "v_actions"),
        limit=None,
    )


_STATS = """
    stats as (select risk_class, count(*) as total, count(*) filter (where status = 'completed') as successful, count(*) filter (where status = 'failed') as failed
              from v_actions join v_proposals using (proposal_id) group by 1)"""


def _stats(spark, folder):
    proposals = view(spark, folder, "v_proposals").select("proposal_id", "risk_class")
    return ledger.autonomy_stats(view(spark, folder, "v_actions").join(proposals, "proposal_id"))


@add("d08_autonomy_stats", f"with {_STATS} select * from stats", ("v_proposals", "v_actions"))
def d08(spark, folder):
    return _stats(spark, folder)


@add(
    "d09_promotion",
    f"""with {_STATS} select *, round(failed / total::double, 4) as error_rate,
               risk_class = 'low' and failed / total::double <= 0.05 or risk_class = 'medium' and successful >= 50 and failed / total::double <= 0.05 as promoted
        from stats""",
    ("v_proposals", "v_actions"),
)
def d09(spark, folder):
    needed = {"low": 0, "medium": 50, "high": -1, "critical": -1}
    return ledger.autonomy_promotion(_stats(spark, folder), needed, 0.05)


@add(
    "d10_ledger_stats",
    """select 'outcomes' as name, count(*) as total from v_outcomes union all select 'findings', count(*) from v_findings
       union all select 'bundles', 2 union all select 'pii_columns', 1""",
    ("v_outcomes", "v_findings"),
)
def d10(spark, folder):
    tables = {"outcomes": view(spark, folder, "v_outcomes"), "findings": view(spark, folder, "v_findings")}
    return ledger.ledger_stats(tables, {"bundles": len(POLICY.bundles), "pii_columns": len(POLICY.pii_names)})


@add(
    "d11_capture_memory",
    """select outcome_id as source_outcome_id, 'episodic' as memory_type, 'candidate' as status,
              case split_part(agents_text, ',', 1) when 'sales' then 'bundle' when 'support' then 'bundle' else 'global' end as scope_type,
              case split_part(agents_text, ',', 1) when 'sales' then 'sales_bundle' when 'support' then 'support_bundle' else 'global' end as scope_id,
              substr(question, 1, 200) as title, replace(decision_summary, 'c_name', '[REDACTED]') as summary,
              case confidence when 'high' then 0.9 when 'medium' then 0.6 else 0.3 end::double as confidence, session_id
       from v_outcomes""",
    ("v_outcomes",),
)
def d11(spark, folder):
    captured = ledger.capture_memory(_outcomes(spark, folder), POLICY)
    return captured.withColumn("session_id", F.get_json_object("content", "$.session_id")).drop("content")


@add(
    "k01_upsert_memory",
    """with w as (select event_type as agent_id, 'k' || cast(user_id as varchar) as key, props as content, ts, event_id from events)
       select agent_id, key, arg_max(content, (ts, content)) as content, min(ts) as created_at, max(ts) as updated_at from w group by 1, 2""",
)
def k01(spark, folder):
    writes = load(spark, folder, "events").select(
        F.col("event_type").alias("agent_id"),
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("content"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )
    older = writes.filter(F.col("created_at") < F.lit("2024-01-15").cast("timestamp_ntz"))
    newer = writes.filter(F.col("created_at") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return memory.upsert_memory(memory.upsert_memory(older.limit(0), older), newer)


@add(
    "k02_recall",
    """select memory_id, scope_type, confidence, created_at from v_memory where status in ('candidate', 'active')
         and (scope_type = 'agent' and scope_id = 'sales' or scope_type = 'bundle' and scope_id = 'sales_bundle' or scope_type = 'global')
         and (contains(lower(title), 'the') or contains(lower(summary), 'the'))
       order by confidence desc, created_at desc, memory_id limit 20""",
    ("v_memory",),
)
def k02(spark, folder):
    found = memory.recall(view(spark, folder, "v_memory"), "sales", POLICY, "all", "THE")
    return found.select("memory_id", "scope_type", "confidence", "created_at")


@add(
    "k02_recall_bundle",
    """select memory_id, scope_id, confidence from v_memory where status in ('candidate', 'active') and scope_type = 'bundle' and scope_id = 'sales_bundle'
       order by confidence desc, created_at desc, memory_id limit 20""",
    ("v_memory",),
)
def k02_bundle(spark, folder):
    found = memory.recall(view(spark, folder, "v_memory"), "sales", POLICY, "bundle")
    return found.select("memory_id", "scope_id", "confidence")


@add(
    "k03_precedents",
    """select outcome_id, question, created_at from v_past
       where contains(lower(question), 'tion') or contains(lower(decision_summary), 'tion') or contains(lower(question), 'ander') or contains(lower(decision_summary), 'ander')
       order by created_at desc, outcome_id desc limit 5""",
    ("v_past",),
)
def k03(spark, folder):
    found = memory.precedents(view(spark, folder, "v_past"), "Is the TION or ander ok")
    return found.select("outcome_id", "question", "created_at")


@add(
    "k04_precedents_bulk",
    r"""with w as (select question_id, list_filter(regexp_split_to_array(lower(question), '\s+'), lambda x: length(x) > 3)[1:5] as ws from v_questions),
          past as (select outcome_id, created_at, lower(question || ' ' || decision_summary) as text from v_past),
          asked as (select distinct question_id, unnest(ws) as word from w),
          pairs as (select distinct question_id, outcome_id, created_at from asked join past on contains(text, word)
                    union all select question_id, outcome_id, created_at from w, past where len(ws) = 0),
          ranked as (select question_id, row_number() over (partition by question_id order by created_at desc, outcome_id desc) as rank, outcome_id from pairs)
        select * from ranked where rank <= 5""",
    ("v_questions", "v_past"),
)
def k04(spark, folder):
    return memory.precedents_bulk(view(spark, folder, "v_questions"), view(spark, folder, "v_past"), 5)
