"""Masking and policy checks over the query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.functions import textcols
from tallyward.operators import masking, policy, policydiff
from tallyward.plans.model import Policy
from tallyward.session import cut
from tallyward.sources.tables import load
from tallyward.suite.common import POLICY, POLICY_NEXT, TABLES, Suite, view

SUITE = Suite()
add = SUITE.add


@add(
    "g01_governed_sql",
    """select '[PII BLOCKED]' as c_name, c_mktsegment, count(*) as n from customer group by c_mktsegment
       order by n desc, c_mktsegment limit 100""",
)
def g01(spark, folder):
    for name in TABLES:
        load(spark, folder, name).createOrReplaceTempView(name)
    # the blocked name is only visible in the result, as it would be behind a view
    spark.sql("select c_custkey, c_name as who, c_mktsegment from customer").createOrReplaceTempView("customer")
    text = """SELECT max(who) AS "c_name", c_mktsegment, count(*) AS n FROM customer
              GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 100"""
    relaxed = policy.Policy(
        POLICY.agents, POLICY.bundles, {"customer": ("c_name",)}, pii_mode="mask", max_rows=500
    )
    return policy.governed_sql(spark, text.replace('"', "`"), "support", relaxed)


@add("g02_mask_pii", "select c_custkey, '[PII BLOCKED]' as c_name, c_mktsegment, '[PII BLOCKED]' as c_acctbal from customer")
def g02(spark, folder):
    customers = load(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return masking.mask_pii(customers, ["customer.C_NAME", "customer.c_acctbal"])


@add(
    "g03_redact",
    r"""select doc_id, regexp_replace(regexp_replace(text, '\bthe\b', '[REDACTED]', 'gi'), '\bin\b', '[REDACTED]', 'gi') as text
        from documents""",
)
def g03(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return masking.redact(docs, "text", ["people.the", "people.in"])


@add(
    "g04_pii_columns",
    """select table_name, column_name from v_columns where tag like '%PII%' or tag like '%Sensitive%'
       union select table_name, column_name from v_policy_pii""",
    ("v_columns", "v_policy_pii"),
)
def g04(spark, folder):
    catalog = view(spark, folder, "v_columns").withColumn("tags", F.array("tag"))
    return masking.pii_columns(catalog, view(spark, folder, "v_policy_pii"))


def _log(spark, folder):
    return view(spark, folder, "v_query_log")


def _joined(column):
    return F.coalesce(F.array_join(column, ","), F.lit(""))


@add(
    "p01_tables",
    r"""with t as (select query_id, generate_subscripts(list, 1) as i, unnest(list) as name from (
            select query_id, regexp_extract_all(sql_text, '(?i)(?:FROM|JOIN)\s+([a-z_][a-z0-9_.]*)', 1) as list from v_query_log)),
          firsts as (select query_id, lower(name) as name, min(i) as i from t group by 1, 2)
        select l.query_id, coalesce(string_agg(f.name, ',' order by f.i), '') as tables
        from v_query_log l left join firsts f using (query_id) group by 1""",
    ("v_query_log",),
)
def p01(spark, folder):
    parsed = policy.parse_sql(_log(spark, folder))
    return parsed.select("query_id", _joined(F.col("parsed.tables")).alias("tables"))


@add(
    "p02_columns",
    r"""with c as (select query_id, regexp_extract(sql_text, '(?is)SELECT\s+(.*?)(?:\bFROM\b)', 1) as clause from v_query_log),
          parts as (select query_id, generate_subscripts(l, 1) as i, trim(unnest(l)) as part from (
              select query_id, string_split(clause, ',') as l from c where trim(clause) <> '*')),
          named as (select query_id, i, lower(replace(replace(list_extract(regexp_split_to_array(part, '(?i)\s+(?:AS\s+)?'), -1), '"', ''), '''', '')) as n
                    from parts)
        select l.query_id, coalesce(string_agg(n, ',' order by i) filter (where n <> ''), '') as columns
        from v_query_log l left join named using (query_id) group by 1""",
    ("v_query_log",),
)
def p02(spark, folder):
    parsed = policy.parse_sql(_log(spark, folder))
    return parsed.select("query_id", _joined(F.col("parsed.columns")).alias("columns"))


@add(
    "p03_joins",
    r"""with j as (select query_id, regexp_extract_all(sql_text, '(?i)JOIN\s+\S+\s+\S*\s*ON\s+(\S+)\s*=\s*(\S+)', 1) as a,
                         regexp_extract_all(sql_text, '(?i)JOIN\s+\S+\s+\S*\s*ON\s+(\S+)\s*=\s*(\S+)', 2) as b from v_query_log)
        select query_id, regexp_replace(lower(a[1]), '\w+\.', '') as left_col, regexp_replace(lower(b[1]), '\w+\.', '') as right_col
        from j where len(a) > 0""",
    ("v_query_log",),
)
def p03(spark, folder):
    return policy.parse_sql(_log(spark, folder)).select("query_id", F.inline("parsed.joins"))


@add(
    "p04_limit",
    r"""select query_id, regexp_matches(sql_text, '(?i)LIMIT\s+(\d+)') as has_limit,
               cast(nullif(regexp_extract(sql_text, '(?i)LIMIT\s+(\d+)', 1), '') as bigint) as limit_value from v_query_log""",
    ("v_query_log",),
)
def p04(spark, folder):
    return policy.parse_sql(_log(spark, folder)).select("query_id", "parsed.has_limit", "parsed.limit_value")


@add(
    "p05_read_only",
    r"""select query_id, not regexp_matches(upper(sql_text), 'INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|GRANT|REVOKE') as is_read_only,
               not regexp_matches(upper(sql_text), '\b(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|GRANT|REVOKE)\b') as strict_read_only
        from v_query_log""",
    ("v_query_log",),
)
def p05(spark, folder):
    loose = policy.parse_sql(_log(spark, folder)).select("query_id", "sql_text", "parsed.is_read_only")
    strict = policy.parse_sql(loose, strict=True)
    return strict.select("query_id", "is_read_only", F.col("parsed.is_read_only").alias("strict_read_only"))


@add(
    "p06_statements",
    """select query_id, len(list_filter(string_split(sql_text, ';'), lambda s: trim(s) <> ''))::bigint as statement_count
       from v_query_log""",
    ("v_query_log",),
)
def p06(spark, folder):
    parsed = policy.parse_sql(_log(spark, folder))
    return parsed.select("query_id", F.col("parsed.statement_count").cast("bigint").alias("statement_count"))


# all failed checks of the first policy, written as relational SQL
_FACTS = r"""
    facts as (
        select l.*, lower(sql_text) as low, sql_text <> '' as has_sql,
               regexp_matches(lower(sql_text), 'select\s+\*') as star,
               len(list_filter(string_split(sql_text, ';'), lambda s: trim(s) <> '')) as stmts,
               nullif(regexp_extract(sql_text, '(?i)LIMIT\s+(\d+)', 1), '') as lim,
               case agent_id when 'sales' then 'sales_bundle' when 'support' then 'support_bundle' end as bundle
        from v_query_log l),
    used as (select distinct query_id, bundle, lower(unnest(regexp_extract_all(sql_text, '(?i)(?:FROM|JOIN)\s+([a-z_][a-z0-9_.]*)', 1))) as t from facts),
    joins as (
        select query_id, bundle, regexp_replace(lower(unnest(regexp_extract_all(sql_text, '(?i)JOIN\s+\S+\s+\S*\s*ON\s+(\S+)\s*=\s*(\S+)', 1))), '\w+\.', '') as a,
               regexp_replace(lower(unnest(regexp_extract_all(sql_text, '(?i)JOIN\s+\S+\s+\S*\s*ON\s+(\S+)\s*=\s*(\S+)', 2))), '\w+\.', '') as b
        from facts),
    allowed(bundle, t) as (values ('sales_bundle', 'orders'), ('sales_bundle', 'lineitem'), ('sales_bundle', 'part'), ('support_bundle', 'customer')),
    v as (
        select query_id, 0 as p, 'authenticate' as check_name, 'Unknown agent: ' || agent_id as detail from facts where agent_id not in ('sales', 'support', 'planner')
        union all select query_id, 1, 'can_query', 'Agent planner (orchestrator) cannot execute queries' from facts where agent_id = 'planner'
        union all select query_id, 2, 'read_only', 'Write operations (INSERT/UPDATE/DELETE/DROP) are not allowed' from facts
            where has_sql and regexp_matches(upper(sql_text), 'INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|GRANT|REVOKE')
        union all select query_id, 3, 'single_statement', stmts || ' statements in query' from facts where stmts > 1
        union all select query_id, 4, 'bundle_scope', 'Table ' || t || ' is not in bundle ' || u.bundle from used u
            where bundle is not null and not exists (select 1 from allowed a where a.bundle = u.bundle and a.t = regexp_replace(u.t, '^public\.', ''))
        union all select query_id, 5, 'join_allowlist', 'Join ' || a || ' = ' || b || ' not in bundle allowlist' from joins
            where bundle is not null and not (bundle = 'sales_bundle' and (least(a, b), greatest(a, b)) in (('l_orderkey', 'o_orderkey'), ('l_partkey', 'p_partkey')))
        union all select query_id, 7, 'pii_check', 'PII column customer.c_name is blocked' from facts f
            where has_sql and (regexp_matches(low, '\bc_name\b') or star and exists (select 1 from used u where u.query_id = f.query_id and regexp_replace(u.t, '^public\.', '') = 'customer'))
        union all select query_id, 8, 'limit_check', 'Query must include a LIMIT clause (max 500)' from facts where has_sql and lim is null
        union all select query_id, 9, 'limit_value', 'LIMIT ' || lim || ' exceeds max 500' from facts where lim::bigint > 500)
"""


def _check(name, *checks):
    quoted = ", ".join(f"'{c}'" for c in checks)

    @add(
        name,
        f"with {_FACTS} select distinct query_id, check_name, detail from v where check_name in ({quoted})",
        ("v_query_log",),
    )
    def one(spark, folder):
        rows = policy.violation_rows(policy.evaluate(_log(spark, folder), POLICY))
        return rows.withColumnRenamed("check", "check_name").filter(F.col("check_name").isin(*checks))


_check("p07_known_agent", "authenticate")
_check("p08_may_query", "can_query")
_check("p09_text_checks", "read_only", "single_statement", "execution_permission")
_check("p10_bundle_scope", "bundle_scope")
_check("p11_join_allowlist", "join_allowlist")
_check("p12_pii", "pii_check")
_check("p13_limits", "limit_check", "limit_value")


@add(
    "p12_pii_from_catalog",
    r"""with words as (select distinct unnest(regexp_extract_all(lower(sql_text), '[a-z0-9_]+')) as column_name from v_query_log),
            personal as (select case left(column_name, 2) when 'c_' then 'Customer' else 'supplier' end as table_name, column_name
                         from words where left(column_name, 2) in ('c_', 's_')),
            used as (select query_id, unnest(regexp_extract_all(lower(sql_text), '[a-z0-9_]+')) as word from v_query_log)
       select query_id, table_name, column_name from used join personal on word = column_name
       union select query_id, table_name, column_name from v_query_log join personal
           on sql_text like 'SELECT *%' and lower(sql_text) like '%from ' || lower(table_name) || '%'""",
    ("v_query_log",),
)
def p12_catalog(spark, folder):
    """The catalog lists every column that a query names; some carry a personal tag."""
    log = _log(spark, folder)
    names = log.select(F.explode(textcols.identifiers(F.lower("sql_text"))).alias("column_name")).distinct()
    head = F.left("column_name", F.lit(2))
    catalog = names.select(
        F.when(head == "c_", "Customer").otherwise("supplier").alias("table_name"),
        "column_name",
        F.array(F.when(head.isin("c_", "s_"), "PII.High").otherwise("General")).alias("tags"),
    )
    return policy.personal_columns_used(log, masking.pii_columns(catalog))


@add(
    "p12_thousand_columns",
    """select query_id, 'PII column wide.c_name is blocked' as detail from v_query_log where sql_text like '%c_name%'
       union all select query_id, 'PII column wide.col_7 is blocked' from v_query_log where sql_text like '%col_7%'""",
    ("v_query_log",),
)
def p12_thousand(spark, folder):
    many = Policy(POLICY.agents, POLICY.bundles, {"wide": ("c_name", *(f"col_{i}" for i in range(1000)))})
    rows = policy.violation_rows(policy.evaluate(_log(spark, folder), many))
    return rows.filter(F.col("check") == "pii_check").select("query_id", "detail")


@add(
    "p14_verdict",
    f"""with {_FACTS}, ranked as (select distinct query_id, p, check_name, detail from v),
        summed as (select query_id, string_agg(check_name, ',' order by p, detail) as checks, arg_min(detail, (p, detail)) as reason,
                          string_agg(case when check_name = 'pii_check' then 'customer.c_name' end, ',') as blocked from ranked group by 1)
        select l.query_id, s.query_id is null as allow, s.reason, coalesce(s.checks, '') as checks, coalesce(s.blocked, '') as blocked
        from v_query_log l left join summed s using (query_id)""",
    ("v_query_log",),
)
def p14(spark, folder):
    judged = policy.evaluate(_log(spark, folder), POLICY)
    return judged.select(
        "query_id",
        "allow",
        "reason",
        _joined(F.transform("violations", lambda v: v["check"])).alias("checks"),
        _joined(F.col("blocked_columns")).alias("blocked"),
    )


def _decisions(spark, folder):
    return policy.decision_log(policy.evaluate(_log(spark, folder), POLICY), POLICY.revision)


@add(
    "p15_decision_fields",
    rf"""with {_FACTS}, ranked as (select distinct query_id, p, check_name, detail from v),
        summed as (select query_id, string_agg(check_name || ': ' || detail, '; ' order by p, detail) as failed from ranked group by 1),
        t as (select query_id, generate_subscripts(list, 1) as i, unnest(list) as name from (
            select query_id, regexp_extract_all(sql_text, '(?i)(?:FROM|JOIN)\s+([a-z_][a-z0-9_.]*)', 1) as list from v_query_log)),
        firsts as (select query_id, lower(name) as name, min(i) as i from t group by 1, 2),
        named as (select query_id, string_agg(name, ',' order by i) as tables from firsts group by 1),
        paired as (select query_id, string_agg(a || '=' || b, ',') as joins from joins group by 1)
        select f.query_id as decision_id, f.ts, case when has_sql then sha256(sql_text) end as sql_hash, agent_id, tool_name, sql_text as sql,
               coalesce(tables, '') as tables, coalesce(joins, '') as joins, lim is not null as has_limit, lim::bigint as limit_value,
               stmts::bigint as statement_count, not regexp_matches(upper(sql_text), 'INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|GRANT|REVOKE') as is_read_only,
               failed is null as allow, coalesce(failed, '') as failed, failed is null as allowed, '{POLICY.revision}' as revision
        from facts f left join summed using (query_id) left join named using (query_id) left join paired using (query_id)""",
    ("v_query_log",),
)
def p15_fields(spark, folder):
    """Every field of the two JSON columns, read back."""
    log = _decisions(spark, folder)
    read = log.withColumn("_in", F.from_json("input", policy.INPUT)).withColumn("_out", F.from_json("result", policy.RESULT))
    parsed = F.col("_in.parsed")
    pairs = F.transform(parsed["joins"], lambda j: F.concat_ws("=", j["left_col"], j["right_col"]))
    failed = F.transform("_out.violations", lambda v: F.concat_ws(": ", v["check"], v["detail"]))
    return read.select(
        "decision_id",
        "ts",
        "sql_hash",
        "_in.agent_id",
        "_in.tool_name",
        "_in.sql",
        _joined(parsed["tables"]).alias("tables"),
        _joined(pairs).alias("joins"),
        parsed["has_limit"].alias("has_limit"),
        parsed["limit_value"].alias("limit_value"),
        parsed["statement_count"].cast("bigint").alias("statement_count"),
        parsed["is_read_only"].alias("is_read_only"),
        "_out.allow",
        F.array_join(failed, "; ").alias("failed"),
        "allowed",
        "revision",
    )


@add("p15_decision_log")
def p15(spark, folder):
    return _decisions(spark, folder)


@add(
    "p15_decision_hashes",
    f"""with {_FACTS} select query_id as decision_id, case when sql_text <> '' then sha256(sql_text) end as sql_hash,
               query_id not in (select query_id from v) as allowed, 'r1' as revision from v_query_log""",
    ("v_query_log",),
)
def p15_hashes(spark, folder):
    return _decisions(spark, folder).select("decision_id", "sql_hash", "allowed", "revision")


# the verdict of the second policy
_NEXT = r"""
    v2 as (
        select query_id from facts where agent_id = 'ghost'
        union select query_id from facts where has_sql and regexp_matches(upper(sql_text), 'INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|GRANT|REVOKE')
        union select query_id from facts where stmts > 1
        union select query_id from (select query_id, t, case when agent_id in ('sales', 'planner') then 'sales_bundle' else bundle end as b from used u1 join (select query_id, agent_id from facts) f1 using (query_id)) u
            where b is not null and regexp_replace(t, '^public\.', '') not in ('orders', 'lineitem', 'part', 'supplier') and b = 'sales_bundle'
               or b = 'support_bundle' and regexp_replace(t, '^public\.', '') <> 'customer'
        union select query_id from joins j1 join (select query_id, agent_id from facts) f1 using (query_id)
            where agent_id = 'support' or agent_id in ('sales', 'planner') and (least(a, b), greatest(a, b)) not in (('l_orderkey', 'o_orderkey'), ('l_partkey', 'p_partkey'))
        union select query_id from facts f where has_sql and (regexp_matches(low, '\b(c_name|c_mktsegment)\b')
            or star and exists (select 1 from used u where u.query_id = f.query_id and regexp_replace(u.t, '^public\.', '') = 'customer'))
        union select query_id from facts where has_sql and lim is null
        union select query_id from facts where lim::bigint > 10000),
    pair as (select query_id, ts, agent_id, query_id not in (select query_id from v) as allowed, query_id not in (select query_id from v2) as replay_allowed from v_query_log)
"""


@add(
    "p16_policy_drift",
    f"""with {_FACTS}, {_NEXT} select count(*) as total, count(*) filter (where allowed <> replay_allowed) as changed,
              printf('%.1f%%', count(*) filter (where allowed <> replay_allowed) * 100.0 / count(*)) as drift_rate from pair""",
    ("v_query_log",),
)
def p16(spark, folder):
    return policy.policy_drift(_decisions(spark, folder), POLICY_NEXT, limit=None)


@add(
    "p16_drift_newest",
    f"""with {_FACTS}, {_NEXT}, recent as (select * from pair where ts >= timestamp '2024-01-10' order by ts desc, query_id desc limit 100)
        select count(*) as total, count(*) filter (where allowed <> replay_allowed) as changed,
              printf('%.1f%%', count(*) filter (where allowed <> replay_allowed) * 100.0 / count(*)) as drift_rate from recent""",
    ("v_query_log",),
)
def p16_newest(spark, folder):
    return policy.policy_drift(_decisions(spark, folder), POLICY_NEXT, since="2024-01-10", limit=100)


@add(
    "p16_drift_examples",
    f"""with {_FACTS}, {_NEXT} select query_id as decision_id, ts, agent_id, allowed, replay_allowed from pair
        where allowed <> replay_allowed order by ts desc, query_id desc limit 10""",
    ("v_query_log",),
)
def p16_examples(spark, folder):
    return policy.drift_examples(_decisions(spark, folder), POLICY_NEXT, limit=None)


def _indexed(spark, folder):
    """The log and its index, each written once."""
    log = cut(_decisions(spark, folder), "decisions")
    return log, cut(policydiff.sorted_index(log), "index")


@add("p16_policy_drift_indexed", SUITE.oracles["p16_policy_drift"])
def p16_indexed(spark, folder):
    log, index = _indexed(spark, folder)
    return policydiff.policy_drift(log, index, POLICY, POLICY_NEXT, limit=None)


@add("p16_drift_examples_indexed", SUITE.oracles["p16_drift_examples"])
def p16_examples_indexed(spark, folder):
    log, index = _indexed(spark, folder)
    return policydiff.drift_examples(log, index, POLICY, POLICY_NEXT, limit=None)


@add(
    "p17_replay",
    f"""with {_FACTS}, {_NEXT} select query_id as decision_id, allowed, replay_allowed, allowed <> replay_allowed as changed,
              coalesce((select string_agg(check_name, ',' order by p, detail) from (select distinct query_id, p, check_name, detail from v) x where x.query_id = pair.query_id), '') as original_checks
        from pair""",
    ("v_query_log",),
)
def p17(spark, folder):
    replayed = policy.replay(_decisions(spark, folder), POLICY_NEXT)
    return replayed.select(
        "decision_id",
        "allowed",
        "replay_allowed",
        "changed",
        _joined(F.transform("original_violations", lambda v: v["check"])).alias("original_checks"),
    )
