"""Business rules over answers, and checks over table data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.operators import datachecks, rules
from tallyward.operators.rules import Check, Rule, Tokens
from tallyward.sources.tables import load
from tallyward.suite.common import POLICY, Suite, view

SUITE = Suite()
add = SUITE.add

RULES = [
    Rule(
        "revenue_excludes_cancelled",
        "error",
        ("orders.revenue", "orders.avg_value"),
        Check(
            "sql_pattern",
            applies_when=Tokens(require_any=("o_totalprice",)),
            require=Tokens(require_all=("cancelled",)),
            message="totals must leave out cancelled orders",
        ),
        "Leave out cancelled orders.",
    ),
    Rule(
        "compensation_threshold",
        "warning",
        ("customer.delays",),
        Check(
            "text_pattern",
            applies_when=Tokens(require_all=("compensation", "delay")),
            require=Tokens(require_any=("3 hour", "180 min")),
        ),
        "Name the threshold.",
    ),
    Rule(
        "refunds_apart",
        "error",
        ("lineitem.returned",),
        Check("text_pattern", require=Tokens(forbid_any=("netted",))),
        "Report refunds apart.",
    ),
    Rule("private_names", "error", ("customer.customer_count",), Check("pii_columns", message="personal column"), "Use keys."),
    Rule("seat_unique", "error", ("lineitem.lines",), None, "See the constraint."),
    Rule("checked_elsewhere", "error", ("orders.total_orders",), Check("manual"), "Ask the team."),
    Rule("no_domain", "error", (), Check("manual")),
]
_PII = ["c_name"]


def _answers(spark, folder):
    return view(spark, folder, "v_answers")


_STATUS = r"""
    s as (
        select answer_id, 'revenue_excludes_cancelled' as rule, 'error' as severity, 'sql_pattern' as method,
               case when sql_text is null then 'not_applicable' when not contains(lower(sql_text), 'o_totalprice') then 'not_applicable'
                    when contains(lower(sql_text), 'cancelled') then 'pass' else 'fail' end as status from v_answers
        union all select answer_id, 'compensation_threshold', 'warning', 'text_pattern',
               case when result_text is null or not (contains(lower(result_text), 'compensation') and contains(lower(result_text), 'delay')) then 'not_applicable'
                    when contains(lower(result_text), '3 hour') or contains(lower(result_text), '180 min') then 'pass' else 'fail' end from v_answers
        union all select answer_id, 'refunds_apart', 'error', 'text_pattern',
               case when result_text is null then 'not_applicable' when contains(lower(result_text), 'netted') then 'fail' else 'pass' end from v_answers
        union all select answer_id, 'private_names', 'error', 'pii_columns',
               case when regexp_matches(lower(coalesce(sql_text, '')), '(^|[^a-z0-9_])c_name([^a-z0-9_]|$)') then 'fail' else 'pass' end from v_answers
        union all select answer_id, 'seat_unique', 'error', 'none', 'manual' from v_answers
        union all select answer_id, 'checked_elsewhere', 'error', 'manual', 'manual' from v_answers
        union all select answer_id, 'no_domain', 'error', 'manual', 'manual' from v_answers),
    domain(rule, t) as (values ('revenue_excludes_cancelled', 'orders'), ('compensation_threshold', 'customer'), ('refunds_apart', 'lineitem'),
                               ('private_names', 'customer'), ('seat_unique', 'lineitem'), ('checked_elsewhere', 'orders')),
    used as (select distinct answer_id, agent_id, regexp_replace(lower(unnest(regexp_extract_all(sql_text, '(?i)(?:FROM|JOIN)\s+([a-z_][a-z0-9_.]*)', 1))), '^public\.', '') as t from v_answers),
    scoped as (select a.answer_id, d.rule from v_answers a join domain d on contains(lower(coalesce(a.result_text, '')), d.t)
               union select u.answer_id, d.rule from used u join domain d on u.t = d.t)
"""


def _by_method(name, *methods):
    quoted = ", ".join(f"'{m}'" for m in methods)

    @add(
        name,
        f"with {_STATUS} select answer_id, rule, severity, method, status from s where method in ({quoted})",
        ("v_answers",),
    )
    def one(spark, folder):
        checked = rules.check_rules(_answers(spark, folder), RULES, _PII).filter(F.col("method").isin(*methods))
        return checked.drop("detail")


_by_method("r01_query_patterns", "sql_pattern")
_by_method("r02_answer_patterns", "text_pattern")
_by_method("r03_pii_references", "pii_columns")
_by_method("r04_manual", "manual", "none")


@add("r01_failure_details")
def r01_details(spark, folder):
    return rules.check_rules(_answers(spark, folder), RULES, _PII).filter(F.col("status") == "fail")


@add(
    "r05_data_check",
    """select 'discounts_bounded' as rule, 1::bigint as checked_rows, max(l_discount) as observed, max(l_discount) <= 0.1 as passed from lineitem
       union all select 'orders_have_lines', 1, count(*)::double, count(*) = 0 from orders where o_orderkey not in (select l_orderkey from lineitem)""",
)
def r05(spark, folder):
    for name in ("orders", "lineitem"):
        load(spark, folder, name).createOrReplaceTempView(name)
    bounded = Rule(
        "discounts_bounded",
        "error",
        check=Check("query_result", sql="SELECT max(l_discount) AS d FROM lineitem", expect=("d", "<=", 0.1)),
    )
    covered = Rule(
        "orders_have_lines",
        "error",
        check=Check(
            "query_result",
            sql="SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
            expect=("n", "=", 0),
        ),
    )
    return datachecks.data_check(spark, bounded).unionByName(datachecks.data_check(spark, covered))


@add(
    "r06_unique_seats",
    "select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(*) > 1",
)
def r06_seats(spark, folder):
    return datachecks.repeated_keys(load(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@add(
    "r06_confirmed_without_payment",
    """select o_orderkey, o_orderstatus from orders where o_orderstatus = 'O'
       and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F')""",
)
def r06_payment(spark, folder):
    claims = load(spark, folder, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus")
    proofs = load(spark, folder, "lineitem").filter("l_linestatus = 'F'").select("l_orderkey")
    return datachecks.unconfirmed(claims, "o_orderkey", proofs, "l_orderkey")


@add(
    "r06_over_capacity",
    """select p_partkey, p_size, count(*) as used from part join lineitem on l_partkey = p_partkey
       group by 1, 2 having count(*) > p_size * 1.05""",
)
def r06_capacity(spark, folder):
    parts = load(spark, folder, "part").select("p_partkey", "p_size")
    return datachecks.over_capacity(load(spark, folder, "lineitem"), "l_partkey", parts, "p_partkey", "p_size")


@add(
    "r06_late_checkin",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 60000000.0 as lead_minutes
       from lineitem join orders on l_orderkey = o_orderkey where (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 60000000.0 < 4320""",
)
def r06_checkin(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    late = datachecks.too_late(lines, "l_orderkey", "o_orderdate", orders, "o_orderkey", "l_shipdate", 4320)
    return late.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "lead_minutes")


@add(
    "r06_refunds_apart",
    """select round(sum(l_extendedprice) filter (where l_returnflag <> 'R'), 2) as revenue,
              round(sum(l_extendedprice) filter (where l_returnflag = 'R'), 2) as refunds from lineitem""",
)
def r06_refunds(spark, folder):
    parts = {"revenue": F.col("l_returnflag") != "R", "refunds": F.col("l_returnflag") == "R"}
    return datachecks.split_totals(load(spark, folder, "lineitem"), "l_extendedprice", parts)


@add(
    "r06_compensation_tiers",
    """select case when l_quantity > 40 then 'full' when l_quantity > 18 then 'half' else 'none' end as tier, count(*) as lines
       from lineitem group by 1""",
)
def r06_tiers(spark, folder):
    tiered = datachecks.with_tier(load(spark, folder, "lineitem"), "l_quantity", [(18, "half"), (40, "full")], "none")
    return tiered.groupBy("tier").agg(F.count("*").alias("lines"))


@add("r07_rules_in_scope", f"with {_STATUS} select answer_id, rule from scoped", ("v_answers",))
def r07(spark, folder):
    return rules.rules_in_scope(_answers(spark, folder), RULES)


@add(
    "r08_verify_answers",
    f"""with {_STATUS}, judged as (
            select a.answer_id, coalesce(string_agg(s.rule, ',' order by s.rule) filter (where status = 'fail'), '') as failed_rules,
                   coalesce(string_agg(s.rule, ',' order by s.rule) filter (where status = 'manual'), '') as manual_rules,
                   count(*) filter (where status in ('fail', 'manual', 'pass')) as n
            from v_answers a left join (select * from s join scoped using (answer_id, rule) where severity = 'error') s using (answer_id) group by 1),
          outside as (select answer_id, string_agg(t, ',' order by t) as out_of_scope from used
                      where agent_id = 'sales' and t not in ('orders', 'lineitem', 'part') or agent_id = 'support' and t <> 'customer' group by 1)
        select answer_id, failed_rules, manual_rules, coalesce(out_of_scope, '') as out_of_scope, n = 0 as no_rule,
               failed_rules = '' and out_of_scope is null as verified
        from judged left join outside using (answer_id)""",
    ("v_answers",),
)
def r08(spark, folder):
    verified = rules.verify_answers(_answers(spark, folder), RULES, POLICY)
    return verified.select(
        "answer_id",
        F.array_join(F.array_sort("failed_rules"), ",").alias("failed_rules"),
        F.array_join(F.array_sort("manual_rules"), ",").alias("manual_rules"),
        F.array_join(F.array_sort("out_of_scope"), ",").alias("out_of_scope"),
        "no_rule",
        "verified",
    )


@add(
    "r09_consistency",
    f"""with {_STATUS}, by_text as (select a.answer_id, d.rule from v_answers a join domain d on contains(lower(coalesce(a.result_text, '')), d.t)),
            j as (select a.answer_id, coalesce(string_agg(b.rule, ',' order by b.rule) filter (where b.status = 'fail'), '') as violated_rules,
                         coalesce(string_agg(b.rule, ',' order by b.rule) filter (where b.status = 'manual'), '') as manual_rules
                  from v_answers a left join (select * from s join by_text using (answer_id, rule) where method not in ('sql_pattern', 'pii_columns')) b using (answer_id) group by 1)
        select answer_id, 7::bigint as rules_checked, violated_rules, manual_rules, violated_rules = '' as consistent from j""",
    ("v_answers",),
)
def r09(spark, folder):
    found = rules.consistency(_answers(spark, folder), RULES, _PII)
    return found.select(
        "answer_id",
        "rules_checked",
        F.array_join(F.array_sort("violated_rules"), ",").alias("violated_rules"),
        F.array_join(F.array_sort("manual_rules"), ",").alias("manual_rules"),
        "consistent",
    )


@add(
    "r09_consistency_listed",
    f"""with {_STATUS} select answer_id, 2::bigint as rules_checked, string_agg(case when status = 'fail' then rule end, ',' order by rule) is null as consistent
        from s where rule in ('refunds_apart', 'compensation_threshold') group by 1""",
    ("v_answers",),
)
def r09_listed(spark, folder):
    listed = ["refunds_apart", "compensation_threshold"]
    found = rules.consistency(_answers(spark, folder), RULES, _PII, listed)
    return found.select("answer_id", "rules_checked", "consistent")


@add(
    "r10_match_rules",
    """with c as (
            select answer_id as context_id, case agent_id when 'sales' then ['public.Orders', 'part'] when 'support' then ['customer'] else [] end as tables,
                   case when answer_id % 3 = 0 then ['orders.revenue', 'Lineitem.lines'] else [] end as metrics, lower(coalesce(sql_text, '')) as sql from v_answers),
          targets(rule, pos, target) as (values ('revenue_excludes_cancelled', 1, 'orders.revenue'), ('revenue_excludes_cancelled', 2, 'orders.avg_value'),
              ('compensation_threshold', 1, 'customer.delays'), ('refunds_apart', 1, 'lineitem.returned'), ('private_names', 1, 'customer.customer_count'),
              ('seat_unique', 1, 'lineitem.lines'), ('checked_elsewhere', 1, 'orders.total_orders')),
          hits as (
            select context_id, rule, pos, target, split_part(target, '.', 1) as t,
                   len(list_filter(tables, lambda x: lower(split_part(x, '.', -1)) = split_part(target, '.', 1))) > 0 as by_table,
                   len(list_filter(metrics, lambda x: lower(x) = target)) > 0 as by_metric,
                   sql <> '' and (contains(sql, split_part(target, '.', 1)) or contains(sql, target)) as by_sql
            from c, targets),
          strong as (select *, bool_or(by_table or by_metric) over (partition by context_id, rule order by pos) as stronger from hits),
          parts as (
            select context_id, rule, pos, 1 as k, 'table: ' || t as m from strong where by_table
            union all select context_id, rule, pos, 2, 'metric: ' || target from strong where by_metric
            union all select context_id, rule, pos, 3, 'sql_text: ' || target from strong where by_sql and not stronger)
       select context_id, rule, string_agg(m, ';' order by pos, k) as matched_on from parts group by 1, 2""",
    ("v_answers",),
)
def r10(spark, folder):
    answers = _answers(spark, folder)
    tables = (
        F.when(F.col("agent_id") == "sales", F.array(F.lit("public.Orders"), F.lit("part")))
        .when(F.col("agent_id") == "support", F.array(F.lit("customer")))
    )
    metrics = F.when(F.col("answer_id") % 3 == 0, F.array(F.lit("orders.revenue"), F.lit("Lineitem.lines")))
    contexts = answers.select(
        F.col("answer_id").alias("context_id"), tables.alias("tables"), metrics.alias("metric_refs"), "sql_text"
    )
    matched = rules.match_rules(contexts, RULES)
    return matched.withColumn("matched_on", F.array_join("matched_on", ";"))


@add(
    "r11_confidence",
    """with base as (select 's' || cast(user_id as varchar) as session_id, event_id, event_type, value from events),
            own as (select session_id, count(*) as n from v_outcomes group by 1),
            scored as (
              select event_id, b.session_id, case when event_type in ('view', 'click') then 0.95 else 1.0 end as freshness,
                     least(case event_type when 'view' then 2 when 'error' then 7 else 0 end / 6.0, 1.0) as rules,
                     case event_type when 'view' then 3 when 'error' then 2 else 1 end / 2.0 as coverage,
                     (select count(session_id) from v_outcomes) - coalesce(n, 0) as others
              from base b left join own o using (session_id)),
            total as (select *, case when others > 10 then 0.9 when others > 3 then 0.7 when others > 0 then 0.6 else 0.5 end as precedent from scored),
            t as (select *, freshness * 0.3 + rules * 0.3 + coverage * 0.25 + precedent * 0.15 as x from total)
       select session_id, freshness::double as freshness, rules::double as rules, coverage::double as coverage, precedent::double as precedent,
              round(x, 2)::double as score, case when x >= 0.8 then 'high' when x >= 0.5 then 'medium' else 'low' end as confidence from t""",
    ("v_outcomes",),
)
def r11(spark, folder):
    def repeat(n_by_type, other):
        size = F.lit(other)
        for kind, n in n_by_type.items():
            size = F.when(F.col("event_type") == kind, n).otherwise(size)
        return F.when(size > 0, F.array_repeat(F.lit("x"), size)).otherwise(F.array().cast("array<string>"))

    sessions = load(spark, folder, "events").select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.when(F.col("event_type").isin("view", "click"), F.array(F.lit("public.orders"), F.lit("part")))
        .otherwise(F.array(F.lit("part")))
        .alias("tables_used"),
        repeat({"view": 2, "error": 7}, 0).alias("rules_checked"),
        repeat({"view": 3, "error": 2}, 1).alias("agents_consulted"),
    )
    return rules.confidence(sessions, view(spark, folder, "v_outcomes"), ["orders"], error_rules=6, domain_agents=2)
