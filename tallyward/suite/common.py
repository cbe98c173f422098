"""Registration of queries with their SQL twins, and shared inputs.

The inputs of operators that need more than the plain tables are views over
them. Their texts are valid in Spark and in DuckDB alike; both sides read
whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.plans.model import (
    Agent,
    Bundle,
    Condition,
    Dimension,
    Link,
    Measure,
    Model,
    Policy,
    Semantics,
    WindowRule,
)
from tallyward.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


class Suite:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        """Register the decorated query under ``name`` with its SQL twin."""

        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = with_views(sql, views)
            return query

        return register


AS_OF = "2024-01-31 00:00:00"

VIEWS: dict[str, str] = {
    # orders with some nulls
    "v_nulls": """
        select o_orderkey, o_custkey, o_orderstatus, o_orderdate,
               nullif(o_orderpriority, '5-LOW') as o_orderpriority,
               case when o_orderkey % 9 = 0 then null else o_totalprice end as o_totalprice
        from {orders}""",
    # a query log: agent by event type, text by the event's value
    "v_query_log": """
        select event_id as query_id, ts,
               case event_type when 'view' then 'sales' when 'signup' then 'sales' when 'click' then 'support'
                    when 'purchase' then 'planner' else 'ghost' end as agent_id,
               'query_data' as tool_name,
               case cast(floor(value * 10) as bigint) % 14
                 when 0 then 'SELECT o_orderkey, o_totalprice AS price FROM orders LIMIT 10'
                 when 1 then 'SELECT l.l_quantity, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LIMIT 50'
                 when 2 then 'SELECT c_name FROM customer LIMIT 10'
                 when 3 then 'SELECT * FROM customer LIMIT 10'
                 when 4 then 'select o_orderkey from orders'
                 when 5 then 'SELECT o_orderkey FROM orders LIMIT 5000'
                 when 6 then 'SELECT o_orderkey FROM orders LIMIT 1; SELECT l_tax FROM lineitem LIMIT 1'
                 when 7 then 'DELETE FROM orders'
                 when 8 then 'SELECT s_name FROM public.supplier LIMIT 5'
                 when 9 then 'SELECT o.o_orderkey FROM orders o JOIN lineitem l ON o.o_custkey = l.l_suppkey LIMIT 5'
                 when 10 then 'SELECT c_mktsegment, count(*) AS n FROM public.customer GROUP BY c_mktsegment LIMIT 20'
                 when 11 then 'SELECT created_at, o_orderkey FROM orders WHERE c_name is null limit 7'
                 when 12 then ''
                 else 'SELECT p_name FROM "part" LIMIT 3' end as sql_text
        from {events}""",
    # answers: query texts and short results
    "v_answers": """
        select event_id as answer_id,
               case event_type when 'view' then 'sales' when 'signup' then 'sales' when 'click' then 'support'
                    when 'purchase' then 'planner' else 'ghost' end as agent_id,
               case cast(floor(value * 10) as bigint) % 7
                 when 0 then 'SELECT sum(o_totalprice) FROM orders LIMIT 1'
                 when 1 then 'SELECT sum(o_totalprice) FROM orders WHERE o_orderstatus <> CANCELLED LIMIT 1'
                 when 2 then 'SELECT c_name FROM customer LIMIT 10'
                 when 3 then 'SELECT l_returnflag FROM lineitem LIMIT 5'
                 when 4 then 'SELECT s_name FROM public.supplier'
                 when 5 then null
                 else 'SELECT o_orderkey FROM public.orders' end as sql_text,
               case cast(floor(value * 10) as bigint) % 5
                 when 0 then 'Delay compensation is due after 3 hours for orders'
                 when 1 then 'Delay compensation was paid to customer accounts'
                 when 2 then 'Refunds are netted in lineitem revenue'
                 when 3 then null
                 else 'Nothing to report' end as result_text
        from {events}""",
    "v_proposals": """
        select event_id as proposal_id, 's' || cast(user_id as varchar(20)) as session_id,
               case event_type when 'view' then 'sales' when 'signup' then 'support' when 'click' then 'planner'
                    else 'ghost' end as agent_id,
               case event_type when 'view' then 'low' when 'signup' then 'medium' when 'click' then 'high'
                    when 'purchase' then 'critical' else 'low' end as risk_class,
               case cast(floor(value) as bigint) % 5 when 0 then 'send_note' when 1 then 'raise_flag'
                    when 2 then 'move_order' when 3 then 'stop_order' else 'paint_shelf' end as action_type,
               case when value > 60 then event_id + 1000000000 else event_id end as evidence_event_id,
               ts as created_at
        from {events}""",
    "v_approvals": """
        select event_id * 2 as approval_id, event_id as proposal_id,
               case event_type when 'view' then 'auto' when 'signup' then 'human:ann' when 'click' then 'support'
                    else 'sales' end as approved_by,
               value < 70 as approved, ts + interval '1' hour as created_at
        from {events} where value > 10
        union all
        select event_id * 2 + 1 as approval_id, event_id as proposal_id, 'human:bob' as approved_by,
               event_type <> 'error' as approved, ts + interval '3' hour as created_at
        from {events} where value > 50""",
    "v_actions": """
        select event_id as action_id, event_id as proposal_id,
               case event_type when 'view' then 'send_note' else 'call_expert' end as action_type,
               case when value > 90 then 'failed' else 'completed' end as status,
               ts + interval '2' hour as created_at
        from {events} where value > 25
        union all
        select event_id + 500000000 as action_id, event_id as proposal_id, 'call_expert' as action_type,
               'completed' as status, ts + interval '4' hour as created_at
        from {events} where value > 65""",
    "v_outcomes": """
        select event_id as outcome_id, 's' || cast(user_id as varchar(20)) as session_id,
               'Why did ' || event_type || ' happen to ' || cast(user_id as varchar(20)) || '?' as question,
               'Decided on ' || event_type || ' with c_name known' as decision_summary,
               'Because of value ' || cast(cast(floor(value) as bigint) as varchar(20)) as reasoning,
               case when value > 40 then 'high' when value > 20 then 'medium' else 'low' end as confidence,
               case event_type when 'view' then 'sales,support' when 'signup' then 'support'
                    when 'click' then 'planner,sales' else 'ghost' end as agents_text,
               event_id as evidence_proposal_id, ts + interval '5' hour as created_at
        from {events} where value > 30""",
    "v_findings": """
        select event_id as finding_id, 's' || cast(user_id as varchar(20)) as session_id,
               case event_type when 'view' then 'sales' when 'signup' then 'support' else 'planner' end as agent_id,
               event_type || ' of c_name seen' as finding,
               case when value > 20 then 'high' else 'low' end as confidence,
               case event_type when 'view' then 'orders,lineitem' when 'click' then 'lineitem,orders'
                    when 'error' then null else 'customer' end as sources_text,
               ts as created_at
        from {events}""",
    "v_memory": """
        select doc_id as memory_id,
               case doc_id % 3 when 0 then 'agent' when 1 then 'bundle' else 'global' end as scope_type,
               case doc_id % 3 when 0 then 'sales' when 1 then 'sales_bundle' else 'global' end as scope_id,
               case doc_id % 5 when 0 then 'candidate' when 1 then 'retired' else 'active' end as status,
               text as title, text as summary,
               cast(doc_id % 10 as double) / 10 as confidence, n_chars as created_at
        from {documents}""",
    "v_past": """
        select doc_id as outcome_id, text as question, text as decision_summary, n_chars as created_at
        from {documents}""",
    "v_questions": """
        select conv_id * 100 + turn as question_id, text as question from {conversations} where role = 'user'
        union all
        select -1 - conv_id as question_id, 'a b c' as question from {conversations} where role = 'system'""",
    "v_chats": """
        select conv_id as chat_id, 'u' || cast(conv_id % 7 as varchar(20)) as user_id, 'proj' as project_id,
               min(text) as title,
               timestamp '2024-01-30 12:00:00' - cast(conv_id % 40 as int) * interval '1' day as updated_at
        from {conversations} group by conv_id""",
    "v_messages": """
        select conv_id * 100 + turn as message_id, conv_id as chat_id, role,
               case when role = 'assistant' then 'p' || cast(1 + conv_id % 3 as varchar(20)) end as provider,
               case when role = 'assistant' then 'm' || cast(turn % 2 as varchar(20)) end as model_id,
               timestamp '2024-01-30 12:00:00' - cast(conv_id % 40 as int) * interval '1' day
                 + cast(turn as int) * interval '1' minute as created_at
        from {conversations}""",
    "v_parts": """
        select conv_id * 100 + turn as message_id,
               case when turn % 4 = 0 then null else cast(length(text) as bigint) end as input_no_cache,
               cast(length(role) as bigint) as input_cache_read,
               cast(turn as bigint) as input_cache_write,
               cast(length(text) as bigint) as output_total,
               cast(length(text) * 2 as bigint) as total
        from {conversations}
        union all
        select conv_id * 100 + turn as message_id, cast(7 as bigint), cast(null as bigint), cast(turn as bigint), cast(1 as bigint), cast(8 as bigint)
        from {conversations} where turn % 2 = 1""",
    "v_prices": """
        select * from (values ('p1', 'm0', 3.0, 0.3, 3.75, 15.0), ('p1', 'm1', 1.0, 0.1, 1.25, 5.0),
                              ('p2', 'm0', 2.5, 0.25, 0.0, 10.0), ('p2', 'm1', 0.5, 0.05, 0.0, 2.0))
        as t(provider, model_id, price_no_cache, price_cache_read, price_cache_write, price_output)""",
    "v_feedback": """
        select conv_id * 100 + turn as message_id, case when length(text) % 2 = 0 then 'up' else 'down' end as vote,
               'because of ' || role as explanation,
               timestamp '2024-01-30 12:00:00' - cast(conv_id % 40 as int) * interval '1' day
                 + cast(turn as int) * interval '1' hour as created_at
        from {conversations} where role = 'assistant'""",
    # catalog metadata told from the part table
    "v_columns": """
        select distinct replace(p_name, ' ', '_') as table_name, lower(p_type) || '_' || cast(p_size as varchar(20)) as column_name,
               case when p_size >= 45 then 'PII.High' when p_size >= 41 then 'Sensitive' else 'General' end as tag
        from {part}""",
    "v_policy_pii": """
        select distinct replace(p_name, ' ', '_') as table_name, lower(p_type) || '_' || cast(p_size as varchar(20)) as column_name
        from {part} where p_size >= 43 and p_type <> 'PROMO' or p_size = 7""",
    "v_bundle_tables": """
        select distinct lower(p_brand) as bundle_id, replace(p_name, ' ', '_') as table_name
        from {part} where p_name not like 'red%'""",
    "v_rule_targets": """
        select distinct lower(p_type) || '_' || lower(p_brand) as rule, replace(p_name, ' ', '_') || '.' || lower(p_type) as target
        from {part} where p_name like 'small%' or p_name like 'blue%'""",
    "v_bundle_joins": """
        select distinct lower(p_brand) as bundle_id, replace(p_name, ' ', '_') as left_table, lower(p_type) as left_column,
               case when p_size > 25 then 'hot_gear' else 'small_ring' end as right_table, 'id' as right_column
        from {part}""",
    "v_models": """
        select distinct lower(p_type) || '_' || replace(p_name, ' ', '_') as model, replace(p_name, ' ', '_') as table_name
        from {part}""",
    # a tree over all part keys
    "v_edges": """
        select 'db.public.t' || cast(cast(floor(p_partkey / 3) as bigint) as varchar(20)) as from_node,
               'db.public.t' || cast(p_partkey as varchar(20)) as to_node
        from {part} where p_partkey > 0""",
    "v_named_edges": """
        select distinct 'db.public.' || replace(p_name, ' ', '_') as from_node, 'db.public.' || lower(p_brand) as to_node
        from {part}""",
    # glossary terms and tables told from documents
    "v_terms": """
        select 'term ' || cast(doc_id as varchar(20)) as name, text as description, lang || ';' || source as synonyms_text
        from {documents}""",
    "v_context_terms": """
        select distinct p_name as name, p_brand || ' ' || p_type as synonyms_text from {part}""",
    "v_context_tables": """
        select 'part_' || cast(p_partkey as varchar(20)) as table_name, p_name || ' ' || p_type || ' ' || p_brand as description,
               case p_size when 1 then 'glossary.small ring' when 2 then 'glossary.red widget' when 3 then 'glossary.hot gear'
                    else 'size ' || cast(p_size as varchar(20)) end as tag
        from {part}""",
    "v_context_questions": """
        select conv_id * 100 + turn as question_id,
               case turn when 0 then 'How many small ring items came from ' || text
                    when 1 then 'Is part_17 right about ' || text
                    when 2 then 'And Brand#12 of ' || text
                    else text end as question
        from {conversations}""",
    # metric requests told from events
    "v_requests": """
        select event_id as request_id,
               case event_type when 'view' then 'orders.total_orders' when 'click' then 'orders.revenue,lines.quantity'
                    when 'purchase' then 'lines.max_price,orders.customers' when 'error' then 'customers.customer_count'
                    else 'suppliers.supplier_count' end as measures_text,
               case cast(floor(value) as bigint) % 4 when 0 then 'orders.priority' when 1 then 'lines.return_flag'
                    when 2 then '' else 'customers.segment' end as dimensions_text,
               case when value > 30 then null else '1996-01-01' end as time_start,
               case when value > 30 then null
                    else substr(cast(timestamp '1996-01-01 00:00:00' + cast(floor(value * 12) as int) * interval '1' day as varchar(40)), 1, 10)
               end as time_end,
               case when value > 45 then '1997-03-01' when value > 38 then '1997-02-01' end as low_bound,
               case when value > 60 then null when value > 38 then '1997-05-01' end as high_bound
        from {events}""",
    "v_refs": """
        select event_id as ref_id,
               case cast(floor(value * 10) as bigint) % 6 when 0 then 'orders.total_orders' when 1 then 'orders.total_order'
                    when 2 then 'lines.quantty' when 3 then event_type when 4 then event_type || '.lines'
                    else 'orders.' || event_type end as ref
        from {events}""",
    # incoming events as maps in JSON text
    "v_incoming": """
        select event_id as row_no, event_type,
               case cast(floor(value * 10) as bigint) % 6
                 when 0 then '{{"user_id":"' || cast(user_id as varchar(20)) || '"}}'
                 when 1 then '{{"user_id":"' || cast(user_id as varchar(20)) || '.0"}}'
                 when 2 then '{{"user_id":"' || cast(user_id as varchar(20)) || '.5"}}'
                 when 3 then '{{"user_id":"x"}}'
                 when 4 then '{{"order_id":"1","user_id":"2"}}'
                 else '{{}}' end as correlations_text,
               case when value > 20 then props end as metadata
        from {events}""",
}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """The DuckDB text of a query over the named views."""
    plain = {t: t for t in TABLES}
    parts = [f"{v} as ({VIEWS[v].format(**plain)})" for v in views]
    if not parts:
        return sql
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(parts)}, {body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(parts)}, {body[5:]}"
    return f"with {', '.join(parts)} {body}"


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Spark side of a view."""
    text = VIEWS[name]
    used = {t: load(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def words(column: str, separator: str = ","):
    """A joined text as an array; empty and null text give null."""
    return F.when(F.col(column) != "", F.split(column, separator))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round doubles whose last digits depend on the order of summation."""
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


SEMANTICS = Semantics(
    models=(
        Model(
            "orders",
            "orders",
            dimensions=(
                Dimension("priority", "o_orderpriority"),
                Dimension("status", "o_orderstatus"),
                Dimension("order_date", "o_orderdate"),
            ),
            measures=(
                Measure("total_orders", "o_orderkey", "count"),
                Measure("priced_orders", "o_totalprice", "count"),
                Measure("open_orders", "o_orderkey", "count", (Condition("o_orderstatus", "=", "O"),)),
                Measure(
                    "big_open_orders",
                    "o_orderkey",
                    "count",
                    (Condition("o_orderstatus", "=", "O"), Condition("o_totalprice", ">=", 250000.0)),
                ),
                Measure("cancelled_orders", "o_orderkey", "count", (Condition("o_orderstatus", "=", "F"),)),
                Measure("revenue", "o_totalprice", "sum"),
                Measure("avg_value", "o_totalprice", "avg"),
                Measure("least_price", "o_totalprice", "min"),
                Measure("top_price", "o_totalprice", "max"),
                Measure("customers", "o_custkey", "count_distinct"),
            ),
            time_column="o_orderdate",
        ),
        Model(
            "lines",
            "lineitem",
            dimensions=(
                Dimension("return_flag", "l_returnflag"),
                Dimension("line_status", "l_linestatus"),
                Dimension("ship_date", "l_shipdate"),
                Dimension("order_key", "l_orderkey"),
                Dimension("part_key", "l_partkey"),
            ),
            measures=(
                Measure("lines", "l_orderkey", "count"),
                Measure("quantity", "l_quantity", "sum"),
                Measure("returned", "l_orderkey", "count", (Condition("l_returnflag", "=", "R"),)),
                Measure("max_price", "l_extendedprice", "max"),
                Measure("avg_discount", "l_discount", "avg"),
                Measure("parts_used", "l_partkey", "count_distinct"),
            ),
            time_column="l_shipdate",
        ),
        Model(
            "customers",
            "customer",
            dimensions=(Dimension("segment", "c_mktsegment"), Dimension("nation", "c_nationkey")),
            measures=(
                Measure("customer_count", "c_custkey", "count"),
                Measure("avg_balance", "c_acctbal", "avg"),
            ),
        ),
        Model(
            "parts",
            "part",
            dimensions=(Dimension("brand", "p_brand"), Dimension("part_type", "p_type")),
            measures=(Measure("part_count", "p_partkey", "count"),),
        ),
        Model(
            "suppliers",
            "supplier",
            dimensions=(Dimension("supplier_nation", "s_nationkey"),),
            measures=(Measure("supplier_count", "s_suppkey", "count"),),
        ),
    ),
    links=(
        Link("lineitem", "l_orderkey", "orders", "o_orderkey"),
        Link("orders", "o_custkey", "customer", "c_custkey"),
        Link("lineitem", "l_partkey", "part", "p_partkey"),
        Link("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ),
)

SALES = Bundle(
    "sales_bundle",
    ("orders", "lineitem", "part"),
    (Link("lineitem", "l_orderkey", "orders", "o_orderkey"), Link("lineitem", "l_partkey", "part", "p_partkey")),
    (WindowRule("orders", "o_orderdate", 90),),
)
SUPPORT = Bundle("support_bundle", ("customer",))

POLICY = Policy(
    agents=(
        Agent("sales", "domain", "sales_bundle"),
        Agent("support", "domain", "support_bundle"),
        Agent("planner", "orchestrator", None, can_query=False),
    ),
    bundles=(SALES, SUPPORT),
    pii={"customer": ("c_name",)},
    max_rows=500,
    revision="r1",
)
# the policy to compare with: no limit check, supplier in scope, phone-like column blocked
POLICY_NEXT = Policy(
    agents=(
        Agent("sales", "domain", "sales_bundle"),
        Agent("support", "domain", "support_bundle"),
        Agent("planner", "domain", "sales_bundle"),
    ),
    bundles=(Bundle("sales_bundle", ("orders", "lineitem", "part", "supplier"), SALES.links), SUPPORT),
    pii={"customer": ("c_name", "c_mktsegment")},
    max_rows=10000,
    revision="r2",
)
