"""Metric requests over the order tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.operators.signals import step_durations
from tallyward.plans import distincts, questions
from tallyward.plans.audits import audit_requests, resolve_refs
from tallyward.plans.metrics import metric_query
from tallyward.plans.model import Filter, Request, Scope
from tallyward.session import cut
from tallyward.sources.tables import load, loader
from tallyward.suite.common import SALES, SEMANTICS, Suite, rounded, view, words

SUITE = Suite()
add = SUITE.add


def ask(spark, folder, request, digits=2, round_columns=(), **options):
    return rounded(metric_query(loader(spark, folder), SEMANTICS, request, **options), digits, *round_columns)


def nulls(spark, folder):
    tables = loader(spark, folder)
    return lambda name: view(spark, folder, "v_nulls") if name == "orders" else tables(name)


@add(
    "metric_open_orders",
    """select o_orderpriority as priority, count(o_orderkey) filter (where o_orderstatus = 'O') as open_orders,
              count(o_orderkey) as total_orders
       from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-04-01'
       group by 1 order by open_orders desc nulls first, priority asc nulls last limit 10""",
)
def metric_open_orders(spark, folder):
    return ask(
        spark,
        folder,
        Request(
            measures=["orders.open_orders", "orders.total_orders"],
            dimensions=["orders.priority"],
            time_range=("1996-01-01", "1996-04-01"),
            order_by=[("orders.open_orders", "desc"), ("priority", "asc")],
            limit=10,
        ),
    )


@add(
    "m01_count",
    "select o_orderpriority as priority, count(o_totalprice) as priced_orders from v_nulls group by 1",
    ("v_nulls",),
)
def m01(spark, folder):
    return metric_query(nulls(spark, folder), SEMANTICS, Request(["orders.priced_orders"], ["orders.priority"]))


@add("m02_count_distinct", "select o_orderstatus as status, count(distinct o_custkey) as customers from orders group by 1")
def m02(spark, folder):
    return ask(spark, folder, Request(["orders.customers"], ["orders.status"]))


@add(
    "m02_distinct_rollup",
    " union all ".join(
        f"""select '{grain}' as grain, o_orderstatus as status, date_trunc('{grain}', o_orderdate)::date as period, count(distinct o_custkey) as customers
            from orders group by all"""
        for grain in distincts.GRAINS
    ),
)
def m02_rollup(spark, folder):
    """One table of bitmaps per day answers every grain."""
    days = cut(distincts.day_bitmaps(load(spark, folder, "orders"), "o_custkey", "o_orderdate", ["o_orderstatus"]), "days")
    counts = [
        distincts.distinct_counts(days, grain, ["o_orderstatus"], "customers").select(
            F.lit(grain).alias("grain"), F.col("o_orderstatus").alias("status"), "period", "customers"
        )
        for grain in distincts.GRAINS
    ]
    return reduce(DataFrame.unionByName, counts)


@add(
    "m03_sum",
    "select l_returnflag as return_flag, l_linestatus as line_status, round(sum(l_quantity), 2) as quantity from lineitem group by 1, 2",
)
def m03(spark, folder):
    return ask(spark, folder, Request(["lines.quantity"], ["lines.return_flag", "lines.line_status"]), 2, ["quantity"])


@add(
    "m04_avg",
    "select o_orderpriority as priority, round(avg(o_totalprice), 2) as avg_value from v_nulls group by 1",
    ("v_nulls",),
)
def m04(spark, folder):
    request = Request(["orders.avg_value"], ["orders.priority"])
    return rounded(metric_query(nulls(spark, folder), SEMANTICS, request), 2, "avg_value")


@add(
    "m05_min_max",
    "select o_orderstatus as status, min(o_totalprice) as least_price, max(o_totalprice) as top_price from orders group by 1",
)
def m05(spark, folder):
    return ask(spark, folder, Request(["orders.least_price", "orders.top_price"], ["orders.status"]))


@add(
    "m06_filtered_measure",
    """select o_orderpriority as priority, count(o_orderkey) filter (where o_orderstatus = 'O') as open_orders,
              count(o_orderkey) filter (where o_orderstatus = 'O' and o_totalprice >= 250000) as big_open_orders
       from orders group by 1""",
)
def m06(spark, folder):
    return ask(spark, folder, Request(["orders.open_orders", "orders.big_open_orders"], ["orders.priority"]))


@add(
    "m07_group_by",
    """select o_orderpriority as priority, o_orderstatus as status, count(o_orderkey) as total_orders,
              round(sum(o_totalprice), 2) as revenue from orders group by 1, 2""",
)
def m07(spark, folder):
    request = Request(["orders.total_orders", "orders.revenue"], ["orders.priority", "orders.status"])
    return ask(spark, folder, request, 2, ["revenue"])


@add(
    "m08_global",
    """select count(o_orderkey) as total_orders, round(sum(o_totalprice), 2) as revenue,
              count(distinct o_custkey) as customers from orders where o_orderstatus = 'none'""",
)
def m08(spark, folder):
    request = Request(
        ["orders.total_orders", "orders.revenue", "orders.customers"],
        filters=[Filter("orders.status", "=", "none")],
    )
    return ask(spark, folder, request, 2, ["revenue"])


def _grain(grain):
    @add(
        f"m09_grain_{grain}",
        f"""select date_trunc('{grain}', l_shipdate) as ship_date, l_returnflag as return_flag, count(l_orderkey) as lines
            from lineitem group by 1, 2""",
    )
    def m09(spark, folder):
        return ask(
            spark,
            folder,
            Request(["lines.lines"], ["lines.ship_date", "lines.return_flag"], time_grain=grain),
        )


for _g in ["year", "quarter", "month", "week", "day", "hour"]:
    _grain(_g)


@add(
    "m10_time_range",
    """select l_returnflag as return_flag, count(l_orderkey) as lines from lineitem
       where l_shipdate >= timestamp '1997-02-10' and l_shipdate < timestamp '1998-03-01' group by 1""",
)
def m10(spark, folder):
    return ask(
        spark, folder, Request(["lines.lines"], ["lines.return_flag"], time_range=("1997-02-10", "1998-03-01"))
    )


_OPS = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


@add(
    "m11_comparisons",
    " union all ".join(
        f"select '{n}' as op, count(o_orderkey) as total_orders from orders where o_orderpriority {o} '3-MEDIUM'"
        for n, o in _OPS.items()
    ),
)
def m11(spark, folder):
    result = None
    for name, op in _OPS.items():
        part = ask(spark, folder, Request(["orders.total_orders"], filters=[Filter("orders.priority", op, "3-MEDIUM")]))
        part = part.select(F.lit(name).alias("op"), "total_orders")
        result = part if result is None else result.unionByName(part)
    return result


@add(
    "m12_in_not_in",
    """select 'in' as op, count(o_orderkey) as total_orders from v_nulls where o_orderpriority in ('1-URGENT', '2-HIGH')
       union all select 'not_in', count(o_orderkey) from v_nulls where o_orderpriority not in ('1-URGENT', '2-HIGH')
       union all select 'not_in_null', count(o_orderkey) from v_nulls where o_orderpriority not in ('1-URGENT', null)""",
    ("v_nulls",),
)
def m12(spark, folder):
    result = None
    for name, op, values in [
        ("in", "in", ["1-URGENT", "2-HIGH"]),
        ("not_in", "not_in", ["1-URGENT", "2-HIGH"]),
        ("not_in_null", "not_in", ["1-URGENT", None]),
    ]:
        request = Request(["orders.total_orders"], filters=[Filter("orders.priority", op, values=values)])
        part = metric_query(nulls(spark, folder), SEMANTICS, request).select(F.lit(name).alias("op"), "total_orders")
        result = part if result is None else result.unionByName(part)
    return result


@add(
    "m13_null_tests",
    """select 'is_null' as op, count(o_orderkey) as total_orders from v_nulls where o_orderpriority is null
       union all select 'is_not_null', count(o_orderkey) from v_nulls where o_orderpriority is not null""",
    ("v_nulls",),
)
def m13(spark, folder):
    parts = [
        metric_query(
            nulls(spark, folder), SEMANTICS, Request(["orders.total_orders"], filters=[Filter("orders.priority", op)])
        ).select(F.lit(op).alias("op"), "total_orders")
        for op in ("is_null", "is_not_null")
    ]
    return parts[0].unionByName(parts[1])


@add(
    "m14_between",
    """select o_orderstatus as status, count(o_orderkey) as total_orders from orders
       where o_orderpriority between '2-HIGH' and '4-NOT SPECIFIED' group by 1""",
)
def m14(spark, folder):
    spec = Filter("orders.priority", "between", range=("2-HIGH", "4-NOT SPECIFIED"))
    return ask(spark, folder, Request(["orders.total_orders"], ["orders.status"], [spec]))


@add(
    "m15_filter_split",
    """select o_orderpriority as priority, count(o_orderkey) as total_orders from orders where o_orderstatus <> 'P'
       group by 1 having count(o_orderkey) filter (where o_orderstatus = 'O') > 1 and avg(o_totalprice) > 1000""",
)
def m15(spark, folder):
    filters = [
        Filter("orders.status", "!=", "P"),
        Filter("orders.open_orders", ">", 1),
        Filter("orders.avg_value", ">", 1000.0),
    ]
    return ask(spark, folder, Request(["orders.total_orders"], ["orders.priority"], filters))


@add(
    "m16_join_star",
    """select o_orderpriority as priority, p_brand as brand, count(l_orderkey) as lines, round(sum(l_quantity), 2) as quantity
       from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
       where l_returnflag = 'R' group by 1, 2""",
)
def m16(spark, folder):
    request = Request(
        ["lines.lines", "lines.quantity"],
        ["orders.priority", "parts.brand"],
        [Filter("lines.return_flag", "=", "R")],
    )
    return ask(spark, folder, request, 2, ["quantity"])


@add(
    "m16_parent_repeats",
    """select l_returnflag as return_flag, count(o_orderkey) as total_orders from lineitem
       join orders on l_orderkey = o_orderkey group by 1""",
)
def m16_parent(spark, folder):
    return ask(spark, folder, Request(["orders.total_orders"], ["lines.return_flag"]))


def _requests(spark, folder):
    raw = view(spark, folder, "v_requests")
    bounds = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(c).isNotNull(),
                    F.struct(F.lit("orders.order_date").alias("field"), F.lit(op).alias("op"), F.col(c).alias("value")),
                )
                for c, op in (("low_bound", ">="), ("high_bound", "<"))
            ]
        )
    )
    return raw.select(
        "request_id",
        words("measures_text").alias("measures"),
        words("dimensions_text").alias("dimensions"),
        bounds.alias("filters"),
        "time_start",
        "time_end",
    )


_AUDIT = """
    refs as (
        select request_id, unnest(string_split(measures_text || case when dimensions_text = '' then '' else ',' || dimensions_text end, ',')) as ref
        from v_requests),
    models as (select request_id, list_sort(list(distinct split_part(ref, '.', 1))) as ms from refs group by 1),
    mm as (select request_id, count(distinct split_part(m, '.', 1)) as n,
                  bool_or(m in ('orders.total_orders', 'orders.revenue', 'lines.quantity', 'customers.customer_count', 'suppliers.supplier_count')) as additive
           from (select request_id, unnest(string_split(measures_text, ',')) as m from v_requests) group by 1),
    bounded as (
        select r.request_id, ms,
               case when ms[1] = 'customers' and not list_contains(ms, 'lines') or ms[1] = 'orders' then coalesce(time_start, low_bound) else low_bound end as lo,
               case when ms[1] = 'customers' and not list_contains(ms, 'lines') or ms[1] = 'orders' then coalesce(time_end, high_bound) else high_bound end as hi
        from v_requests r join models using (request_id)),
    codes as (
        select request_id, 'out_of_bundle' as code from models where list_contains(ms, 'customers') or list_contains(ms, 'suppliers')
        union all
        select request_id, 'disallowed_join' from models
        where len(ms) > 1 and exists (select 1 from (select unnest(ms[2:]) as m) where ms[1] || '|' || m not in ('lines|orders', 'orders|lines', 'lines|parts', 'parts|lines'))
        union all
        select request_id, 'fanout_refused' from mm where n > 1 and additive
        union all
        select request_id, 'time_filter_required' from bounded
        where list_contains(ms, 'orders') and (lo is null or hi is null or date_diff('day', cast(lo as timestamp), cast(hi as timestamp)) > 90))
"""


def _audited(name, code):
    @add(name, f"with {_AUDIT} select request_id, code from codes where code = '{code}'", ("v_requests",))
    def audit(spark, folder):
        return audit_requests(_requests(spark, folder), SEMANTICS, Scope(SALES, 500)).filter(F.col("code") == code)


_audited("m17_audit_fanout", "fanout_refused")
_audited("m21_audit_window", "time_filter_required")


@add(
    "m22_audit_scope",
    f"with {_AUDIT} select request_id, code from codes where code in ('out_of_bundle', 'disallowed_join')",
    ("v_requests",),
)
def m22(spark, folder):
    audited = audit_requests(_requests(spark, folder), SEMANTICS, Scope(SALES, 500))
    return audited.filter(F.col("code").isin("out_of_bundle", "disallowed_join"))


@add(
    "m18_drill_across",
    """with a as (select l_returnflag as return_flag, count(l_orderkey) as lines from lineitem
                   where l_returnflag <> 'A' group by 1),
            b as (select l_returnflag as return_flag, count(o_orderkey) as total_orders, count(distinct o_custkey) as customers
                  from lineitem join orders on l_orderkey = o_orderkey where l_returnflag <> 'A' group by 1)
       select coalesce(a.return_flag, b.return_flag) as return_flag, total_orders, customers, lines
       from a full join b on a.return_flag is not distinct from b.return_flag where lines > 10""",
)
def m18(spark, folder):
    request = Request(
        ["orders.total_orders", "orders.customers", "lines.lines"],
        ["lines.return_flag"],
        [Filter("lines.return_flag", "!=", "A"), Filter("lines.lines", ">", 10)],
    )
    return ask(spark, folder, request, drill_across=True)


@add(
    "m18_filter_on_one_part",
    """with a as (select l_returnflag as return_flag, count(l_orderkey) as lines from lineitem
                   where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'O') group by 1),
            b as (select l_returnflag as return_flag, count(o_orderkey) as total_orders
                  from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'O' group by 1)
       select coalesce(a.return_flag, b.return_flag) as return_flag, total_orders, lines from a full join b on a.return_flag = b.return_flag""",
)
def m18_own_filter(spark, folder):
    request = Request(
        ["orders.total_orders", "lines.lines"], ["lines.return_flag"], [Filter("orders.status", "=", "O")]
    )
    return ask(spark, folder, request, drill_across=True)


@add(
    "m18_filter_on_third_model",
    """with wanted as (select o_orderkey from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'),
            a as (select l_returnflag as return_flag, count(l_orderkey) as lines from lineitem where l_orderkey in (select o_orderkey from wanted) group by 1),
            b as (select l_returnflag as return_flag, count(o_orderkey) as total_orders from lineitem join wanted on l_orderkey = o_orderkey group by 1)
       select coalesce(a.return_flag, b.return_flag) as return_flag, total_orders, lines from a full join b on a.return_flag = b.return_flag""",
)
def m18_third_model(spark, folder):
    request = Request(
        ["orders.total_orders", "lines.lines"], ["lines.return_flag"], [Filter("customers.segment", "=", "BUILDING")]
    )
    return ask(spark, folder, request, drill_across=True)


@add(
    "m19_order_by",
    """with g as (select o_orderpriority as priority, o_orderstatus as status, count(o_orderkey) as total_orders from v_nulls group by 1, 2)
       select *, row_number() over (order by priority desc nulls first, status asc nulls last) as place from g
       order by priority desc nulls first, status asc nulls last limit 7""",
    ("v_nulls",),
)
def m19(spark, folder):
    request = Request(
        ["orders.total_orders"],
        ["orders.priority", "orders.status"],
        order_by=[("orders.priority", "desc"), ("status", "asc")],
        limit=7,
    )
    top = metric_query(nulls(spark, folder), SEMANTICS, request)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_first("priority"), "status"))
    return top.withColumn("place", place.cast("bigint"))


@add(
    "m20_top_k",
    """select p_brand as brand, p_type as part_type, count(l_orderkey) as lines from lineitem join part on l_partkey = p_partkey
       group by 1, 2 order by lines desc, brand, part_type limit 12""",
)
def m20(spark, folder):
    request = Request(
        ["lines.lines"],
        ["parts.brand", "parts.part_type"],
        order_by=[("lines.lines", "desc"), ("brand", "asc"), ("part_type", "asc")],
        limit=12,
    )
    return ask(spark, folder, request)


@add(
    "m23_resolve_refs",
    """with parts as (
           select ref_id, ref, case when contains(ref, '.') then split_part(ref, '.', 1) else ref end as model,
                  case when contains(ref, '.') then substr(ref, instr(ref, '.') + 1) else ref end as field
           from v_refs),
         catalog(model, pos, name) as (values
           ('orders', 0, 'total_orders'), ('orders', 1, 'priced_orders'), ('orders', 2, 'open_orders'), ('orders', 3, 'big_open_orders'),
           ('orders', 4, 'cancelled_orders'), ('orders', 5, 'revenue'), ('orders', 6, 'avg_value'), ('orders', 7, 'least_price'),
           ('orders', 8, 'top_price'), ('orders', 9, 'customers'), ('lines', 0, 'lines'), ('lines', 1, 'quantity'), ('lines', 2, 'returned'),
           ('lines', 3, 'max_price'), ('lines', 4, 'avg_discount'), ('lines', 5, 'parts_used'), ('customers', 0, 'customer_count'),
           ('customers', 1, 'avg_balance'), ('parts', 0, 'part_count'), ('suppliers', 0, 'supplier_count')),
         near as (select ref_id, arg_min(name, levenshtein(name, field) * 100 + pos) as name, min(levenshtein(name, field)) as d,
                         bool_or(name = field) as hit
                  from parts join catalog using (model) group by 1),
         judged as (select p.ref_id, p.ref, n.name, n.d, field,
                           case when not contains(ref, '.') then 'ambiguous_ref' when n.ref_id is null then 'unknown_model'
                                when n.hit then 'ok' else 'unknown_measure' end as status
                    from parts p left join near n using (ref_id))
       select ref_id, ref, status,
              case when status = 'unknown_measure' and d <= greatest(2, floor(length(field) / 3.0)) then name end as suggestion
       from judged""",
    ("v_refs",),
)
def m23(spark, folder):
    return resolve_refs(view(spark, folder, "v_refs"), SEMANTICS)


@add(
    "m24_cancellation_rate",
    """select count(o_orderkey) filter (where o_orderstatus = 'F') as cancelled_orders, count(o_orderkey) as total_orders,
              round(count(o_orderkey) filter (where o_orderstatus = 'F') / count(o_orderkey)::double, 4) as cancellation_rate from orders""",
)
def m24_cancellation(spark, folder):
    request = Request(["orders.cancelled_orders", "orders.total_orders"])
    return questions.ratio_query(
        loader(spark, folder), SEMANTICS, request, "cancelled_orders", "total_orders", "cancellation_rate"
    )


@add(
    "m24_failure_rate_by_method",
    """select l_linestatus as line_status, count(l_orderkey) filter (where l_returnflag = 'R') as returned, count(l_orderkey) as lines,
              round(count(l_orderkey) filter (where l_returnflag = 'R') / count(l_orderkey)::double, 4) as failure_rate
       from lineitem group by 1""",
)
def m24_failure(spark, folder):
    request = Request(["lines.returned", "lines.lines"], ["lines.line_status"])
    return questions.ratio_query(loader(spark, folder), SEMANTICS, request, "returned", "lines", "failure_rate")


@add(
    "m24_average_by_cause",
    "select l_returnflag as return_flag, round(avg(l_discount), 6) as avg_discount, count(l_orderkey) as lines from lineitem group by 1",
)
def m24_cause(spark, folder):
    return ask(spark, folder, Request(["lines.avg_discount", "lines.lines"], ["lines.return_flag"]), 6, ["avg_discount"])


@add(
    "m24_routes",
    """select s_nationkey as supplier_nation, count(l_orderkey) as lines, round(avg(l_discount), 6) as avg_discount
       from lineitem join supplier on l_suppkey = s_suppkey group by 1 order by lines desc, supplier_nation limit 10""",
)
def m24_routes(spark, folder):
    request = Request(
        ["lines.lines", "lines.avg_discount"],
        ["suppliers.supplier_nation"],
        order_by=[("lines.lines", "desc"), ("supplier_nation", "asc")],
        limit=10,
    )
    return ask(spark, folder, request, 6, ["avg_discount"])


@add(
    "m24_revenue_this_month",
    """select date_trunc('month', o_orderdate) as order_date, round(sum(o_totalprice), 2) as revenue from orders
       where o_orderdate >= timestamp '1998-05-01' and o_orderdate < timestamp '1998-06-01' group by 1""",
)
def m24_revenue(spark, folder):
    request = Request(
        ["orders.revenue"], ["orders.order_date"], time_range=("1998-05-01", "1998-06-01"), time_grain="month"
    )
    return ask(spark, folder, request, 2, ["revenue"])


@add("m24_tier_distribution", "select c_mktsegment as segment, count(c_custkey) as customer_count from customer group by 1")
def m24_tiers(spark, folder):
    return ask(spark, folder, Request(["customers.customer_count"], ["customers.segment"]))


@add(
    "m24_lead_time",
    """with pairs as (
           select a.user_id, a.event_id, a.ts as t1, min(b.ts) as t2 from events a join events b
             on a.user_id = b.user_id and b.ts > a.ts and b.event_type = 'purchase'
           where a.event_type = 'signup' and a.ts >= timestamp '2024-01-31' - interval '30' day group by 1, 2, 3)
       select 'signup' as from_step, 'purchase' as to_step, round(avg((epoch_us(t2) - epoch_us(t1)) / 60000000.0), 1) as avg_minutes,
              count(*) as sample_size from pairs""",
)
def m24_lead(spark, folder):
    found = step_durations(load(spark, folder, "events"), "user_id", ["signup"], ["purchase"], "2024-01-31", 30, top=None)
    return found.select("from_step", "to_step", "avg_minutes", "sample_size")


@add(
    "m25_frequent_customers",
    "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE')",
)
def m25_frequent(spark, folder):
    customers = load(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return questions.in_levels(customers, "c_mktsegment", ["BUILDING", "MACHINERY", "FURNITURE"])


@add(
    "m25_connecting",
    """select o_orderkey, o_custkey from orders
       where o_orderkey in (select l_orderkey from lineitem group by 1 having count(*) >= 2)""",
)
def m25_connecting(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return questions.with_count(orders, "o_orderkey", load(spark, folder, "lineitem"), "l_orderkey", 2)


@add(
    "m25_new_customers",
    "select c_custkey, c_nationkey from customer where c_custkey in (select o_custkey from orders group by 1 having count(*) = 1)",
)
def m25_new(spark, folder):
    customers = load(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return questions.with_count(customers, "c_custkey", load(spark, folder, "orders"), "o_custkey", 1, 1)


@add(
    "m26_suppress_small",
    """select c_nationkey as nation, c_mktsegment as segment, count(c_custkey) as customer_count from customer
       group by 1, 2 having count(c_custkey) >= 12""",
)
def m26(spark, folder):
    request = Request(["customers.customer_count"], ["customers.nation", "customers.segment"])
    return ask(spark, folder, request, at_least=("customer_count", 12))


@add(
    "m26_suppress_before_cut",
    """select *, true as rows_cut from (select c_nationkey as nation, c_mktsegment as segment, count(c_custkey) as customer_count from customer
       group by 1, 2 having count(c_custkey) >= 2) order by nation, segment limit 5""",
)
def m26_cut(spark, folder):
    request = Request(
        ["customers.customer_count"],
        ["customers.nation", "customers.segment"],
        order_by=[("nation", "asc"), ("segment", "asc")],
        limit=5,
    )
    return ask(spark, folder, request, at_least=("customer_count", 2), mark_cut=True)


@add(
    "m07_every_group",
    "select l_orderkey as order_key, l_partkey as part_key, count(l_orderkey) as lines from lineitem group by 1, 2",
)
def m07_every_group(spark, folder):
    """More groups than any ceiling: none is cut unless asked."""
    return ask(spark, folder, Request(["lines.lines"], ["lines.order_key", "lines.part_key"]))
