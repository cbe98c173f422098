"""Checks over a log of metric requests.

A request row has ``request_id``, ``measures`` and ``dimensions`` (arrays of
refs), ``filters`` (array of ``field, op, value`` structs), ``time_start`` and
``time_end``. The model declarations are small literals, so every check is a
column expression on the row and the log is never shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward import fixed
from tallyward.functions.literals import list_map, lookup, text_array, text_map
from tallyward.plans.model import Model, Scope, Semantics, WindowRule

DAY_MICROS = 86_400_000_000


def _model_of(ref: Column) -> Column:
    return F.substring_index(ref, ".", 1)


def _empty() -> Column:
    return F.array().cast("array<string>")


def audit_requests(requests: DataFrame, semantics: Semantics, scope: Scope) -> DataFrame:
    """``request_id, code``: one row for each reason a request would be refused."""
    agg_of = text_map({f"{m.name}.{s.name}": s.agg for m in semantics.models for s in m.measures})
    dims = F.coalesce("dimensions", _empty())
    # the model lists are columns of their own so that each is worked out once per request
    staged = (
        requests.filter(F.size("measures") > 0)
        .withColumn("_measure_models", F.array_distinct(F.transform("measures", _model_of)))
        .withColumn("_models", F.array_union("_measure_models", F.transform(dims, _model_of)))
        .withColumn("_models", F.sort_array("_models"))
        .withColumn("_first", F.element_at("_models", 1))
    )
    additive = F.exists("measures", lambda r: lookup(agg_of, r).isin(*fixed.ADDITIVE))
    fanout = (F.size("_measure_models") > 1) & additive

    allowed = [m.name for m in semantics.models if m.table in scope.bundle.tables]
    outside = F.size(F.array_except("_models", text_array(allowed))) > 0

    reachable = {one.name: [one.name] for one in semantics.models}
    for one in semantics.models:
        for two in semantics.models:
            link = None if one is two else semantics.link(one, two)
            if link and any(link.same_as(a) for a in scope.bundle.links):
                reachable[one.name].append(two.name)
    from_first = F.coalesce(lookup(list_map(reachable), F.col("_first")), _empty())
    disallowed = (F.size("_models") > 1) & (
        F.size(F.array_except("_models", F.array_union(F.array("_first"), from_first))) > 0
    )

    unbounded = []
    for n, rule in enumerate(scope.bundle.windows):
        owner = next((m for m in semantics.models if m.table == rule.table), None)
        if owner is not None:
            low, high = _bounds(semantics, rule, owner)
            staged = staged.withColumn(f"_low{n}", low).withColumn(f"_high{n}", high)
            low, high = F.col(f"_low{n}"), F.col(f"_high{n}")
            days = F.ceil((F.unix_micros(high) - F.unix_micros(low)) / F.lit(DAY_MICROS))
            wide = low.isNull() | high.isNull() | (days > rule.max_days)
            unbounded.append(F.array_contains("_models", owner.name) & wide)
    codes = F.array_compact(
        F.array(
            F.when(outside, F.lit("out_of_bundle")),
            F.when(disallowed, F.lit("disallowed_join")),
            F.when(fanout, F.lit("fanout_refused")),
            F.when(reduce(or_, unbounded, F.lit(False)), F.lit("time_filter_required")),
        )
    )
    return staged.select("request_id", F.explode(codes).alias("code"))


def _bounds(semantics: Semantics, rule: WindowRule, owner: Model) -> tuple[Column, Column]:
    """The first lower and the first upper bound a request sets on the ruled column."""
    timed = text_array([m.name for m in semantics.models if m.time_column])
    # array_intersect keeps the order of the sorted model list
    first_timed = F.try_element_at(F.array_intersect("_models", timed), F.lit(1))
    by_range = (first_timed == owner.name) & F.lit(owner.time_column == rule.column)
    refs = text_array([f"{owner.name}.{d.name}" for d in owner.dimensions if d.column == rule.column])
    filters = F.coalesce("filters", F.array().cast("array<struct<field:string,op:string,value:string>>"))

    def first_bound(ops: tuple[str, str], ranged: Column) -> Column:
        mine = F.filter(filters, lambda f: F.array_contains(refs, f["field"]) & f["op"].isin(*ops))
        filtered = F.try_element_at(mine, F.lit(1))["value"]
        return F.coalesce(F.when(by_range, ranged), filtered).try_cast("timestamp")

    return first_bound((">", ">="), F.col("time_start")), first_bound(("<", "<="), F.col("time_end"))


def resolve_refs(refs: DataFrame, semantics: Semantics, column: str = "ref") -> DataFrame:
    """Add ``status`` and ``suggestion`` to a table of measure refs.

    A suggestion is the nearest measure name of the same model if its edit
    distance is at most two or a third of the given name's length.
    """
    ref = F.col(column)
    names = lookup(list_map({m.name: [s.name for s in m.measures] for m in semantics.models}), _model_of(ref))
    field = F.expr(f"substring(`{column}`, instr(`{column}`, '.') + 1)")
    qualified = F.contains(ref, F.lit(".")) & (F.length(field) > 0)
    status = (
        F.when(~F.contains(ref, F.lit(".")), "ambiguous_ref")
        .when(names.isNull(), "unknown_model")
        .when(~qualified, "ambiguous_ref")
        .when(F.array_contains(names, field), "ok")
        .otherwise("unknown_measure")
    )
    ranked = F.array_min(
        F.transform(names, lambda n, i: F.struct(F.levenshtein(n, field).alias("d"), i.alias("i"), n.alias("n")))
    )
    reach = F.greatest(F.lit(2), F.floor(F.length(field) / 3))
    out = refs.withColumn("status", status).withColumn("_near", ranked)
    return out.withColumn(
        "suggestion", F.when((F.col("status") == "unknown_measure") & (F.col("_near.d") <= reach), F.col("_near.n"))
    ).drop("_near")
