"""Metric requests as DataFrame plans.

A request names measures, dimensions and filters; the plan is one join star,
one aggregation and, where asked, a filter on the aggregates, an order and a
limit. Filters on dimensions sit below the aggregation so that Catalyst takes
them to the scans; only the columns in use are selected from each table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward import fixed
from tallyward.functions import timecols
from tallyward.operators.masking import mask_pii
from tallyward.plans.model import Bundle, Filter, Measure, Model, Refused, Request, Scope, Semantics

Tables = Callable[[str], DataFrame]

_DATE_TEXT = re.compile(r"\d{4}-\d{2}-\d{2}(T|$)")


def open_scope(semantics: Semantics, max_rows: int = 0) -> Scope:
    """A scope that allows every declared table and join, and cuts no rows unless told to."""
    tables = tuple(m.table for m in semantics.models)
    return Scope(Bundle("everything", tables, semantics.links), max_rows)


def compare(left: Column, op: str, value) -> Column:
    tests = {
        "=": lambda: left == value,
        "!=": lambda: left != value,
        "<": lambda: left < value,
        "<=": lambda: left <= value,
        ">": lambda: left > value,
        ">=": lambda: left >= value,
    }
    if op not in tests:
        raise Refused("invalid_operator", f"{op!r} is not a comparison")
    return tests[op]()


def filter_test(left: Column, spec: Filter) -> Column:
    """The Boolean column of one request filter."""
    if spec.op == "is_null":
        return left.isNull()
    if spec.op == "is_not_null":
        return left.isNotNull()
    if spec.op in ("in", "not_in"):
        if not spec.values:
            raise Refused("invalid_value", f"{spec.op} on {spec.field} needs values")
        inside = left.isin(*spec.values)
        return inside if spec.op == "in" else ~inside
    if spec.op == "between":
        if spec.range is None or len(spec.range) != 2:
            raise Refused("invalid_value", f"between on {spec.field} needs a range")
        return left.between(*spec.range)
    if spec.value is None:
        raise Refused("invalid_value", f"{spec.op} on {spec.field} needs a value")
    return compare(left, spec.op, spec.value)


def _name(model: Model, column: str) -> str:
    return f"{model.name}__{column}"


def measure_column(model: Model, measure: Measure, col: Callable[[Model, str], Column]) -> Column:
    """The aggregate of one measure under its own filters."""
    value = col(model, measure.column)
    if measure.filters:
        test = reduce(and_, [compare(col(model, c.column), c.op, c.value) for c in measure.filters])
        value = F.when(test, value)
    return {
        "count": F.count,
        "count_distinct": F.count_distinct,
        "sum": F.sum,
        "avg": F.avg,
        "min": F.min,
        "max": F.max,
    }[measure.agg](value)


def row_limit(limit: int | None, max_rows: int) -> int | None:
    """Rows to keep: what the request asks for, at most the ceiling of the scope; None keeps all."""
    if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0):
        raise Refused("invalid_value", f"limit must be a positive whole number, not {limit!r}")
    ceiling = min(max_rows, fixed.MAX_LIMIT) if max_rows > 0 else None
    return min((x for x in (limit, ceiling) if x is not None), default=None)


def _check_range(time_range: tuple[str, str]) -> None:
    start, end = time_range
    if not (_DATE_TEXT.match(start) and _DATE_TEXT.match(end)):
        raise Refused("invalid_time_range", "start and end must be ISO dates")
    if start >= end:
        raise Refused("invalid_time_range", "start must be before end")


def _days(start, end) -> float | None:
    try:
        first, last = (datetime.fromisoformat(str(v).replace("Z", "")) for v in (start, end))
    except ValueError:
        return None
    return (last - first).total_seconds() / 86400


def _check_windows(request: Request, semantics: Semantics, scope: Scope, models: list[Model]) -> None:
    """Tables under a window rule need a lower and an upper bound that are close enough."""
    timed = next((m for m in models if m.time_column), None)
    for rule in scope.bundle.windows:
        model = next((m for m in models if m.table == rule.table), None)
        if model is None:
            continue
        bounds: list[tuple[str, object]] = []
        if request.time_range and timed is model and model.time_column == rule.column:
            bounds += [(">=", request.time_range[0]), ("<", request.time_range[1])]
        for spec in request.filters:
            owner, name = semantics.split(spec.field)
            dim = owner.dimension(name)
            if owner is model and dim is not None and dim.column == rule.column:
                bounds.append((spec.op, spec.value))
        low = next((v for op, v in bounds if op in (">", ">=")), None)
        high = next((v for op, v in bounds if op in ("<", "<=")), None)
        width = None if low is None or high is None else _days(low, high)
        if width is None or -(-width // 1) > rule.max_days:
            raise Refused(
                "time_filter_required", f"{rule.table}.{rule.column} must span at most {rule.max_days} days"
            )


def _models_of(request: Request, semantics: Semantics) -> tuple[list, list, list[Model]]:
    measures = [semantics.measure(ref) for ref in request.measures]
    dimensions = [semantics.dimension(ref) for ref in request.dimensions]
    models = sorted({m.name: m for m, _ in measures + dimensions}.values(), key=lambda m: m.name)
    return measures, dimensions, models


def metric_query(
    tables: Tables,
    semantics: Semantics,
    request: Request,
    scope: Scope | None = None,
    drill_across: bool = False,
    at_least: tuple[str, int] | None = None,
    mark_cut: bool = False,
) -> DataFrame:
    """Run one metric request.

    ``tables`` gives the DataFrame of a table name. A request whose measures
    come from several models is refused when it would count parent rows
    repeatedly; with ``drill_across`` each model is aggregated by itself and
    the results are joined on the dimensions.

    All groups are returned unless the request has a limit or the scope a
    ceiling. ``at_least`` names an output column and the least value a group
    needs; such groups are dropped before any cut. ``mark_cut`` adds
    ``rows_cut``, whether there were more groups than are shown.
    """
    scope = scope or open_scope(semantics)
    if not request.measures:
        raise Refused("measure_required", "at least one measure is required")
    measure_models = {semantics.measure(ref)[0].name for ref in request.measures}
    if drill_across and len(measure_models) > 1:
        result = _drill_across(tables, semantics, request, scope)
    else:
        result = _aggregate(tables, semantics, request, scope)
    if at_least is not None:
        result = result.filter(F.col(at_least[0]) >= at_least[1])
    return mask_pii(_finish(result, request, scope, mark_cut), scope.pii_columns)


def applied(request: Request, scope: Scope) -> dict[str, object]:
    """The limit and the time window that a result of the request is subject to."""
    return {"limit": row_limit(request.limit, scope.max_rows), "time_range": request.time_range}


def _path(semantics: Semantics, scope: Scope, starts: list[Model], target: Model) -> list[tuple] | None:
    """The shortest chain of allowed links ``(from, to, link)`` from one of the models to ``target``."""
    chains: list[list[tuple]] = [[(None, m, None)] for m in starts]
    seen = {m.name for m in starts}
    while chains:
        longer = []
        for chain in chains:
            here = chain[-1][1]
            for other in semantics.models:
                link = None if other.name in seen else semantics.link(here, other)
                if link is None or other.table not in scope.bundle.tables:
                    continue
                if not any(link.same_as(allowed) for allowed in scope.bundle.links):
                    continue
                seen.add(other.name)
                longer.append([*chain, (here, other, link)])
                if other.name == target.name:
                    return longer[-1][1:]
        chains = longer
    return None


def _matching(tables: Tables, frame: DataFrame, path: list[tuple], tests: list[tuple[str, Filter]]) -> DataFrame:
    """Rows of ``frame`` that lead along ``path`` to a row which passes all tests."""
    _, model, link = path[0]
    there = tables(model.table)
    if len(path) > 1:
        there = _matching(tables, there, path[1:], tests)
    else:
        there = there.filter(reduce(and_, [filter_test(there[column], spec) for column, spec in tests]))
    keys = there.select(there[link.right_column].alias("_key"))
    return frame.join(keys, frame[link.left_column] == keys["_key"], "left_semi")


def _aggregate(
    tables: Tables, semantics: Semantics, request: Request, scope: Scope, elsewhere: list[Filter] | None = None
) -> DataFrame:
    """Join star, filters, one aggregation and the filters on aggregates; all groups.

    Filters in ``elsewhere`` test models outside the star. They keep the rows
    that lead to a passing row over declared links, or are refused.
    """
    measures, dimensions, models = _models_of(request, semantics)
    for model in models:
        if model.table not in scope.bundle.tables:
            raise Refused("out_of_bundle", f"{model.table} is not in bundle {scope.bundle.name}")
    links = []
    for other in models[1:]:
        link = semantics.link(models[0], other)
        if link is None or not any(link.same_as(allowed) for allowed in scope.bundle.links):
            raise Refused("disallowed_join", f"no allowed join from {models[0].name} to {other.name}")
        links.append((other, link))
    many = len({m.name for m, _ in measures}) > 1
    if many and any(m.agg in fixed.ADDITIVE for _, m in measures):
        raise Refused("fanout_refused", "aggregate per model, or ask for drill_across")

    if request.time_grain is not None and request.time_grain not in fixed.GRAINS:
        raise Refused("invalid_time_grain", request.time_grain)
    outputs = [d.name for _, d in dimensions] + [m.name for _, m in measures]
    if len(set(outputs)) != len(outputs):
        raise Refused("ambiguous_ref", "two output columns share a name")

    used: dict[str, set[str]] = {m.name: set() for m in models}

    def col(model: Model, column: str) -> Column:
        if model.name not in used:
            raise Refused("execution_failed", f"model {model.name} is not part of the request")
        used[model.name].add(column)
        return F.col(_name(model, column))

    before, after, hidden = [], [], []
    if request.time_range is not None:
        _check_range(request.time_range)
        timed = next((m for m in models if m.time_column), None)
        if timed is None:
            raise Refused("no_time_dimension", "no model in the request declares a time column")
        moment = col(timed, timed.time_column)
        before += [moment >= timecols.at(request.time_range[0]), moment < timecols.at(request.time_range[1])]
    for i, spec in enumerate(request.filters):
        owner, field = semantics.split(spec.field)
        if owner.measure(field) is not None:
            hidden.append(measure_column(owner, owner.measure(field), col).alias(f"_having{i}"))
            after.append(filter_test(F.col(f"_having{i}"), spec))
        elif owner.dimension(field) is not None:
            before.append(filter_test(col(owner, owner.dimension(field).column), spec))
        else:
            raise Refused("unknown_dimension", f"no field {spec.field!r}")
    _check_windows(request, semantics, scope, models)

    groups = []
    for model, dim in dimensions:
        value = col(model, dim.column)
        if request.time_grain and dim.column == model.time_column:
            value = timecols.truncate(request.time_grain, value)
        groups.append(value.alias(dim.name))
    aggregates = [measure_column(m, s, col).alias(s.name) for m, s in measures]
    for other, link in links:
        used[models[0].name].add(link.left_column)
        used[other.name].add(link.right_column)

    remote: dict[str, tuple[list[tuple], list[tuple[str, Filter]]]] = {}
    for spec in elsewhere or ():
        owner, field = semantics.split(spec.field)
        dim = owner.dimension(field)
        if dim is None:
            raise Refused("unknown_dimension", f"no field {spec.field!r}")
        if owner.name not in remote:
            path = _path(semantics, scope, models, owner)
            if path is None:
                raise Refused("disallowed_join", f"no allowed join from {models[0].name} to {owner.name}")
            remote[owner.name] = (path, [])
        remote[owner.name][1].append((dim.column, spec))

    def source(model: Model) -> DataFrame:
        frame = tables(model.table)
        for path, tests in remote.values():
            if path[0][0].name == model.name:
                frame = _matching(tables, frame, path, tests)
        return frame.select(*[frame[c].alias(_name(model, c)) for c in sorted(used[model.name])])

    joined = source(models[0])
    for other, link in links:
        on = F.col(_name(models[0], link.left_column)) == F.col(_name(other, link.right_column))
        joined = joined.join(source(other), on, "inner")
    if before:
        joined = joined.filter(reduce(and_, before))
    result = joined.groupBy(*groups).agg(*aggregates, *hidden)
    if after:
        result = result.filter(reduce(and_, after))
    return result.select(*outputs)


def _finish(result: DataFrame, request: Request, scope: Scope, mark_cut: bool = False) -> DataFrame:
    """Order, then cut where a limit or a ceiling is set."""
    keys = []
    for ref, direction in request.order_by:
        selected = zip([*request.dimensions, *request.measures], result.columns)
        found = next((name for r, name in selected if ref in (r, name)), None)
        if found is None:
            raise Refused("unknown_dimension", f"cannot order by {ref!r}, it is not selected")
        column = F.col(found)
        keys.append(column.asc_nulls_last() if direction == "asc" else column.desc_nulls_first())
    if keys:
        result = result.orderBy(*keys)
    limit = row_limit(request.limit, scope.max_rows)
    if limit is None:
        return result.withColumn("rows_cut", F.lit(False)) if mark_cut else result
    if not mark_cut:
        return result.limit(limit)
    # one row more than shown tells whether there are more; the window sees these few rows only
    head = result.limit(limit + 1)
    order = Window.orderBy(*(keys or [F.lit(0)]))
    numbered = head.select("*", F.row_number().over(order).alias("_n"), F.count("*").over(Window.partitionBy()).alias("_all"))
    return numbered.filter(F.col("_n") <= limit).select(*result.columns, (F.col("_all") > limit).alias("rows_cut"))


def _drill_across(tables: Tables, semantics: Semantics, request: Request, scope: Scope) -> DataFrame:
    """Aggregate each model on the shared dimensions, then join the results.

    Every row filter holds for every part: where its model is not in the
    part's star, rows are kept that lead to a passing row over declared links.
    Filters on measures are tested after the join, on hidden columns.
    """
    refs: dict[str, list[str]] = {}
    for ref in request.measures:
        refs.setdefault(semantics.measure(ref)[0].name, []).append(ref)
    on_measure, on_rows = [], []
    for spec in request.filters:
        owner, field = semantics.split(spec.field)
        (on_measure if owner.measure(field) else on_rows).append(spec)
    for spec in on_measure:
        owner = semantics.split(spec.field)[0].name
        if spec.field not in refs.setdefault(owner, []):
            refs[owner].append(spec.field)

    names = [semantics.dimension(d)[1].name for d in request.dimensions]
    shared = {semantics.dimension(d)[0].name for d in request.dimensions}
    result = None
    for owner, wanted in sorted(refs.items()):
        here = [f for f in on_rows if semantics.split(f.field)[0].name in shared | {owner}]
        part = Request(
            measures=wanted,
            dimensions=request.dimensions,
            filters=here,
            time_range=request.time_range,
            time_grain=request.time_grain,
        )
        frame = _aggregate(tables, semantics, part, scope, [f for f in on_rows if f not in here])
        frame = frame.toDF(*names, *[f"_m_{r}" for r in wanted])
        result = frame if result is None else _join_on_dimensions(result, frame, names)
    tests = [filter_test(F.col(f"`_m_{f.field}`"), f) for f in on_measure]
    if tests:
        result = result.filter(reduce(and_, tests))
    outputs = [F.col(f"`_m_{r}`").alias(semantics.measure(r)[1].name) for r in request.measures]
    return result.select(*names, *outputs)


def _join_on_dimensions(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    if not names:
        both = left.unionByName(right, allowMissingColumns=True)
        return both.agg(*[F.max(f"`{c}`").alias(c) for c in both.columns])
    renamed = right.toDF(*[f"_r_{n}" for n in names], *right.columns[len(names):])
    on = reduce(and_, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names])
    merged = [F.coalesce(n, f"_r_{n}").alias(n) for n in names]
    measures = [F.col(f"`{c}`") for c in left.columns[len(names):] + right.columns[len(names):]]
    return left.join(renamed, on, "full").select(*merged, *measures)
