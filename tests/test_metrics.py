import pytest
from pyspark.sql import functions as F

from tallyward.plans.audits import audit_requests, resolve_refs
from tallyward.plans.metrics import metric_query, open_scope, row_limit
from tallyward.plans.model import (
    Bundle,
    Condition,
    Dimension,
    Filter,
    Link,
    Measure,
    Model,
    Refused,
    Request,
    Scope,
    Semantics,
    WindowRule,
)

SHOP = Semantics(
    (
        Model(
            "sales",
            "sales",
            (Dimension("shop", "shop"), Dimension("day", "day")),
            (
                Measure("n", "id", "count"),
                Measure("total", "amount", "sum"),
                Measure("paid", "amount", "sum", (Condition("state", "=", "paid"),)),
                Measure("shops", "shop", "count_distinct"),
            ),
            "day",
        ),
        Model(
            "visits",
            "visits",
            (Dimension("place", "place"),),
            (Measure("visits", "id", "count"), Measure("top", "id", "max")),
        ),
    ),
    (Link("visits", "place", "sales", "shop"),),
)
BUNDLE = Bundle("b", ("sales", "visits"), SHOP.links, (WindowRule("sales", "day", 90),))


@pytest.fixture(scope="module")
def tables(spark):
    sales = spark.createDataFrame(
        [
            (1, "a", 10.0, "paid", "2024-01-01 10:00:00"),
            (2, "a", None, "open", "2024-01-02 00:00:00"),
            (3, None, 5.0, "paid", "2024-01-31 00:00:00"),
            (4, "b", 7.0, "open", "2024-02-01 00:00:00"),
        ],
        "id long, shop string, amount double, state string, day string",
    ).withColumn("day", F.col("day").cast("timestamp_ntz"))
    visits = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c")], "id long, place string")
    return {"sales": sales, "visits": visits}.__getitem__


def code(call):
    with pytest.raises(Refused) as error:
        call()
    return error.value.code


def test_nulls_in_measure_and_dimension(tables, rows):
    got = rows(metric_query(tables, SHOP, Request(["sales.n", "sales.total", "sales.paid"], ["sales.shop"])))
    assert got == [("a", 2, 10.0, 10.0), ("b", 1, 7.0, None), (None, 1, 5.0, 5.0)]


def test_empty_input_gives_one_row(tables, rows):
    request = Request(["sales.n", "sales.total", "sales.shops"], filters=[Filter("sales.shop", "=", "none")])
    assert rows(metric_query(tables, SHOP, request)) == [(0, None, 0)]


def test_not_in_with_a_null_matches_nothing(tables, rows):
    request = Request(["sales.n"], filters=[Filter("sales.shop", "not_in", values=["b", None])])
    assert rows(metric_query(tables, SHOP, request)) == [(0,)]


def test_between_takes_both_ends_and_range_end_is_open(tables, rows):
    low, high = F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-31").cast("timestamp_ntz")
    request = Request(["sales.n"], filters=[Filter("sales.day", "between", range=(low, high))])
    assert rows(metric_query(tables, SHOP, request)) == [(2,)]
    request = Request(["sales.n"], time_range=("2024-01-02", "2024-02-01"))
    assert rows(metric_query(tables, SHOP, request)) == [(2,)]


def test_filter_on_a_measure_that_is_not_selected(tables, rows):
    request = Request(["sales.n"], ["sales.shop"], [Filter("sales.total", ">", 6.0)])
    assert rows(metric_query(tables, SHOP, request)) == [("a", 2), ("b", 1)]


def test_parent_rows_repeat_across_a_join(tables, rows):
    request = Request(["sales.total"], ["visits.place"])
    assert rows(metric_query(tables, SHOP, request)) == [("a", 20.0)]


def test_grain_needs_the_time_column(tables, rows):
    request = Request(["sales.n"], ["sales.shop"], time_grain="month")
    assert len(rows(metric_query(tables, SHOP, request))) == 3
    request = Request(["sales.n"], ["sales.day"], time_grain="month")
    assert [r[1] for r in rows(metric_query(tables, SHOP, request))] == [3, 1]


def test_null_order(tables):
    for direction, shops in (("asc", ["a", "b", None]), ("desc", [None, "b", "a"])):
        request = Request(["sales.n"], ["sales.shop"], order_by=[("shop", direction)])
        assert [r[0] for r in metric_query(tables, SHOP, request).collect()] == shops


def test_limits():
    assert row_limit(None, 500) == 500
    assert row_limit(1_000_000, 500) == 500
    assert row_limit(None, 0) is None
    assert row_limit(None, 10**9) == 50_000
    assert row_limit(70_000, 0) == 70_000
    assert row_limit(7, 10**9) == 7
    for bad in (0, -1, 2.5, True):
        assert code(lambda: row_limit(bad, 500)) == "invalid_value"


def test_drill_across_keeps_groups_of_either_side(tables, rows):
    request = Request(["sales.n", "visits.visits"], [])
    assert rows(metric_query(tables, SHOP, request, drill_across=True)) == [(4, 3)]
    request = Request(["sales.n", "visits.visits"], ["visits.place"], [Filter("visits.visits", ">", 0)])
    assert rows(metric_query(tables, SHOP, request, drill_across=True)) == [("a", 4, 2), ("c", None, 1)]


def test_result_masking(tables, rows):
    scope = Scope(open_scope(SHOP).bundle, 10, ("sales.shop",))
    got = rows(metric_query(tables, SHOP, Request(["sales.n"], ["sales.shop"]), scope))
    assert {r[0] for r in got} == {"[PII BLOCKED]"}


@pytest.mark.parametrize(
    "request_, expected",
    [
        (Request([]), "measure_required"),
        (Request(["n"]), "ambiguous_ref"),
        (Request(["sales."]), "ambiguous_ref"),
        (Request(["nope.n"]), "unknown_model"),
        (Request(["sales.nope"]), "unknown_measure"),
        (Request(["sales.n"], ["sales.nope"]), "unknown_dimension"),
        (Request(["sales.n"], filters=[Filter("sales.nope", "=", 1)]), "unknown_dimension"),
        (Request(["sales.n"], filters=[Filter("sales.shop", "=", None)]), "invalid_value"),
        (Request(["sales.n"], filters=[Filter("sales.shop", "in", values=[])]), "invalid_value"),
        (Request(["sales.n"], filters=[Filter("sales.shop", "between")]), "invalid_value"),
        (Request(["sales.n"], filters=[Filter("sales.shop", "~", 1)]), "invalid_operator"),
        (Request(["sales.n"], filters=[Filter("visits.place", "=", "a")]), "execution_failed"),
        (Request(["sales.n"], time_range=("2024-02-01", "2024-01-01")), "invalid_time_range"),
        (Request(["sales.n"], time_range=("Jan", "Feb")), "invalid_time_range"),
        (Request(["visits.visits"], time_range=("2024-01-01", "2024-02-01")), "no_time_dimension"),
        (Request(["sales.n"], ["sales.day"], time_grain="decade"), "invalid_time_grain"),
        (Request(["sales.n", "visits.top"]), "fanout_refused"),
        (Request(["sales.n"], order_by=[("sales.total", "asc")]), "unknown_dimension"),
        (Request(["sales.n", "sales.n"]), "ambiguous_ref"),
    ],
)
def test_refusals(tables, request_, expected):
    assert code(lambda: metric_query(tables, SHOP, request_)) == expected


def test_two_models_without_additive_measures_are_allowed(tables, rows):
    assert rows(metric_query(tables, SHOP, Request(["sales.shops", "visits.top"]))) == [(1, 2)]


def test_scope(tables):
    narrow = Scope(Bundle("n", ("sales",)), 10)
    assert code(lambda: metric_query(tables, SHOP, Request(["visits.top"]), narrow)) == "out_of_bundle"
    unlinked = Scope(Bundle("n", ("sales", "visits")), 10)
    request = Request(["sales.shops"], ["visits.place"])
    assert code(lambda: metric_query(tables, SHOP, request, unlinked)) == "disallowed_join"


def test_window_rule(tables, rows):
    scope = Scope(BUNDLE, 500)
    assert code(lambda: metric_query(tables, SHOP, Request(["sales.n"]), scope)) == "time_filter_required"
    wide = Request(["sales.n"], time_range=("2023-01-01", "2025-01-01"))
    assert code(lambda: metric_query(tables, SHOP, wide, scope)) == "time_filter_required"
    fits = Request(["sales.n"], time_range=("2024-01-01", "2024-03-31"))
    assert rows(metric_query(tables, SHOP, fits, scope)) == [(4,)]
    equal = Request(["sales.n"], filters=[Filter("sales.day", "=", "2024-01-02")])
    assert code(lambda: metric_query(tables, SHOP, equal, scope)) == "time_filter_required"
    own = Request(
        ["sales.n"],
        filters=[Filter("sales.day", ">=", "2024-01-01"), Filter("sales.day", "<", "2024-02-01")],
    )
    assert rows(metric_query(tables, SHOP, own, scope)) == [(3,)]


def test_bad_declarations():
    twice = Model("m", "t", (Dimension("x", "x"),), (Measure("x", "x", "sum"),))
    assert code(lambda: Semantics((twice,))) == "ambiguous_ref"
    assert code(lambda: Semantics((Model("m", "t", (), (Measure("x", "x", "median"),)),))) == "invalid_aggregation"
    assert code(lambda: Semantics((Model("m", "t"), Model("m", "u")))) == "ambiguous_ref"


def test_audit_agrees_with_single_requests(spark, tables):
    """The log audit names the code that the single request is refused with."""
    cases = [
        (["sales.n"], [], None, None),
        (["sales.n"], [], "2024-01-01", "2024-02-01"),
        (["sales.n"], [], "2024-01-01", "2025-02-01"),
        (["sales.n", "visits.visits"], [], "2024-01-01", "2024-02-01"),
        (["visits.visits"], [], None, None),
        (["sales.shops"], ["visits.place"], "2024-01-01", "2024-02-01"),
    ]
    log = spark.createDataFrame(
        [(i, m, d, None, s, e) for i, (m, d, s, e) in enumerate(cases)],
        "request_id long, measures array<string>, dimensions array<string>, "
        "filters array<struct<field:string,op:string,value:string>>, time_start string, time_end string",
    )
    scope = Scope(BUNDLE, 500)
    found = {r["request_id"]: r["code"] for r in audit_requests(log, SHOP, scope).collect()}
    for i, (measures, dims, start, end) in enumerate(cases):
        request = Request(measures, dims, time_range=(start, end) if start else None)
        try:
            metric_query(tables, SHOP, request, scope)
            assert i not in found
        except Refused as error:
            assert found[i] == error.code


def test_ref_suggestions(spark):
    refs = spark.createDataFrame([("sales.totl",), ("sales.zzzzzzzzz",), ("sales.",), ("x.n",), ("n",), ("sales.n",)], "ref string")
    got = {r["ref"]: (r["status"], r["suggestion"]) for r in resolve_refs(refs, SHOP).collect()}
    assert got == {
        "sales.totl": ("unknown_measure", "total"),
        "sales.zzzzzzzzz": ("unknown_measure", None),
        "sales.": ("ambiguous_ref", None),
        "x.n": ("unknown_model", None),
        "n": ("ambiguous_ref", None),
        "sales.n": ("ok", None),
    }


def test_drill_across_filters_hold_for_every_part(tables, rows):
    """A filter on one part's model keeps the other part's rows that lead to a passing row."""
    request = Request(["sales.n", "visits.visits"], ["visits.place"], [Filter("sales.shop", "=", "a")])
    assert rows(metric_query(tables, SHOP, request, drill_across=True)) == [("a", 4, 2)]


def test_drill_across_refuses_a_filter_it_cannot_apply(tables):
    apart = Semantics((*SHOP.models, Model("weather", "weather", (Dimension("sky", "sky"),), ())), SHOP.links)
    request = Request(["sales.n", "visits.visits"], ["visits.place"], [Filter("weather.sky", "=", "grey")])
    assert code(lambda: metric_query(tables, apart, request, drill_across=True)) == "disallowed_join"


def test_small_groups_go_before_the_cut(tables, rows):
    request = Request(["sales.n"], ["sales.shop"], order_by=[("sales.n", "asc")], limit=1)
    got = metric_query(tables, SHOP, request, at_least=("n", 2), mark_cut=True)
    assert rows(got) == [("a", 2, False)]
    assert rows(metric_query(tables, SHOP, request, mark_cut=True))[0][-1] is True
    assert metric_query(tables, SHOP, Request(["sales.n"], ["sales.shop"]), mark_cut=True).count() == 3
