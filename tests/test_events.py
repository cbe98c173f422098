import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyward.operators import eventlog, signals
from tallyward.operators.eventlog import CaseKey, EventLayout

LAYOUT = EventLayout(keys=(CaseKey("user_id"),))
START = datetime(2024, 1, 1)


def log(spark, data):
    """``(user, minute, type)`` triples as an event table."""
    rows = [(i, START + timedelta(minutes=m), u, t, "{}") for i, (u, m, t) in enumerate(data)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def tied():
    """Events with many ties, one case that holds a third of all rows, and null cases."""
    pick = random.Random(7)
    data = []
    for _ in range(600):
        user = pick.choice([1, None] + [pick.randrange(2, 40), pick.randrange(2, 40)])
        data.append((user, pick.randrange(0, 200), pick.choice("abcd")))
    return data


def pairs_by_hand(data, starts, targets, since):
    """Every start with all events at the next instant of each target type."""
    found = []
    for u, m, t in data:
        if u is None or t not in starts or m < since:
            continue
        for target in targets:
            later = [m2 for u2, m2, t2 in data if u2 == u and t2 == target and m2 > m]
            found += [(t, target, min(later) - m)] * later.count(min(later)) if later else []
    return found


@pytest.mark.parametrize("split", [False, True])
def test_step_durations_equal_the_literal_pairs(spark, tied, split):
    as_of = "2024-01-31 01:00:00"
    since = 60
    events = log(spark, tied)
    got = signals.step_durations(events, "user_id", ["a", "b"], ["b", "c"], as_of, 30, top=None, split=split)
    by_hand = {}
    for start, target, minutes in pairs_by_hand(tied, "ab", "bc", since):
        by_hand.setdefault((start, target), []).append(minutes)
    assert {(r["from_step"], r["to_step"]): r["sample_size"] for r in got.collect()} == {
        k: len(v) for k, v in by_hand.items()
    }
    for r in got.collect():
        values = by_hand[r["from_step"], r["to_step"]]
        assert r["avg_minutes"] == pytest.approx(sum(values) / len(values), abs=0.051)
        assert (r["min_minutes"], r["max_minutes"]) == (min(values), max(values))


@pytest.mark.parametrize("split", [False, True])
def test_timelines_number_every_row(spark, tied, split):
    got = eventlog.case_timelines(log(spark, tied), "user_id", LAYOUT, split=split).collect()
    cases = {}
    for i, (u, m, _) in enumerate(tied):
        if u is not None:
            cases.setdefault(u, []).append((m, i))
    expected = {}
    for rows in cases.values():
        last = None
        for step, (m, i) in enumerate(sorted(rows), 1):
            expected[i] = (step, None if last is None else m - last)
            last = m
    assert {r["event_id"]: (r["step"], r["minutes_since_previous"]) for r in got} == expected


@pytest.mark.parametrize("split", [False, True])
def test_variants_tell_long_cases_apart(spark, split):
    """Two long cases that differ only at the end are two variants."""
    data = [(u, m, "a") for u in (1, 2, 3) for m in range(30)] + [(1, 40, "b"), (2, 40, "c"), (3, 40, "b"), (9, 1, "a")]
    got = eventlog.variants(log(spark, data), "user_id", LAYOUT, split=split).collect()
    assert sorted((r["variant"], r["steps"], r["cases"], r["share"]) for r in got) == [
        (1, 31, 2, 50.0),
        (2, 31, 1, 25.0),
        (9, 1, 1, 25.0),
    ]
    steps = eventlog.variant_steps(log(spark, data), "user_id", LAYOUT, split=split)
    whole = steps.filter("variant = 2").orderBy("step").collect()
    assert [r["type"] for r in whole] == ["a"] * 30 + ["c"]


def test_case_timeline_keeps_the_first_events(spark, rows):
    events = log(spark, [(1, m, "a") for m in range(101)] + [(2, 5, "b")])
    first = eventlog.case_timeline(events, "user_id", 1, LAYOUT)
    assert [r["step"] for r in first.orderBy("step").collect()] == list(range(1, 101))
    assert rows(eventlog.case_timeline(events, "user_id", 2, LAYOUT), "step", "minutes_since_previous") == [(1, None)]
    with pytest.raises(ValueError):
        eventlog.case_timeline(events, "order_id", 1, LAYOUT)


def test_half_minutes_round_up(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (1.5,), (2.49,)], "x double")
    assert [r[0] for r in df.select(eventlog.timecols.half_up(F.col("x"))).collect()] == [0, 1, 2, 2]


def test_ingest(spark):
    layout = EventLayout(keys=(CaseKey("user_id"), CaseKey("order_ref", "string")))
    incoming = spark.createDataFrame(
        [
            (1, "a", {"user_id": "5", "order_ref": "x"}, '{"k":1}'),
            (2, "a", {}, None),
            (3, "a", {"user_id": "5.0"}, None),
            (4, "a", {"user_id": "5.5"}, None),
            (5, "a", {"user_id": "five"}, None),
            (6, "a", {"who": "5"}, None),
            (7, "a", {"user_id": "9007199254740993"}, None),
        ],
        "n long, event_type string, correlations map<string,string>, metadata string",
    )
    good, rejected = eventlog.ingest_events(incoming, layout, "2024-05-01")
    assert {r["n"]: (r["user_id"], r["order_ref"], r["props"]) for r in good.collect()} == {
        1: (5, "x", '{"k":1}'),
        2: (None, None, "{}"),
        3: (5, None, "{}"),
        7: (9007199254740993, None, "{}"),
    }
    assert {r["n"]: r["reject_reason"] for r in rejected.collect()} == {
        4: "not an integer: user_id",
        5: "not an integer: user_id",
        6: "unknown key: who",
    }


def test_parameters():
    assert signals.whole_number("d", "30", 365) == 30
    for bad in (1.5, "1.5", "", None, True):
        with pytest.raises((ValueError, TypeError)):
            signals.whole_number("d", bad)
    with pytest.raises(ValueError):
        signals.whole_number("d", 366, 365)


def test_optional_filter(spark, rows):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "state string, part int")
    assert rows(signals.status_for(df, "state", "part")) == [("x", 2), ("y", 1)]
    assert rows(signals.status_for(df, "state", "part", 2)) == [("x", 1)]


def test_distribution_share_is_of_all_groups(spark):
    data = [(1, i, f"t{i % 25:02d}") for i in range(100)]
    got = signals.event_distribution(log(spark, data), "2024-01-10", layout=LAYOUT).collect()
    assert len(got) == 20 and {r["percentage"] for r in got} == {4.0}


def test_delays_of_a_parent_listed_twice(spark):
    facts = spark.createDataFrame([(1, "x", 10.0), (1, "x", 20.0), (2, "y", 5.0), (3, "y", 99.0)], "k long, why string, m double")
    facts = facts.withColumn("at", F.lit("2024-01-05").cast("timestamp_ntz"))
    parents = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    got = signals.delay_patterns(facts, parents, "k", "id", "at", "why", "m", "2024-01-10").collect()
    assert [tuple(r) for r in got] == [("x", 4, 15.0, 20.0, 60.0), ("y", 1, 5.0, 5.0, 5.0)]


def test_plural_table_names_do_not_match(spark):
    events = log(spark, [(1, 0, "FlightDelayed"), (1, 60, "BookingsClosed")])
    slas = spark.createDataFrame(
        [("flights", 5, None), ("bookings", None, 1), ("parts", None, None)],
        "table_name string, max_delay_minutes bigint, max_delay_hours bigint",
    )
    got = eventlog.freshness_by_type(events, slas, "2024-01-01 02:00:00", LAYOUT).collect()
    assert {r["table_name"]: (r["age_minutes"], r["fresh"]) for r in got} == {
        "flights": (None, False),
        "bookings": (60, True),
        "parts": (None, True),
    }
