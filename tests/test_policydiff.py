"""Replaying only what a change of policy can touch."""

from dataclasses import replace

import pytest

from tallyward.operators import policy, policydiff
from tallyward.plans.model import Agent, Link
from tallyward.session import cut
from tallyward.suite.common import POLICY, POLICY_NEXT, view

SALES = POLICY.bundles[0]
CHANGES = {
    "next": POLICY_NEXT,
    "none": replace(POLICY, revision="other"),
    "table gone": replace(POLICY, bundles=(replace(SALES, tables=SALES.tables[:-1]), *POLICY.bundles[1:])),
    "table new": replace(POLICY, bundles=(replace(SALES, tables=(*SALES.tables, "supplier", "customer")), *POLICY.bundles[1:])),
    "link gone": replace(POLICY, bundles=(replace(SALES, links=()), *POLICY.bundles[1:])),
    "link new": replace(POLICY, bundles=(replace(SALES, links=(*SALES.links, Link("orders", "o_custkey", "lineitem", "l_suppkey"))), *POLICY.bundles[1:])),
    "bundle gone": replace(POLICY, bundles=()),
    "agent new": replace(POLICY, agents=(*POLICY.agents, Agent("ghost"))),
    "agent mute": replace(POLICY, agents=tuple(replace(a, can_query=False) for a in POLICY.agents)),
    "column new": replace(POLICY, pii={**POLICY.pii, "orders": ("o_orderkey",)}),
    "odd column": replace(POLICY, pii={**POLICY.pii, "orders": ("l.l_quantity",)}),
    "none personal": replace(POLICY, pii={}),
    "masked": replace(POLICY, pii_mode="mask"),
    "fewer rows": replace(POLICY, max_rows=5),
    "no limits": replace(POLICY, enforce_limit=False),
    "several statements": replace(POLICY, single_statement=False),
    "no execution": replace(POLICY, allow_execute=False),
}


@pytest.fixture(scope="module")
def log(spark, small):
    judged = policy.evaluate(view(spark, small, "v_query_log"), POLICY)
    rows = cut(policy.decision_log(judged, "r1"))
    return rows, cut(policydiff.decision_index(rows))


@pytest.mark.parametrize("change", CHANGES)
def test_same_drift_as_the_full_replay(log, rows, change):
    decisions, index = log
    new = CHANGES[change]
    assert rows(policydiff.policy_drift(decisions, index, POLICY, new, limit=None)) == rows(policy.policy_drift(decisions, new, limit=None))
    assert rows(policydiff.drift_examples(decisions, index, POLICY, new, limit=None)) == rows(policy.drift_examples(decisions, new, limit=None))
    # what is left out keeps its violations as well
    again = policy.replay(decisions, new).selectExpr("decision_id", "replay_violations = original_violations as same")
    judged = policydiff.touched(decisions, index, POLICY, new)
    assert again.join(judged, "decision_id", "left_anti").filter("not same").count() == 0


def test_untouched_decisions_are_not_judged(log):
    decisions, index = log
    total = decisions.count()
    counts = {c: policydiff.touched(decisions, index, POLICY, CHANGES[c]).count() for c in ("none", "link gone", "column new", "next")}
    assert counts["none"] == 0 and 0 < counts["link gone"] < total / 3 and 0 < counts["column new"] < total
