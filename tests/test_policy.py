"""Policy verdicts: allowed and blocked queries of four kinds of caller."""

import pytest

from tallyward.operators import masking, policy
from tallyward.plans.model import Agent, Bundle, Link, Policy, Refused

RULES = Policy(
    agents=(
        Agent("stock", "domain", "stock"),
        Agent("desk", "domain", "desk"),
        Agent("people", "domain", "people"),
        Agent("lead", "orchestrator", None, can_query=False),
        Agent("free", "domain", None),
    ),
    bundles=(
        Bundle(
            "stock",
            ("parts", "shelves", "moves"),
            (Link("parts", "shelf", "shelves", "code"), Link("moves", "part_id", "parts", "part_id")),
        ),
        Bundle("desk", ("tickets", "replies"), (Link("replies", "ticket_id", "tickets", "ticket_id"),)),
        Bundle("people", ("persons",)),
    ),
    pii={"persons": ("given_name", "family_name", "mail")},
)

ALLOWED = [
    ("stock", "SELECT part_id, state FROM parts WHERE state = 'low' LIMIT 10"),
    ("stock", "select code from shelves limit 500"),
    ("stock", "SELECT p.part_id FROM parts p JOIN shelves s ON p.shelf = s.code LIMIT 5"),
    ("stock", "SELECT p.part_id FROM shelves s JOIN parts p ON s.code = p.shelf LIMIT 5"),
    ("stock", "SELECT m.n FROM public.moves m JOIN public.parts p ON m.part_id = p.part_id LIMIT 5"),
    ("desk", "SELECT ticket_id, state FROM tickets LIMIT 10"),
    ("people", "SELECT person_id, tier FROM persons LIMIT 20"),
    ("free", "SELECT anything FROM anywhere LIMIT 1"),
    ("stock", 'SELECT x FROM "tickets" LIMIT 3'),
    ("stock", ""),
]
BLOCKED = [
    ("stock", "SELECT ticket_id FROM tickets LIMIT 5", "bundle_scope", "bundle"),
    ("desk", "SELECT part_id FROM parts LIMIT 5", "bundle_scope", "bundle"),
    ("people", "SELECT part_id FROM public.parts LIMIT 5", "bundle_scope", "bundle"),
    ("stock", "WITH w AS (SELECT 1) SELECT * FROM w LIMIT 5", "bundle_scope", "w is not"),
    ("stock", "SELECT EXTRACT(year FROM moved_at) FROM moves LIMIT 5", "bundle_scope", "moved_at"),
    ("people", "SELECT given_name FROM persons LIMIT 10", "pii_check", "PII"),
    ("people", "SELECT mail, MAIL FROM persons LIMIT 10", "pii_check", "PII"),
    ("people", "SELECT * FROM persons LIMIT 5", "pii_check", "PII"),
    ("people", "SELECT person_id FROM persons WHERE mail = 'x' LIMIT 10", "pii_check", "PII"),
    ("stock", "SELECT part_id FROM parts", "limit_check", "LIMIT"),
    ("desk", "SELECT ticket_id FROM tickets", "limit_check", "LIMIT"),
    ("stock", "SELECT part_id FROM parts LIMIT 501", "limit_value", "exceeds"),
    ("desk", "SELECT ticket_id FROM tickets LIMIT 99999999999999999999", "limit_value", "exceeds"),
    ("stock", "SELECT n FROM moves LIMIT 1; SELECT n FROM moves LIMIT 1", "single_statement", "statements"),
    ("stock", "DELETE FROM parts WHERE part_id = 1", "read_only", "Write"),
    ("desk", "UPDATE tickets SET state = 'x'", "read_only", "Write"),
    ("stock", "drop table parts", "read_only", "Write"),
    ("desk", "INSERT INTO tickets VALUES (1)", "read_only", "Write"),
    ("stock", "SELECT created_at FROM parts LIMIT 5", "read_only", "Write"),
    ("stock", "SELECT p.x FROM parts p JOIN shelves s ON p.part_id = s.code LIMIT 5", "join_allowlist", "allowlist"),
    ("ghost", "SELECT 1 LIMIT 1", "authenticate", "Unknown agent"),
    ("lead", "SELECT part_id FROM parts LIMIT 10", "can_query", "cannot execute"),
]


@pytest.fixture(scope="module")
def judged(spark):
    cases = ALLOWED + [b[:2] for b in BLOCKED]
    log = spark.createDataFrame(
        [(str(i), a, "query_data", s) for i, (a, s) in enumerate(cases)],
        "query_id string, agent_id string, tool_name string, sql_text string",
    )
    return {int(r["query_id"]): r for r in policy.evaluate(log, RULES).collect()}


@pytest.mark.parametrize("i", range(len(ALLOWED)))
def test_allowed(judged, i):
    assert judged[i]["allow"], judged[i]["violations"]


@pytest.mark.parametrize("i", range(len(BLOCKED)))
def test_blocked(judged, i):
    verdict = judged[len(ALLOWED) + i]
    _, _, check, words = BLOCKED[i]
    assert not verdict["allow"]
    assert verdict["violations"][0]["check"] == check
    assert words in verdict["reason"]


def test_columns_named_in_no_violation_twice(judged):
    row = judged[len(ALLOWED) + 6]
    assert list(row["blocked_columns"]) == ["persons.mail"]


def test_strict_mode_wants_whole_words(spark):
    log = spark.createDataFrame([("SELECT created_at FROM t",), ("CREATE TABLE t",)], "sql_text string")
    got = [r["parsed"]["is_read_only"] for r in policy.parse_sql(log, strict=True).collect()]
    assert got == [True, False]


def test_parsed_parts(spark):
    text = "SELECT a.x AS \"One\", count(*) n, public.t.z\nFROM public.T a JOIN u b ON a.k = public.b.k, LIMIT 12"
    row = policy.parse_sql(spark.createDataFrame([(text,)], "sql_text string")).first()["parsed"]
    assert list(row["tables"]) == ["public.t", "u"]
    assert list(row["columns"]) == ["one", "n", "public.t.z"]
    assert [tuple(j) for j in row["joins"]] == [("k", "b.k,")]
    assert (row["has_limit"], row["limit_value"], row["statement_count"]) == (True, 12, 1)


def test_blank_statements_do_not_count(spark):
    log = spark.createDataFrame([(" ;\n; SELECT 1 ;\t",), ("   ",)], "sql_text string")
    assert [r["parsed"]["statement_count"] for r in policy.parse_sql(log).collect()] == [1, 0]


def test_no_drift_under_the_same_policy(spark):
    log = spark.createDataFrame(
        [(i, f"2024-01-{i % 28 + 1:02d}", a, "query_data", s) for i, (a, s) in enumerate(ALLOWED + [b[:2] for b in BLOCKED])],
        "query_id long, ts string, agent_id string, tool_name string, sql_text string",
    ).withColumn("ts", policy.F.col("ts").cast("timestamp_ntz"))
    decisions = policy.decision_log(policy.evaluate(log, RULES), "r1")
    same = policy.policy_drift(decisions, RULES, limit=None).first()
    assert (same["total"], same["changed"], same["drift_rate"]) == (32, 0, "0.0%")
    open_policy = Policy(RULES.agents, RULES.bundles, {}, max_rows=10**6, enforce_limit=False)
    # four personal-data, two missing-limit and two large-limit queries pass now
    assert policy.policy_drift(decisions, open_policy, limit=None).first()["changed"] == 8
    none = policy.policy_drift(decisions, RULES, since="2030-01-01").first()
    assert (none["total"], none["changed"], none["drift_rate"]) == (0, 0, "0.0%")


def test_governed_sql(spark):
    spark.createDataFrame([(1, "Ann")], "part_id long, mail string").createOrReplaceTempView("parts")
    with pytest.raises(Refused) as error:
        policy.governed_sql(spark, "SELECT part_id FROM parts", "stock", RULES)
    assert error.value.code == "governance_blocked" and error.value.details["checks"] == ["limit_check"]
    got = policy.governed_sql(spark, "SELECT part_id AS `Mail` FROM parts LIMIT 1", "free", Policy(
        RULES.agents, RULES.bundles, RULES.pii, pii_mode="mask"
    ))
    assert got.first()["Mail"] == "[PII BLOCKED]"


def test_redaction_and_masking(spark):
    df = spark.createDataFrame([("Mail, e_mail and MAIL; émail", None)], "text string, mail string")
    got = masking.mask_pii(masking.redact(df, "text", ["persons.mail"]), ["persons.mail"]).first()
    # letters outside ASCII count as a border, as they do for the stated patterns
    assert got["text"] == "[REDACTED], e_mail and [REDACTED]; é[REDACTED]"
    assert got["mail"] == "[PII BLOCKED]"
    nested = spark.createDataFrame([("first_name name",)], "text string")
    assert masking.redact(nested, "text", ["name", "first_name"]).first()[0] == "[REDACTED] [REDACTED]"
