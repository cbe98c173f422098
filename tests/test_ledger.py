import pytest
from pyspark.sql import functions as F

from tallyward.functions import keys
from tallyward.operators import ledger, memory, rules
from tallyward.operators.rules import Check, Rule, Tokens
from tallyward.plans.model import Agent, Bundle, Policy

POLICY = Policy((Agent("a", "domain", "b1"), Agent("lead", "orchestrator", None, False)), (Bundle("b1", ("orders",)),), {"p": ("mail",)})


def at(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def test_finding_key_ignores_source_order_and_absence(spark):
    df = spark.createDataFrame(
        [(1, ["x", "y"]), (2, ["y", "x"]), (3, None), (4, [])], "n int, sources array<string>"
    )
    key = keys.finding_key(F.lit("s"), F.lit("a"), F.lit("f"), F.lit("high"), F.col("sources"))
    got = {r["n"]: r["k"] for r in df.select("n", key.alias("k")).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1] != got[3]


def test_append_once_twice_is_once(spark, rows):
    new = at(spark.createDataFrame([(1, "k", "2024-01-02"), (2, "k", "2024-01-01"), (3, "m", "2024-01-01")], "id long, key string, at string"), "at")
    once = ledger.append_once(new.limit(0), new, "key", ["at", "id"])
    twice = ledger.append_once(once, new, "key", ["at", "id"])
    assert rows(once, "id", "key") == rows(twice, "id", "key") == [(2, "k"), (3, "m")]
    replayed = ledger.original_rows(new, once, "key", ["id"])
    assert rows(replayed, "id", "stored_id") == [(1, 2), (2, 2), (3, 3)]


def test_lifecycle(spark):
    proposals = spark.createDataFrame([(i,) for i in range(1, 8)], "proposal_id long")
    approvals = at(
        spark.createDataFrame(
            [(1, 2, True, "2024-01-01"), (2, 3, False, "2024-01-01"), (3, 4, True, "2024-01-01"), (4, 5, True, "2024-01-03"),
             (5, 7, False, "2024-01-01"), (6, 7, True, "2024-01-02")],
            "approval_id long, proposal_id long, approved boolean, created_at string",
        ),
        "created_at",
    )
    actions = at(spark.createDataFrame([(4, "2024-01-02"), (5, "2024-01-02"), (6, "2024-01-02")], "proposal_id long, created_at string"), "created_at")
    outcomes = spark.createDataFrame([([6, 6],), (None,)], "evidence_proposal_ids array<long>")
    got = {r["proposal_id"]: (r["status"], r["executed_unapproved"]) for r in ledger.proposal_status(proposals, approvals, actions, outcomes).collect()}
    assert got == {
        1: ("pending", False),
        2: ("approved", False),
        3: ("rejected", False),
        4: ("executed", False),
        5: ("executed", True),
        6: ("completed", True),
        7: ("approved", False),
    }


def test_permissions(spark, rows):
    log = spark.createDataFrame(
        [("a", "approve", "high"), ("a", "approve", "low"), ("auto", "approve", "high"), ("human:x", "execute", "high"), ("z", "propose", "high"), ("a", "execute", "low")],
        "actor string, verb string, risk_class string",
    )
    may = {"a": {"propose": ["low"], "approve": ["low"], "execute": []}, "auto": {"approve": []}}
    assert rows(ledger.permission_violations(log, may), "actor", "verb", "risk_class") == [
        ("a", "approve", "high"),
        ("a", "execute", "low"),
    ]


def test_unlisted_actions_are_high_risk(spark, rows):
    actions = spark.createDataFrame([("x",), ("y",)], "action_type string")
    got = ledger.classify_actions(actions, {"x": "low"}, {"low": "auto"})
    assert rows(got) == [("x", "low", "auto"), ("y", "high", "human_required")]


def test_missing_evidence(spark, rows):
    decisions = spark.createDataFrame([(1, [5, 6, 6, None]), (2, []), (3, None)], "id long, refs array<long>")
    existing = spark.createDataFrame([(5,)], "event_id long")
    got = ledger.missing_evidence(decisions, "id", {"event": ("refs", existing, "event_id")})
    assert rows(got.filter("missing is not null")) == [(1, "event", "6")]


def test_audit_counts_copies(spark):
    outcomes = at(spark.createDataFrame([(1, "s", "high", ["a"], [7], "2024-01-02"), (2, "s", "low", ["a"], None, "2024-01-03")],
        "outcome_id long, session_id string, confidence string, agents_involved array<string>, evidence_proposal_ids array<long>, created_at string"), "created_at")
    proposals = spark.createDataFrame([(7, "low")], "proposal_id long, risk_class string")
    approvals = spark.createDataFrame([(7, "x", True), (7, "x", True), (7, "y", False)], "proposal_id long, approved_by string, approved boolean")
    actions = spark.createDataFrame([(7, "t", "done"), (7, "t", "done"), (7, "t", "done")], "proposal_id long, action_type string, status string")
    got = ledger.audit_decisions(outcomes, proposals, approvals, actions).collect()
    assert sorted((r["outcome_id"], r["approved_by"], r["copies"]) for r in got if r["approved_by"]) == [(1, "x", 6), (1, "y", 3)]
    assert [r["copies"] for r in got if r["outcome_id"] == 2] == [1]


def test_promotion(spark):
    stats = spark.createDataFrame([("low", 10, 10, 0), ("medium", 100, 49, 0), ("high", 100, 100, 0), ("odd", 9, 9, 0), ("flaky", 100, 95, 5)],
        "risk_class string, total long, successful long, failed long")
    got = ledger.autonomy_promotion(stats, {"low": 0, "medium": 50, "high": -1, "flaky": 50}, 0.02)
    assert {r["risk_class"] for r in got.filter("promoted").collect()} == {"low"}


def test_recall_scopes(spark, rows):
    entries = [
        (1, "agent", "a", "active", 0.5), (2, "bundle", "b1", "candidate", 0.9), (3, "global", "global", "active", 0.7),
        (4, "agent", "z", "active", 0.9), (5, "bundle", "b1", "retired", 0.9),
    ]
    mem = spark.createDataFrame(
        [(i, t, s, st, "Title", "About Trains", c, 1) for i, t, s, st, c in entries],
        "memory_id long, scope_type string, scope_id string, status string, title string, summary string, confidence double, created_at long",
    )
    ids = lambda *args: [r["memory_id"] for r in memory.recall(mem, *args).collect()]
    assert ids("a", POLICY) == [2, 3, 1]
    assert ids("a", POLICY, "all", "TRAIN") == [2, 3, 1]
    assert ids("a", POLICY, "all", "plane") == []
    assert ids("lead", POLICY, "bundle") == []
    assert ids("nobody", POLICY, "global") == [3]


def test_memory_upsert_keeps_first_time(spark, rows):
    old = at(spark.createDataFrame([("a", "k", "one", "2024-01-01", "2024-01-01")], "agent_id string, key string, content string, created_at string, updated_at string"), "created_at", "updated_at")
    new = at(spark.createDataFrame([("a", "k", "two", "2024-01-03", "2024-01-03"), ("a", "k", "three", "2024-01-02", "2024-01-02")], "agent_id string, key string, content string, created_at string, updated_at string"), "created_at", "updated_at")
    row = memory.upsert_memory(old, new).first()
    assert (row["content"], str(row["created_at"])[:10], str(row["updated_at"])[:10]) == ("two", "2024-01-01", "2024-01-03")


@pytest.fixture(scope="module")
def past(spark):
    texts = [(i, f"question {i} about railways", f"we kept wxyz{i % 3} and http://host/long-path-{i}") for i in range(40)]
    return spark.createDataFrame([(i, q, d, i // 2) for i, q, d in texts], "outcome_id long, question string, decision_summary string, created_at long")


def test_bulk_precedents_equal_single_ones(spark, past):
    asked = ["Which railway is late", "a b", "WXYZ1 or wxyz2", "long-path-7 here", "nothing matches%", "host/long-path-3"]
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    got = {}
    for r in memory.precedents_bulk(questions, past, 4).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append(r["outcome_id"])
    for i, question in enumerate(asked):
        single = [r["outcome_id"] for r in memory.precedents(past, question, 4).collect()]
        assert got.get(i, []) == single, question


RULES = [
    Rule("pattern", "error", ("orders.x",), Check("sql_pattern", Tokens(require_any=("amount",)), Tokens(require_all=("Paid",), forbid_any=("draft",))), "g1"),
    Rule("narrow", "warning", ("orders.x",), Check("text_pattern", None, Tokens(require_any=("a1", "b2")), "say it")),
    Rule("names", "error", ("orders.x",), Check("pii_columns")),
    Rule("open", "error", ("orders.x",), None),
]


def test_rule_outcomes(spark):
    answers = spark.createDataFrame(
        [(1, "a", "select AMOUNT where paid", "a1"), (2, "a", "select amount, mail", "zz"), (3, "a", None, None), (4, "a", "amount paid draft", "B2"), (5, "a", "xmail mail_x", "")],
        "answer_id long, agent_id string, sql_text string, result_text string",
    )
    got = {(r["answer_id"], r["rule"]): (r["status"], r["detail"]) for r in rules.check_rules(answers, RULES, ["mail"]).collect()}
    assert [got[i, "pattern"][0] for i in range(1, 6)] == ["pass", "fail", "not_applicable", "fail", "not_applicable"]
    assert got[2, "pattern"][1] == 'required token "Paid" is missing'
    assert got[4, "pattern"][1] == 'forbidden token "draft" occurs'
    assert [got[i, "narrow"][0] for i in range(1, 6)] == ["pass", "fail", "not_applicable", "pass", "fail"]
    assert got[2, "narrow"][1] == "say it"
    assert [got[i, "names"][0] for i in range(1, 6)] == ["pass", "fail", "pass", "pass", "pass"]
    assert {got[i, "open"][0] for i in range(1, 6)} == {"manual"}
    none = rules.check_rules(answers, RULES[2:3], []).collect()
    assert {r["status"] for r in none} == {"not_applicable"}


def test_verified_answers(spark):
    answers = spark.createDataFrame(
        [(1, "a", "select amount from orders where paid", "fine"), (2, "a", "select amount from orders", "fine"), (3, "a", "select 1 from elsewhere", "fine"), (4, "lead", None, "fine")],
        "answer_id long, agent_id string, sql_text string, result_text string",
    )
    got = {r["answer_id"]: r for r in rules.verify_answers(answers, RULES, POLICY).collect()}
    assert [got[i]["verified"] for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert list(got[2]["warnings"]) == ["g1"] and list(got[3]["out_of_scope"]) == ["elsewhere"]
    assert list(got[1]["manual_rules"]) == ["open"] and got[4]["no_rule"]


def test_confidence_is_not_capped_by_coverage(spark):
    sessions = spark.createDataFrame([("s1", ["public.orders"], ["r"] * 9, ["a"] * 6), ("s2", [], [], [])],
        "session_id string, tables_used array<string>, rules_checked array<string>, agents_consulted array<string>")
    outcomes = spark.createDataFrame([("s1",)] * 4 + [("s3",)], "session_id string")
    got = {r["session_id"]: r for r in rules.confidence(sessions, outcomes, ["orders"], 3, 3).collect()}
    assert (got["s1"]["freshness"], got["s1"]["rules"], got["s1"]["coverage"], got["s1"]["precedent"]) == (0.95, 1.0, 2.0, 0.6)
    assert (got["s2"]["precedent"], got["s2"]["confidence"]) == (0.7, "low")
