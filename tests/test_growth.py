"""Steps that grow no faster than their input, or than their result."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tallyward.operators import catalog, ledger, policy, policydiff, textindex
from tallyward.plans.model import Policy
from tallyward.session import cut, scratch
from tallyward.suite.common import POLICY


def test_context_pairs_are_made_once(spark, rows, monkeypatch):
    written = []

    def counted(df, label=""):
        kept = df.sparkSession.createDataFrame(df.collect(), df.schema)
        written.append(kept.count())
        return kept

    monkeypatch.setattr(catalog, "cut", counted)
    monkeypatch.setattr(catalog, "TOGETHER", 3)
    asked = [(i, "is red gear blue") for i in range(40)] + [(i, "is red here") for i in range(35, 50)]
    asked += [(100 + i, "what costs t7 metal") for i in range(10)] + [(100, "some other"), (None, "metal things"), (200, None), (201, "old t3x")]
    questions = spark.createDataFrame(asked, "question_id int, question string")
    terms = spark.createDataFrame([("gear", ["red gear"]), ("ring", ["red"]), ("none", None), (None, ["old"])], "name string, synonyms array<string>")
    listed = [(f"t{i}", "heavy metal costs", ["g.gear" if i % 2 else "g.ring", "ring and gear"]) for i in range(30)] + [(None, "costs", ["gear"]), ("t7", None, None)]
    tables = spark.createDataFrame(listed, "table_name string, description string, glossary_terms array<string>")
    got = rows(catalog.match_context(questions, terms, tables))
    named = {i for i, text in asked if text and "red" in text}
    want = {(i, t, "term") for i in named for t, _, tags in listed if tags and (i < 40 or any("ring" in tag for tag in tags))}
    for i, text in asked:
        if text and i not in named:
            word = next(w for w in text.split(" ") if len(w) > 3) if any(len(w) > 3 for w in text.split(" ")) else None
            want |= {(i, t, "keyword") for t, about, _ in listed if (i is not None and t and t in text) or (word and about and word in about)}
    assert got == sorted(want, key=repr)
    # no written step holds the pairs
    assert max(written) < len(got) / 4


def test_context_pairs_take_little_room(spark, tmp_path):
    questions = spark.range(400).selectExpr("id as question_id", "'is gear ' || id as question")
    terms = spark.createDataFrame([("gear", None)], "name string, synonyms array<string>")
    tables = spark.range(30_000).selectExpr("'table ' || sha1(cast(id as string)) as table_name", "'x' as description", "array('gear') as glossary_terms")
    catalog.match_context(questions, terms, tables).write.parquet(str(tmp_path / "pairs"))
    found = spark.read.parquet(str(tmp_path / "pairs"))
    assert found.distinct().count() == found.count() == 400 * 30_000
    # columns repeat what they hold, so a pair is written in a fraction of a byte
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 400 * 30_000 / 2


def test_pairs_meet_at_the_least_key(spark, rows, monkeypatch):
    for name, size in (("TOGETHER", 4), ("TABLES_TOGETHER", 2), ("GROUP_QUESTIONS", 8), ("GROUP_TABLES", 6), ("TASK_PAIRS", 64)):
        monkeypatch.setattr(catalog, name, size)
    rng = random.Random(8)
    sides = [[(of(i), sorted(rng.sample("abcdefg", rng.choice([1, 1, 2, 4])))) for i in range(n)] + [(None, ["b", "z"])] for of, n in ((int, 90), ("t{}".format, 70))]
    asked = spark.createDataFrame(sides[0], "question_id int, _keys array<string>")
    listed = spark.createDataFrame(sides[1], "table_name string, _keys array<string>")
    got = rows(catalog._reached(asked, listed))
    assert got == sorted(((q, t) for q, a in sides[0] for t, b in sides[1] if set(a) & set(b)), key=repr)


def test_postings_are_sorted_in_bounded_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(textindex, "TASK_CHARACTERS", 2000)
    texts = [(f"d/{i:03}", f"text {i} of the corpus " + "abc def " * (i % 40)) for i in range(200)]
    texts += [("d/twice", "one alpha"), ("d/twice", "one beta"), ("d/null", None), (None, "alpha")]
    docs = spark.createDataFrame(texts, "path string, text string")
    index = textindex.write_index(docs, "path", "text", scratch(spark, "index"), 2)
    assert index.texts.select("block").distinct().count() == 2
    characters = docs.agg(F.sum(F.length("text"))).first()[0]
    files = index.postings.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect()
    # no file holds much more than its share of the postings, so no task had them
    assert max(f.n for f in files) < 3 * sum(f.n for f in files) / (characters / 2000)
    # rows of one path count as one text, and a gram that both rows have counts once
    assert rows(textindex.candidates(index, "beta"), "path") == [("d/twice",)]
    assert rows(textindex.matching_lines(index, "one beta"), "path", "line_content") == [("d/twice", "one beta")]
    assert rows(textindex.candidates(index, "one alp.* beta"), "path") == [("d/twice",)]


def test_many_personal_columns_are_looked_up(spark, rows):
    names = [f"col_{i}" for i in range(40)] + ["Col_7", "c_name", "né", "a.b"]
    pii = {"wide": tuple(names), "Other": ("c_name", "z")}
    log = [
        ("q1", "select c_name, col_7 from orders limit 1"), ("q2", "SELECT * FROM public.Other limit 1"), ("q3", "select * from other, wide limit 1"),
        ("q4", "select a.b from t"), ("q5", "select né from t"), ("q6", "select none from t"), ("q7", ""), ("q8", None), ("q9", "select * from nowhere"), ("q10", "select xcol_7 from t"),
    ]
    asked = spark.createDataFrame([(q, "sales", s) for q, s in log], "query_id string, agent_id string, sql_text string")
    judged = policy.evaluate(asked, Policy(POLICY.agents, POLICY.bundles, pii))
    got = {r.query_id: [v["detail"][11:-11] for v in r.violations if v["check"] == "pii_check"] for r in judged.collect()}
    order = [f"{t}.{c}" for t in sorted(pii) for c in sorted(pii[t])]
    both = [e for e in order if e in ("Other.c_name", "wide.c_name", "wide.col_7", "wide.Col_7")]
    assert got == {
        "q1": both, "q2": ["Other.c_name", "Other.z"], "q3": order[:2],
        "q4": ["wide.a.b"], "q5": ["wide.né"], "q6": [], "q7": [], "q8": [], "q9": [], "q10": [],
    }
    # the lists of names are literals in buckets: no row is compared with all of them
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan


def test_index_rows_are_dealt_in_bounded_shares(spark, rows, monkeypatch):
    monkeypatch.setattr(policydiff, "FILE_DECISIONS", 20)
    monkeypatch.setattr(policydiff, "SHARE_DECISIONS", 20)
    asked = [(i, f"2024-01-01 00:00:{i % 60:02}", "sales", "query_data", f"select c{i} from orders limit {i}") for i in range(300)] + [(None, "2024-01-01 00:00:00", "sales", "query_data", None)]
    log = spark.createDataFrame(asked, "query_id int, ts string, agent_id string, tool_name string, sql_text string")
    decisions = cut(policy.decision_log(policy.evaluate(log, POLICY), "r1"))
    index = policydiff.sorted_index(decisions)
    assert rows(index) == rows(policydiff.decision_index(decisions))
    counts = index.groupBy(F.spark_partition_id()).agg(F.count_if((F.col("kind") == "word") & (F.col("element") == "select"))).collect()
    # every decision has the word; no partition holds it for a large share of them
    assert sum(c[1] for c in counts) == 300 and max(c[1] for c in counts) < 100


def test_a_whole_audit_is_joined_in_bounded_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(ledger, "TASK_ROWS", 20)
    outcomes = [(i, "s", "high", i, ["a"], [i % 90, i % 7, i % 7, 1000 + i]) for i in range(150)] + [(900, "s", "low", 1, None, None), (901, "s", "low", 1, [], []), (902, "s", None, 2, ["a"], [None])]
    proposals = [(i, "low") for i in range(100)] + [(3, "high"), (None, "low")]
    approvals = [(i % 60, "ann", i % 2 == 0) for i in range(200)] + [(None, "bob", True)]
    actions = [(i % 40, "note", "completed" if i % 3 else None) for i in range(150)]
    made = [
        spark.createDataFrame(outcomes, "outcome_id int, session_id string, confidence string, created_at int, agents_involved array<string>, evidence_proposal_ids array<int>"),
        spark.createDataFrame(proposals, "proposal_id int, risk_class string"),
        spark.createDataFrame(approvals, "proposal_id int, approved_by string, approved boolean"),
        spark.createDataFrame(actions, "proposal_id int, action_type string, status string"),
    ]
    found = ledger.audit_decisions(*made, limit=None)
    want = Counter()
    for o in outcomes:
        for pid in list(dict.fromkeys(o[5])) if o[5] else [None]:
            for p in [p for p in proposals if p[0] == pid and pid is not None] or [(None, None)]:
                for a in [a for a in approvals if a[0] == p[0] and p[0] is not None] or [(None, None, None)]:
                    for d in [d for d in actions if d[0] == p[0] and p[0] is not None] or [(None, None, None)]:
                        want[(*o[:4], *p, a[1], a[2], d[1], d[2])] += 1
    columns = ["outcome_id", "session_id", "confidence", "created_at", "proposal_id", "risk_class", "approved_by", "approved", "action_type", "action_status", "copies"]
    assert rows(found, *columns) == sorted(((*k, n) for k, n in want.items()), key=repr)
    # more tasks than the session's eight partitions, as the rows ask for
    assert found.rdd.getNumPartitions() > (len(outcomes) + len(proposals) + len(approvals) + len(actions)) / 20
    # a limit narrows the ledgers as before, with the same rows
    assert rows(ledger.audit_decisions(*made, limit=1000), *columns) == rows(found, *columns)
