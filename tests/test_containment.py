"""Containment joins on rarest pieces, precedents from the newest on, and lineage by doubling."""

import random

import pytest

from tallyward.operators import catalog, memory
from tallyward.plans import contains
from tallyward.suite.common import view


def test_all_pairs(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None, "abc" * 2000]
    phrases = sorted({"".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 9))) for _ in range(80)}) + ["", None, "abcabcabcabcabcabc"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    p = spark.createDataFrame([(x,) for x in phrases], "phrase string")
    got = sorted((r.id, r.phrase) for r in contains.contains_join(t, "text", p, "phrase", ids=["id"]).collect())
    assert got == sorted((i, x) for i, text in enumerate(texts) for x in phrases if text and x and x in text)
    short = contains.contains_join(t, "text", p, "phrase", 4)
    assert sorted((r.id, r.phrase) for r in short.collect()) == [g for g in got if len(g[1]) >= 4]


def test_few_rows_for_each_character(spark, small):
    questions = view(spark, small, "v_context_questions").selectExpr("lower(question) as text")
    names = view(spark, small, "v_context_tables").selectExpr("lower(table_name) as name")
    load = contains.piece_load(questions, "text", names, "name").first()
    assert load.characters > 10_000 and load.rows < 0.2 * load.characters


def test_few_rows_with_many_phrases(spark):
    texts = spark.range(400).selectExpr("sha2(cast(id as string), 256) || ' name_' || id || ' ' || sha2('x' || id, 256) as text")
    names = spark.range(300_000).selectExpr("substr(sha1(cast(id as string)), 1, 12) as name").unionByName(spark.range(500).selectExpr("'name_' || id as name"))
    load = contains.piece_load(texts, "text", names, "name").first()
    assert load.characters > 50_000 and load.rows < 0.2 * load.characters
    found = contains.contains_join(texts, "text", names, "name")
    assert found.filter("name like 'name%'").count() == sum(f"name_{i}".startswith(f"name_{j}") for i in range(400) for j in range(500))


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_precedents_are_the_newest(spark, block, monkeypatch):
    monkeypatch.setattr(memory, "NEWEST", block)
    rng = random.Random(block)
    vocabulary = ["alpha", "beta", "gamma", "delta", "epsilon", "alphabet", "rare"]
    past = [(i, " ".join(rng.choice(vocabulary[:6]) for _ in range(2)), None, rng.randrange(5)) for i in range(60)] + [(99, "rarely", "seen", -1)]
    asked = [(1, "what about ALPHA"), (2, "rare beta"), (3, "a b c"), (4, "nothing-known"), (5, None)]
    outcomes = spark.createDataFrame(past, "outcome_id int, question string, decision_summary string, created_at int")
    questions = spark.createDataFrame(asked, "question_id int, question string")
    got = sorted(tuple(r) for r in memory.precedents_bulk(questions, outcomes, 4).collect())
    want = []
    for key, text in asked:
        words = [w for w in (text or "").lower().split() if len(w) > 3][:5]
        hits = [p for p in past if not words or any(w in f"{p[1]} {p[2] or ''}" for w in words)]
        newest = sorted(hits, key=lambda p: (p[3], p[0]), reverse=True)[:4]
        want += [(key, rank + 1, p[0]) for rank, p in enumerate(newest)]
    assert got == sorted(want)
    assert memory.precedents_bulk(questions, outcomes.limit(0), 4).collect() == []


@pytest.mark.parametrize("depth", [None, 1, 2, 5, 6, 40])
def test_lineage_of_any_depth(spark, rows, depth, monkeypatch):
    rng = random.Random(9)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [(f"n{rng.randrange(31)}", f"n{rng.randrange(31)}") for _ in range(8)] + [("x", "x"), ("y", "x")]
    written = []
    monkeypatch.setattr(catalog, "cut", lambda df, label="": written.append(label) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    table = spark.createDataFrame(edges, "from_node string, to_node string")
    roots = spark.createDataFrame([("n30",), ("n4",), ("x",), ("nowhere",), ("n30",)], "root string")
    want = set()
    for root in ("n30", "n4", "x", "nowhere"):
        far, front = {root: 0}, {root}
        while front:
            front = {a for a, b in edges if b in front and a not in far}
            far |= {node: max(far.values()) + 1 for node in front}
        want |= {(root, a, b, far[b] + 1) for a, b in set(edges) if b in far and (depth is None or far[b] < depth)}
    got = rows(catalog.lineage(table, roots, depth), "root", "from_node", "to_node", "depth")
    assert got == sorted(want, key=repr)
    if depth is None:
        assert len(written) <= 7  # a path of 30 edges in five rounds, and one to see that there is no more
