"""Passages set into the middle of other sentences, and short repeated lines."""

import random

from tallyward.llm import passages


def test_units_are_the_text():
    rng = random.Random(8)
    for _ in range(50):
        text = "".join(rng.choice(["word", "Other", "x", " ", "  ", "\n", ". ", ", ", "\t"]) + rng.choice(" ab") for _ in range(400))
        units = passages.sentences(text)
        assert "".join(text[a:b] for a, b, _ in units) == text
        assert all(unit == " ".join(text[a:b].lower().split()) for a, b, unit in units)


def test_passages_in_mid_sentence_are_found(spark):
    rng = random.Random(6)

    def words(n):
        return [f"w{rng.randrange(10**7)}" for _ in range(n)]

    rows, planted = [], []
    for i in range(100):
        passage = words(50)
        planted.append(passage)
        rows += [(2 * i, " ".join(words(30) + passage + words(30))), (2 * i + 1, " ".join(words(25) + passage + words(35)) + ".")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in passages.without_repeats(docs).collect()}
    texts = dict(rows)
    assert all(got[2 * i].text == texts[2 * i] for i in range(100))
    gone = 0
    for i, passage in enumerate(planted):
        left = set(got[2 * i + 1].text.split())
        assert len(set(texts[2 * i + 1].rstrip(".").split()) - set(passage) - left) <= 1  # the last word has the stop
        gone += len(set(passage) - left)
    found = sum(bool(got[2 * i + 1].removed) for i in range(100))
    assert found >= 95 and gone >= 0.5 * 50 * 100, (found, gone)


def test_short_repeated_lines_go(spark):
    docs = spark.createDataFrame([(1, "all rights reserved\nown one"), (2, "own two\nAll rights  reserved\n")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in passages.without_repeats(docs).collect()} == {1: "all rights reserved\nown one", 2: "own two\n"}
