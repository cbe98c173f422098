"""Each measure rejects, and groups set fences of their own."""

import random

import pytest

from tallyward.llm import quality

PLAIN = {"lines": 20, "words": 8, "letters": 5, "capital": 0.1}


def text(rng, symbols=0, dup_lines=0, **how):
    shape = PLAIN | how
    lines = []
    for _ in range(shape["lines"]):
        words = []
        for _ in range(shape["words"]):
            n = max(2, shape["letters"] + rng.randint(-1, 1))
            word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
            words.append(word.capitalize() if rng.random() < shape["capital"] else word)
        lines.append(" ".join(words))
    for i in range(dup_lines):
        lines[-1 - i] = lines[0][: len(lines[0]) // 8] or "x"
    return "\n".join(lines) + " #" * symbols


ODD = {
    "symbols": {"symbols": 9},
    "dup_lines": {"dup_lines": 5},
    "line_words": {"words": 60, "lines": 4},
    "capitals": {"capital": 1.0},
    "word_length": {"letters": 12},
    "short_words": {"letters": 2},
}


@pytest.fixture(scope="module")
def verdicts(spark):
    rng = random.Random(11)
    rows = [(i, text(rng), "en", "plain") for i in range(300)]
    # the same odd texts in a group where they are the rule
    rows += [(1000 + i, text(rng, capital=1.0, symbols=9), "en", "loud") for i in range(300)]
    odd = {name: 5000 + i for i, name in enumerate(ODD)}
    rows += [(odd[name], text(rng, **how), "en", "plain") for name, how in ODD.items()]
    rows += [(6000, text(rng, symbols=2), "en", "plain"), (6001, text(rng, dup_lines=2), "en", "plain"), (7000, text(rng, capital=1.0, symbols=9), "en", "loud")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, ["doc_id"]).collect()}
    return odd, kept


@pytest.mark.parametrize("measure", ODD)
def test_each_measure_rejects(verdicts, measure):
    odd, kept = verdicts
    assert not kept[odd[measure]]


def test_groups_set_their_own_fences(verdicts):
    _, kept = verdicts
    assert kept[7000] and sum(kept[1000 + i] for i in range(300)) >= 297


def test_clean_texts_stay(verdicts):
    _, kept = verdicts
    assert sum(kept[i] for i in range(300)) >= 297 and kept[6000] and kept[6001]
