"""Parts of the operators against trying everything."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyward.llm import jaccard, lines, mixing, packing, quality, shingles, suffixes, suffixtree
from tallyward.llm.shingles import shingle_sets


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 4))
def test_buckets_are_optimal(histogram, buckets):
    def padding(edges):
        return sum(n * (min(e for e in edges if e >= length) - length) for length, n in histogram.items())

    lengths = sorted(histogram)
    best = min(
        padding((*inner, lengths[-1]))
        for k in range(min(buckets, len(lengths)))
        for inner in itertools.combinations(lengths[:-1], k)
    )
    edges = packing.optimal_buckets(histogram, buckets)
    assert len(edges) <= buckets and padding(edges) == best


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc", bytes(range(256))])
def test_two_stage_sort_finds_repeated_windows(alphabet):
    random.seed(len(alphabet))
    for _ in range(12):
        runs = [bytes(random.choice(alphabet) for _ in range(random.randint(100, 300))) for _ in range(random.randint(1, 5))]
        runs += [r[random.randint(0, 20) :] for r in runs if len(r) > 140]
        seen = set()
        for run, found in zip(runs, suffixes.later_windows(runs), strict=True):
            want = []
            for i in range(len(run) - 99):
                if run[i : i + 100] in seen:
                    want.append(i)
                seen.add(run[i : i + 100])
            assert [a + k for a, n in found for k in range(n)] == want


def test_sorted_suffixes_are_in_order():
    random.seed(9)
    text = bytes(random.choice(b"abc") for _ in range(3000)) + bytes(120)
    ranked = suffixes.sort_suffixes(np.frombuffer(text, np.uint8), np.arange(2900))
    keys = [text[i : i + 100] for i in ranked]
    assert len(ranked) == 2900 and keys == sorted(keys)


def test_words_and_shingles_do_not_depend_on_the_block():
    texts = [b"", b" a  b\tc\nd E f ", b"a b c d e f", b"x"]
    together = list(shingle_sets(texts))
    for text, found in zip(texts, together, strict=True):
        assert (next(shingle_sets([text])) == found).all()
    assert [len(x) for x in together] == [0, 2, 2, 1]
    assert (together[1] == together[2]).all()
    assert len(shingles.shingle_hashes(np.arange(3, dtype=np.uint64))) == 1


def test_sketch_distance_is_at_most_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, 4) :: 2], rng.integers(0, 2**63, 60).astype(np.uint64)]))
        for p in (40, 90, 0):
            one, two = (dict(zip(*(x.tolist() for x in jaccard.sketch(s, p)), strict=True)) for s in (a, b))
            differing = sum(one.get(k) != two.get(k) for k in one.keys() | two.keys())
            assert differing <= len(np.setxor1d(a, b))


def test_variants_meet_within_one_word(spark):
    base = "one two three four five six seven eight nine ten".split()
    texts = [
        base,
        [*base[:3], "x", *base[4:]],  # changed
        base[:6] + base[7:],  # left out
        [*base, "eleven"],  # put in
        [*base[:2], "y", *base[3:7], "z", *base[8:]],  # two changes
        base[::-1],
    ]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_near, r.text) for r in lines.without_copies(docs).collect()}
    assert [got[i][0] for i in range(6)] == [0, 1, 1, 1, 0, 0]
    assert got[0][1] and not got[1][1]


def test_poisson_rates_are_met(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 4 = 0, 'a', 'b') as source", "repeat('x', 50) as text", "1 as n_chars", "'en' as lang")
    rows = mixing.mixed(docs, weights={"a": 3.0, "b": 1.0}).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in rows}
    assert abs(counts["a"] - 15_000) < 500 and abs(counts["b"] - 5_000) < 300


def test_sketch_quantiles(spark):
    rows = spark.range(1000).selectExpr(
        "'en' as lang", "'s' as source", "id as n_symbols", "1000L as n_words", "0L as n_dup_lines", "1L as n_lines", "0L as n_repeat_words", "0L as n_capitals", "5000L as word_chars"
    )
    got = quality.quartiles(quality.sketches(rows), ["lang", "source"]).filter("measure = 'symbols'").first()
    assert abs(got.q1 / 249 - 1) < 0.02 and abs(got.q3 / 749 - 1) < 0.02


def test_tree_is_a_distribution(spark):
    words = spark.createDataFrame([(bytearray(w), c, c) for w, c in ((b"the", 50), (b"then", 20), (b"an", 9), (b"zebra", 1))], "word binary, c bigint, n bigint")
    tree = suffixtree.Tree.grown(suffixtree.contexts(words, 10, least_share=0.01).collect())
    for context in (b" ", b" th", b" the", b"ze", b"qq"):
        total = sum(10 ** tree.symbol(context + bytes([x])) for x in range(256))
        assert abs(total - 1) < 1e-9
    assert tree.word(b"the") > tree.word(b"teh")


def test_randomness_battery(spark):
    from tallyward.llm import secrets

    random.seed(2)
    keys = ["".join(random.choice(secrets.ALPHABETS["base64"]) for _ in range(64)) for _ in range(60)]
    plain = ["ThatTheAndOfTheIngErOnReInEdAtEsThatTheAndOfTheIngErOnReInEdAtEs"[i:] + "TheAndOfThe"[:i] for i in range(10)]
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(keys + plain)], "doc_id bigint, text string")
    kinds = {r.doc_id: [s.kind for s in r.found] for r in secrets.secret_spans(docs, ["doc_id"]).collect()}
    assert sum(3 in kinds[i] for i in range(60)) >= 50
    assert not any(3 in kinds[i] for i in range(60, 70))
