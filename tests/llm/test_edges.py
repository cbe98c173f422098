"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from tallyward.llm import fingerprints, jaccard, lines, mixing, packing, passages, quality, secrets, suffixes, suffixtree

OPERATORS = {
    "lines": lines.without_copies,
    "quality": quality.quality_filter,
    "verdicts": lambda d: quality.quality_verdicts(d, ["doc_id"]),
    "secrets": lambda d: secrets.secret_spans(d, ["doc_id"]),
    "tree": suffixtree.scored,
    "mixing": mixing.mixed,
    "passages": passages.without_repeats,
    "packing": packing.packed,
    "suffixes": suffixes.without_repeats,
    "fingerprints": fingerprints.fingerprinted,
    "jaccard": jaccard.similar,
    "first of each": jaccard.one_of_each,
}
ONE_EACH = ["lines", "verdicts", "secrets", "tree", "passages", "suffixes", "fingerprints", "jaccard"]
CARRIES = ["lines", "passages", "packing", "suffixes", "mixing", "quality", "first of each"]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, edges):
    assert OPERATORS[name](edges.limit(0)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, edges):
    rows = OPERATORS[name](edges).collect()
    assert rows
    if name in ONE_EACH:
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(r.doc_id) for r in edges.select("doc_id").collect())


@pytest.mark.parametrize("name", CARRIES)
def test_other_columns_are_carried(name, edges):
    before = {c for c in edges.columns}
    rows = OPERATORS[name](edges)
    assert before <= set(rows.columns)
    assert {r.tag for r in rows.select("tag").collect()} == {"own tag"}


def test_results_of_odd_rows(edges):
    verdicts = {r.doc_id: r for r in quality.quality_verdicts(edges, ["doc_id"]).collect()}
    assert not verdicts[5].kept and verdicts[5].n_words == 0 and verdicts[1].n_repeat_words == 0
    found = {r.doc_id: [s.kind for s in r.found] for r in secrets.secret_spans(edges, ["doc_id"]).collect()}
    assert found[5] == [] and found[10][:3] == [0, 2, 1]
    parts = {r.doc_id: r for r in jaccard.similar(edges).collect() if r.doc_id is not None}
    assert parts[5].n == 0 and parts[5].component_id == 5 and parts[8].component_id == 7
    kept = jaccard.one_of_each(edges).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept).count("2") == 0
    cut = {(r.doc_id, r.text): r for r in suffixes.without_repeats(edges).collect()}
    eleven = cut[11, "aaaa " * 400]
    assert bytes(eleven.kept) == b"aaaa " and len(eleven.spans) == 1
    pieces = packing.packed(edges).filter("doc_id = 7").orderBy("piece").collect()
    assert "".join(p.text for p in pieces) == edges.filter("doc_id = 7").first().text
    assert sum(p.n_tokens for p in pieces) == 60_001


def test_a_single_document(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h", "en", "s", 15)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, operator in OPERATORS.items():
        assert len(operator(one).collect()) <= 2, name
    assert fingerprints.fingerprinted(one).first().near_next == 1.0


def test_stages_on_odd_rows(spark, edges):
    docs = edges.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
