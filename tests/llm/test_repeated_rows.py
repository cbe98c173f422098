"""Rows equal in id and text are one document: none is a later copy of the other."""

import random

import pytest

import corpus_pipeline
from tallyward.llm import lines, passages, suffixes


def corpus(spark, parts):
    """Document 2 twice, without an earlier copy; one line of document 3 is near one of it, document 4 repeats it."""
    rng = random.Random(3)
    first = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + "." for _ in range(3)]
    near = " ".join(["other", *first[0].split()[1:]])
    rows = [(1, "something else altogether"), (2, "\n".join(first)), (2, "\n".join(first)), (3, near), (4, "\n".join(first))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs.coalesce(1) if parts == 1 else docs.repartition(parts), "\n".join(first)


@pytest.mark.parametrize("parts", [1, 5])
def test_a_repeated_row_keeps_its_text(spark, parts):
    docs, text = corpus(spark, parts)
    for operator, kept in ((lines.without_copies, "text"), (passages.without_repeats, "text"), (suffixes.without_repeats, "kept")):
        got = [(r.doc_id, r[kept] if isinstance(r[kept], str) else bytes(r[kept]).decode()) for r in operator(docs).collect()]
        assert sorted(t for i, t in got if i == 2) == [text, text], operator
        assert [t.strip() for i, t in got if i == 4] == [""], operator
    near = {r.doc_id: r.n_near for r in lines.without_copies(docs).collect()}
    assert near[2] == 0 and near[3] == 1


@pytest.mark.parametrize("parts", [1, 5])
def test_a_repeated_document_is_not_dropped_as_a_whole(spark, parts):
    docs, _ = corpus(spark, parts)
    docs = docs.selectExpr("*", "length(text) as n_chars")
    assert [r.doc_id for r in corpus_pipeline.line_dedup(spark, docs, "").orderBy("doc_id").collect()] == [1, 2, 2]
