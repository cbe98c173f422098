"""The pipeline's stages, each against a plain version over the rows that came before."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tallyward.llm import op1, op2, op5, packing
from tallyward.llm.common import stored
from tallyward.sources.tables import load


@pytest.fixture(scope="module")
def tables(spark, small):
    """The input and the result of every stage."""
    docs = load(spark, small, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), name)
        out.append(docs)
    return out


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def sql(df, query):
    con = duckdb.connect()
    con.register("frame", df.toArrow())
    con.execute("create table documents as select * from frame")
    return sorted(con.execute(query).fetchall(), key=repr)


def test_quality_stage(tables):
    want = sql(tables[0], f"with v as ({op2.SQL}) select doc_id from v where kept")
    assert rows(tables[1], "doc_id") == want
    assert tables[1].columns == tables[0].columns


def test_line_stage(tables):
    want = sql(
        tables[1],
        f"""with {op1.LINES_SQL} select doc_id, kept from (select doc_id, string_agg(case when not exact and not near then line end, chr(10) order by i) as kept,
            bool_or(exact or near) as hit from judged group by doc_id) where not hit or regexp_matches(coalesce(kept, ''), '[^\\x20\\x09-\\x0D]')""",
    )
    assert rows(tables[2], "doc_id", "text") == want
    assert all(r.n_chars == len(r.text) for r in tables[2].collect())


def test_jaccard_stage(tables, shingles):
    docs = {r.doc_id: shingles(r.text) for r in tables[2].collect()}
    kept, gone = {r.doc_id for r in tables[3].collect()}, set()
    for a in sorted(docs):
        for b in docs:
            if a < b and docs[a] and 100 * len(docs[a] & docs[b]) >= 75 * len(docs[a] | docs[b]):
                gone.add(b)
    assert kept == docs.keys() - gone


def test_mixing_stage(tables):
    want = Counter(r[0] for r in sql(tables[3], f"with {op5.mixture_sql('documents')} select doc_id from mixture"))
    assert Counter(r.doc_id for r in tables[4].collect()) == want


def test_packing_stage(tables):
    before = Counter()
    for r in tables[4].collect():
        before[r.doc_id] += len(r.text.split()) + 1
    after = Counter()
    for r in tables[5].collect():
        after[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.bucket_tokens <= packing.MAX_TOKENS
    assert before == after


def test_run_is_the_stages_in_order(spark, small, tables):
    got = corpus_pipeline.run(spark, small)
    assert rows(got, "doc_id", "piece", "n_tokens") == rows(tables[-1], "doc_id", "piece", "n_tokens")
