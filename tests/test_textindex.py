"""Search by trigrams: the rows of the scan, read from candidates only."""

import pytest
from pyspark.sql import functions as F

from tallyward.operators import corpus, textindex
from tallyward.session import scratch
from tallyward.suite.corpora import _docs

PATTERNS = [
    "icensed under",
    r"th[ae]\w+ion",
    r"(?i)LICENSE",
    r"lic(?:ense|enced)d? under",
    r"MIT License\.?",
    r"password|secret",
    r"\bunder the [A-Z]+",
    r"[0-9]{4}",
    r"e+rea(?!th)",
    r"xyzzy never there",
    r"und\.|eine",
    r"é\w*tion",
]


@pytest.fixture(scope="module")
def both(spark, small):
    docs = _docs(spark, small)
    odd = spark.createDataFrame([("odd/null", None), ("odd/empty", ""), ("odd/twice", "The MIT License\nagain"), ("odd/twice", "other"), (None, "MIT License")], "path string, text string")
    docs = docs.unionByName(odd)
    return docs, textindex.write_index(docs, "path", "text", scratch(spark, "index"), 8)


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_rows_as_the_scan(both, rows, pattern):
    docs, index = both
    indexed = textindex.matching_lines(index, pattern)
    scanned = corpus.matching_lines(docs.filter("path is not null"), "path", "text", pattern)
    assert rows(indexed.filter("path is not null")) == rows(scanned)


def test_only_candidates_are_read(both):
    docs, index = both
    found = textindex.searched(index, "MIT License")
    assert 0 < found.count() < docs.count() / 2
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text and "PushedFilters: [In(gram" in text


def test_literals_that_every_match_needs():
    needed = {
        "abc": ["abc"], "abcd?e": ["abc"], "abc+def": ["abc", "def"], "ab(cde)fgh": ["fgh"], "abc|def": [], "a(b|c)def": ["def"], "(?i)AbCd": ["abcd"],
        r"\bfoo\.bar\b": ["foo.bar"], r"foo\x41bar": [], r"\Qabc\E": [], "[abc]def": ["def"], "[^]abc]def": [], "(?x) a b c": [], "abc{2}def": ["def"], "x*": [], "naïve": [], "abcé": ["abc"],
    }
    for pattern, literals in needed.items():
        assert textindex.needed_literals(pattern) == literals, pattern
    assert textindex.needed_grams("abcd") == ["abc", "bcd"]


def test_an_empty_corpus(spark):
    docs = spark.createDataFrame([], "path string, text string")
    index = textindex.write_index(docs, "path", "text", scratch(spark, "index"), 4)
    assert textindex.grep(index, "abc").collect() == [] and index.postings.agg(F.count("*")).first()[0] == 0
