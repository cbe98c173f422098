import pytest
from pyspark.sql import functions as F

from tallyward.operators import catalog, conversations, corpus, datachecks, usage
from tallyward.plans.contains import contains_join


def test_contains_join_equals_all_pairs(spark):
    texts = ["the railway station", "rail", "", "ab", "a", "xrailwayx and https://host/very/long/path-01", "éa", None]
    phrases = ["", "rail", "a", "ab", "railway station", "zzz", "https://host/very/long/path-01", "é", "way s"]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    right = spark.createDataFrame([(p,) for p in phrases], "p string")
    expected = sorted((i, p) for i, t in enumerate(texts) for p in phrases if t is not None and p and p in t)
    for ids in (None, ["i"]):
        got = contains_join(left, "t", right, "p", ids=ids)
        assert sorted((r["i"], r["p"]) for r in got.collect()) == expected


def test_lineage_ends_on_cycles(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c"), ("b", "c")], "from_node string, to_node string")
    roots = spark.createDataFrame([("c",), ("a",)], "root string")
    got = rows(catalog.lineage(edges, roots, 6).filter("root = 'c'"), "from_node", "to_node", "depth")
    assert got == [("a", "b", 2), ("b", "c", 1), ("c", "a", 3), ("x", "c", 1)]
    assert rows(catalog.lineage_of(edges, "a", 1)) == [("c", "a", 1)]


def test_gaps_of_each_kind(spark, rows):
    two = "table_name string, column_name string"
    gaps = catalog.governance_gaps(
        spark.createDataFrame([("t", "x"), ("t", "y")], two),
        spark.createDataFrame([("t", "y"), ("u", "z")], two),
        spark.createDataFrame([("t",), ("u",)], "table_name string"),
        spark.createDataFrame([("b", "T"), ("b", "t"), ("b", "v")], "bundle_id string, table_name string"),
        spark.createDataFrame([("r", "T.x")], "rule string, target string"),
    )
    assert rows(gaps) == [
        ("pii_not_in_catalog", "u.z"),
        ("pii_not_in_policy", "t.x"),
        ("table_no_rules", "b/v"),
        ("table_not_in_bundle", "u"),
    ]


def test_glossary_with_missing_parts(spark):
    terms = spark.createDataFrame(
        [("Delay", None, None), ("Late", "x", ["DELAYED arrival", None]), ("Other", "no", [])],
        "name string, description string, synonyms array<string>",
    )
    assert {r["name"] for r in catalog.search_glossary(terms, "delay").collect()} == {"Delay", "Late"}


def _usage_inputs(spark):
    messages = spark.createDataFrame(
        [(1, 1, "user", None, None, "2024-01-30 10:00:00"), (2, 1, "assistant", "p", "m", "2024-01-30 10:01:00"),
         (3, 1, "assistant", "q", "m", "2024-01-29 10:00:00"), (4, 1, "user", None, None, "2024-01-30 11:00:00"), (5, 1, "user", None, None, "2023-01-01 00:00:00")],
        "message_id long, chat_id long, role string, provider string, model_id string, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    chats = spark.createDataFrame([(1, "pr")], "chat_id long, project_id string")
    parts = spark.createDataFrame(
        [(1, 1, 0, 0, 0, 1), (1, 2, 0, 0, 0, 2), (2, 1000000, None, 0, 2000000, 3), (3, 5, 5, 5, 5, 20), (5, 1, 1, 1, 1, 1)],
        "message_id long, input_no_cache long, input_cache_read long, input_cache_write long, output_total long, total long",
    )
    prices = spark.createDataFrame([("p", "m", 3.0, 1.0, 1.0, 15.0)], "provider string, model_id string, price_no_cache double, price_cache_read double, price_cache_write double, price_output double")
    return messages, chats, parts, prices


def test_usage_counts_user_messages_with_parts_only(spark):
    report = usage.usage(*_usage_inputs(spark), "day", "2024-01-31 00:00:00", "pr")
    got = {r["period"]: r for r in usage.fill_gaps(report, "day", "2024-01-30 23:00:00").collect()}
    assert len(got) == 30
    day = got["2024-01-30"]
    assert (day["message_count"], day["input_no_cache"], day["input_cache_read"], day["total_cost"]) == (1, 1000003, 0, 33.0)
    assert (got["2024-01-29"]["message_count"], got["2024-01-29"]["total_cost"]) == (0, 0.0)
    assert got["2024-01-01"]["total"] == 0


def test_fill_gaps_drops_periods_outside(spark):
    counted = spark.createDataFrame([("2022-01", 5), ("2024-01", 7)], "period string, n long")
    got = {r["period"]: r["n"] for r in usage.fill_gaps(counted, "month", "2024-01-31 00:00:00").collect()}
    assert len(got) == 12 and got["2024-01"] == 7 and got["2023-02"] == 0 and "2022-01" not in got


def test_range_filter(spark):
    df = spark.createDataFrame([("2024-05-31",), ("2024-02-29",), ("2024-02-28",), ("junk",), (None,)], "x string")
    assert usage.range_filter(df, "x", "3m").count() == 2
    assert usage.range_filter(df, "x", "all").count() == 5
    assert usage.range_filter(df, "x", "7d").count() == 1


def test_search_shows_titles_first(spark):
    chats = spark.createDataFrame([(1, "u", "Rail plan", 1), (2, "u", "Other", 9), (3, "u", "More", 5), (4, "v", "rail", 99)], "chat_id long, user_id string, title string, updated_at long")
    messages = spark.createDataFrame([(10, 1), (20, 2), (21, 2), (30, 3)], "message_id long, chat_id long")
    parts = spark.createDataFrame([(10, 0, "rail"), (20, 0, "x"), (21, 0, "RAIL b"), (21, 1, "rail c"), (30, 0, "rail d")], "message_id long, part_no long, text string")
    got = [tuple(r) for r in conversations.search_chats(chats, messages, parts, "rail", "u", 2).orderBy("rank").collect()]
    assert got == [(1, 1, "Rail plan", None), (2, 2, "Other", "RAIL b")]


def test_upsert_messages_replaces_all_parts(spark, rows):
    m = spark.createDataFrame([(1, "old")], "message_id long, role string")
    p = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "message_id long, part_no long, text string")
    new_m = spark.createDataFrame([(1, "new"), (3, "new")], "message_id long, role string")
    new_p = spark.createDataFrame([(1, 0, "z")], "message_id long, part_no long, text string")
    messages, parts = conversations.upsert_messages(m, p, new_m, new_p)
    assert rows(messages) == [(1, "old"), (3, "new")]
    assert rows(parts) == [(1, 0, "z"), (2, 0, "c")]


def test_load_chat_in_order(spark):
    chats = spark.createDataFrame([(1, "t"), (2, "t")], "chat_id long, title string")
    messages = spark.createDataFrame([(5, 1, "b", 2), (6, 1, "a", 1), (7, 1, "none", 3), (8, 2, "x", 1)], "message_id long, chat_id long, role string, created_at long")
    parts = spark.createDataFrame([(5, 1, "y"), (5, 0, "x"), (6, 0, "w"), (8, 0, "v")], "message_id long, part_no long, text string")
    got = [(r["message_no"], r["part_no"], r["text"]) for r in conversations.load_chat(chats, messages, parts, 1).collect()]
    assert got == [(1, 0, "w"), (2, 0, "x"), (2, 1, "y")]


DOC = "one two\nTWO two one\n\nlast two\n"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a/b/x.txt", DOC), ("a/y.md", "two"), ("tmp/z.txt", "two")], "path string, text string")


def test_grep_counts_submatches(docs, rows):
    hits = corpus.grep(docs, "path", "text", "two", glob="*.txt", ignore=["tmp/"])
    assert rows(hits, "path", "line_number", "submatch") == [("a/b/x.txt", 1, 1), ("a/b/x.txt", 2, 1), ("a/b/x.txt", 4, 1)]
    loud = corpus.grep(docs, "path", "text", "two", ignore_case=True, glob="a/**/x.txt")
    assert len(rows(loud)) == 4
    total = corpus.grep_totals(docs, "path", "text", "two", max_results=4).first()
    assert tuple(total) == (5, 5, 3, True)
    assert corpus.grep_totals(docs, "path", "text", "absent").first()["truncated"] is False


def test_context_stops_at_both_ends(docs):
    got = {
        r["line_number"]: (list(r["context_before"]), list(r["context_after"]))
        for r in corpus.matching_lines(docs, "path", "text", "two", glob="x.txt", context=2).collect()
    }
    assert got == {
        1: ([], ["TWO two one", ""]),
        2: (["one two"], ["", "last two"]),
        4: (["TWO two one", ""], []),
    }


@pytest.mark.parametrize(
    "glob, path, fits",
    [("*.py", "a/b.py", True), ("*.py", "b.pyc", False), ("a/*.py", "a/b.py", True), ("a/*.py", "a/c/b.py", False),
     ("**/c/*", "a/c/b", True), ("a/**", "a/c/b", True), ("?.md", "x.md", True), ("?.md", "xy.md", False)],
)
def test_globs(glob, path, fits):
    import re

    assert bool(re.search(corpus.glob_regex(glob), path)) is fits


def test_keys_and_domains(spark, rows):
    df = spark.createDataFrame([(1, "x", 7), (1, "y", 8), (None, "z", 9), (2, None, None)], "id long, kind string, parent long")
    parents = spark.createDataFrame([(7,), (9,)], "pid long")
    got = rows(datachecks.check_keys(df, ["id"], {"parent": (parents, "pid")}))
    assert got == [("id", "not_null", 0, 1), ("id", "unique", 1, 2), ("parent", "foreign", 1, 1)]
    bad = datachecks.check_domain(df, {"kind": ["x", "y"]}, {"differs": F.col("id") != F.col("parent")})
    assert rows(bad) == [("differs", 0), ("kind", 1)]
