"""Agent memory and search for precedents."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.textcols import keywords
from tallyward.plans.contains import contains_join
from tallyward.plans.model import Policy
from tallyward.session import cut, spread

SHORTEST_WORD = 4


def upsert_latest(
    existing: DataFrame, new: DataFrame, keys: list[str], order: list[str], created: str | None = None
) -> DataFrame:
    """Last write per key wins; ``created`` keeps its first value.

    The winner is an aggregate, so writes of one key are combined before the
    shuffle.
    """
    both = existing.unionByName(new)
    whole = F.struct(*[F.col(c) for c in both.columns])
    aggregates = [F.max_by(whole, F.struct(*order)).alias("_row")]
    if created is not None:
        aggregates.append(F.min(created).alias("_created"))
    latest = both.groupBy(*keys).agg(*aggregates)
    columns = [
        F.col("_created").alias(c) if c == created else F.col(f"_row.{c}").alias(c) for c in both.columns
    ]
    return latest.select(*columns)


def upsert_memory(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value memory: ``agent_id, key, content, created_at, updated_at``."""
    return upsert_latest(existing, new, ["agent_id", "key"], ["updated_at", "content"], "created_at")


def recall(
    memories: DataFrame, agent: str, policy: Policy, scope: str = "all", key: str | None = None, top: int = 20
) -> DataFrame:
    """The most trusted candidate or active memories an agent may see.

    Asking for the bundle scope of an agent without a bundle gives nothing.
    """
    known = policy.agent(agent)
    bundle = known.bundle if known else None
    tests = []
    if scope in ("agent", "all"):
        tests.append((F.col("scope_type") == "agent") & (F.col("scope_id") == agent))
    if scope in ("bundle", "all") and bundle is not None:
        tests.append((F.col("scope_type") == "bundle") & (F.col("scope_id") == bundle))
    if scope in ("global", "all"):
        tests.append(F.col("scope_type") == "global")
    found = memories.filter(F.col("status").isin("candidate", "active") & reduce(or_, tests, F.lit(False)))
    if key is not None:
        needle = F.lit(key.lower())
        found = found.filter(F.contains(F.lower("title"), needle) | F.contains(F.lower("summary"), needle))
    return found.orderBy(F.col("confidence").desc(), F.col("created_at").desc(), "memory_id").limit(top)


def precedents(outcomes: DataFrame, question: str, n: int = 5) -> DataFrame:
    """Newest outcomes that share a keyword with one question; no keyword, no filter."""
    words = [w for w in question.lower().split() if len(w) >= SHORTEST_WORD][:5]
    found = outcomes
    if words:
        hits = [
            F.contains(F.lower(c), F.lit(w)) for w in words for c in ("question", "decision_summary")
        ]
        found = outcomes.filter(reduce(or_, [F.coalesce(h, F.lit(False)) for h in hits]))
    return found.orderBy(F.col("created_at").desc(), F.col("outcome_id").desc()).limit(n)


def _top(df: DataFrame, key: str, n: int) -> DataFrame:
    """The newest ``n`` outcomes of each key.

    Spark cuts to ``n`` rows per key on both sides of the shuffle, so a key
    shared by a large part of the rows reaches one task as ``n`` rows per
    input partition.
    """
    w = Window.partitionBy(key).orderBy(F.col("created_at").desc(), F.col("outcome_id").desc())
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)


#: Outcomes of the first, newest block of a bulk search.
NEWEST = 256


def _newest_with(outcomes: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """``word, outcome_id, created_at``: the newest ``n`` outcomes whose text contains each word.

    A word holds no white space, so it lies inside a token: the distinct tokens
    are searched for the words, and the outcomes are joined by token.
    """
    both = F.lower(F.concat_ws(" ", "question", "decision_summary"))
    listed = F.explode(F.array_distinct(F.split(both, r"\s+"))).alias("token")
    tokens = spread(outcomes).select("outcome_id", "created_at", listed).filter(F.length("token") >= SHORTEST_WORD)
    inside = contains_join(cut(tokens.select("token").distinct(), "tokens"), "token", words, "word", SHORTEST_WORD)
    found = inside.join(tokens, "token").groupBy("word", "outcome_id").agg(F.max("created_at").alias("created_at"))
    return _top(found, "word", n).drop("_rank")


def precedents_bulk(questions: DataFrame, outcomes: DataFrame, n: int = 5) -> DataFrame:
    """``question_id, rank, outcome_id``: precedents for a table of questions.

    Only the newest ``n`` outcomes of a word can be among those of a question,
    so each word is answered first. Words that ``n`` outcomes of the newest
    block hold are settled there, as all others are older; that is where
    frequent words end. The rest are rare, and few tokens of the older texts
    hold them. Both sides of each shuffle are cut to ``n`` per key
    while ``n`` is below Spark's limit for ranks per group
    (``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 unless set).
    ``outcome_id`` identifies an outcome.
    """
    asked = questions.select("question_id", keywords(F.col("question")).alias("_words"))
    asked = asked.select(
        "question_id",
        F.explode(F.when(F.size("_words") > 0, F.array_distinct("_words")).otherwise(F.array(F.lit("")))).alias("word"),
    )
    words = cut(asked.filter(F.col("word") != "").select("word").distinct(), "words")

    newest_first = [F.col("created_at").desc(), F.col("outcome_id").desc()]
    ends = outcomes.select("created_at", "outcome_id").orderBy(*newest_first).limit(max(NEWEST, n))
    # one row: the oldest of the block
    last = ends.agg(F.min(F.struct("created_at", "outcome_id")).alias("end")).first()["end"]
    place = F.struct("created_at", "outcome_id")
    if last is None:
        found = [questions.schema["question_id"], T.StructField("rank", T.LongType()), outcomes.schema["outcome_id"]]
        return questions.sparkSession.createDataFrame([], T.StructType(found))
    edge = F.struct(*[F.lit(last[c]).cast(outcomes.schema[c].dataType).alias(c) for c in ("created_at", "outcome_id")])
    older = place < edge

    settled = cut(_newest_with(outcomes.filter(~older), words, n), "newest")
    open_words = words.join(settled.groupBy("word").agg(F.count("*").alias("_n")).filter(F.col("_n") >= n), "word", "left_anti")
    open_words = cut(open_words, "rare")
    rare = _newest_with(outcomes.filter(older), open_words, n)
    by_word = _top(settled.unionByName(rare), "word", n).drop("_rank")

    newest = outcomes.orderBy(*newest_first).limit(n).select(F.lit("").alias("word"), "outcome_id", "created_at")
    per_question = asked.join(by_word.unionByName(newest), "word").groupBy("question_id", "outcome_id").agg(
        F.max("created_at").alias("created_at")
    )
    return _top(per_question, "question_id", n).select(
        "question_id", F.col("_rank").cast("bigint").alias("rank"), "outcome_id"
    )
