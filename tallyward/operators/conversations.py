"""Conversation tables: feedback, search, assembly, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.operators.memory import upsert_latest
from tallyward.plans.ordered import number_rows


def upsert_feedback(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Last vote per message: ``message_id, vote, explanation, created_at``.

    The first feedback's time is kept.
    """
    columns = existing.columns
    old = existing.withColumn("_written", F.col("created_at"))
    votes = new.withColumn("_written", F.col("created_at"))
    latest = upsert_latest(old, votes, ["message_id"], ["_written", "vote"], "created_at")
    return latest.select(*columns)


def recent_feedback(
    feedback: DataFrame,
    messages: DataFrame,
    chats: DataFrame,
    users: DataFrame,
    parts: DataFrame,
    project: str | None = None,
    n: int = 10,
) -> DataFrame:
    """The newest votes with the user's name and the text of the message.

    Texts are put together only for the ``n`` messages that are shown.
    """
    scoped = chats if project is None else chats.filter(F.col("project_id") == project)
    joined = (
        feedback.join(messages.select("message_id", "chat_id"), "message_id")
        .join(scoped.select("chat_id", "user_id"), "chat_id")
        .join(users.select("user_id", "user_name"), "user_id")
    )
    newest = joined.orderBy(F.col("created_at").desc(), F.col("message_id").desc()).limit(n)
    shown = parts.filter(F.col("type") == "text").join(newest.select("message_id"), "message_id", "left_semi")
    texts = shown.groupBy("message_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("part_no", "text"))), lambda p: p["text"]), " "
        ).alias("message_text")
    )
    return newest.join(texts, "message_id", "left").select(
        "message_id", "vote", "explanation", "created_at", "user_name", "message_text"
    )


def search_chats(
    chats: DataFrame, messages: DataFrame, parts: DataFrame, query: str, user: str | None = None, n: int = 10
) -> DataFrame:
    """``rank, chat_id, title, matched_text``: title hits first, then content hits.

    Content hits are the newest ``2n`` matching parts, one per chat. The final
    ranking only sees these few rows.
    """
    needle = F.lit(query.lower())
    mine = chats if user is None else chats.filter(F.col("user_id") == user)
    titled = (
        mine.filter(F.contains(F.lower("title"), needle))
        .select("chat_id", "title", "updated_at")
        .orderBy(F.col("updated_at").desc(), "chat_id")
        .limit(n)
    )
    hits = parts.filter(F.contains(F.lower("text"), needle)).select("message_id", "part_no", "text")
    content = (
        hits.join(messages.select("message_id", "chat_id"), "message_id")
        .join(mine.select("chat_id", "title", "updated_at"), "chat_id")
        .orderBy(F.col("updated_at").desc(), "chat_id", "message_id", "part_no")
        .limit(2 * n)
    )
    place = F.struct("message_id", "part_no")
    first_hits = content.groupBy("chat_id", "title", "updated_at").agg(F.min_by("text", place).alias("matched_text"))
    both = titled.select(
        F.lit(0).alias("_branch"), "*", F.lit(None).cast("string").alias("matched_text")
    ).unionByName(
        first_hits.join(titled.select("chat_id"), "chat_id", "left_anti").select(F.lit(1).alias("_branch"), "*")
    )
    w = Window.partitionBy(F.lit(0)).orderBy("_branch", F.col("updated_at").desc(), "chat_id")
    ranked = both.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col("rank") <= n).select("rank", "chat_id", "title", "matched_text")


def assemble(
    chats: DataFrame,
    messages: DataFrame,
    parts: DataFrame,
    feedback: DataFrame | None = None,
    split: bool = False,
) -> DataFrame:
    """Every conversation in reading order, one row per part.

    ``message_no`` counts the messages of a chat that have parts. Nesting is left to the
    reader of a single chat, so a chat of any size stays spread out.
    """
    spoken = messages.join(parts.select("message_id").distinct(), "message_id", "left_semi")
    spoken = spoken.join(chats.select("chat_id", "title"), "chat_id")
    numbered = number_rows(spoken, "chat_id", ["created_at", "message_id"], "created_at", split)
    numbered = numbered.withColumnRenamed("seq", "message_no").drop("prev")
    if feedback is not None:
        numbered = numbered.join(feedback.select("message_id", "vote"), "message_id", "left")
    return numbered.join(parts, "message_id")


def load_chat(
    chats: DataFrame, messages: DataFrame, parts: DataFrame, chat_id, feedback: DataFrame | None = None
) -> DataFrame:
    """One conversation in reading order."""
    one = assemble(
        chats.filter(F.col("chat_id") == chat_id), messages.filter(F.col("chat_id") == chat_id), parts, feedback
    )
    return one.orderBy("message_no", "part_no")


def upsert_messages(
    messages: DataFrame, parts: DataFrame, new_messages: DataFrame, new_parts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Insert absent messages; replace all parts of every message that is written.

    Of several new rows of one message, the least in order of all columns is
    written, so a retry writes the same one.
    """
    others = [c for c in new_messages.columns if c != "message_id"]
    row = F.struct(*others)
    least = new_messages.groupBy("message_id").agg(F.min(row).alias("_row")).select("message_id", "_row.*")
    fresh = least.join(messages.select("message_id"), "message_id", "left_anti")
    written = new_messages.select("message_id").distinct()
    kept = parts.join(written, "message_id", "left_anti")
    return (
        messages.unionByName(fresh.select(*messages.columns)),
        kept.select(*parts.columns).unionByName(new_parts.select(*parts.columns)),
    )
