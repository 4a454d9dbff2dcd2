"""Conversation history windows and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import prompts, templates
from textquarry.functions.text import capitalize, not_blank
from textquarry.operators.ordered import number_rows, with_lookback


def message_line() -> Column:
    return F.concat(
        F.lit("\n"),
        capitalize(F.coalesce("role", F.lit(""))),
        F.lit(": "),
        F.coalesce("text", F.lit("")),
    )


def with_history(messages: DataFrame, reach: int = 6, conversation: str = "conv_id") -> DataFrame:
    """Add ``history`` (the ``reach`` earlier messages in ``turn`` order) and ``n_history``.

    ``turn`` is unique in a conversation. Without earlier messages ``history`` is empty.
    """
    numbered = number_rows(messages, "turn", "_place", [conversation])
    # A window collects its rows in frame order, so the lines need no sorting.
    lines = F.collect_list(message_line())
    reached = with_lookback(
        numbered.withColumn("_place", F.col("_place") - 1), "_place", reach, {"_lines": lines},
        [conversation],
    )
    return reached.select(
        *messages.columns,
        F.array_join("_lines", "").alias("history"),
        F.size("_lines").alias("n_history"),
    )


def chat_prompts(
    messages: DataFrame, reach: int = 6, system: str = templates.CHAT_SYSTEM
) -> DataFrame:
    """Prompt of every user message that is not blank."""
    asked = with_history(messages, reach).where((F.col("role") == "user") & not_blank("text"))
    return asked.withColumn("prompt", prompts.chat("history", "text", system))


def append_exchange(
    messages: DataFrame, exchanges: DataFrame, conversation: str = "conv_id"
) -> DataFrame:
    """Append a user message and its reply to the end of each exchange's conversation.

    ``exchanges`` holds ``(conv_id, question, reply)``, one per conversation at most; a blank
    question adds nothing. A conversation without messages starts at turn 0.
    """
    last = messages.groupBy(conversation).agg(F.max("turn").alias("_last"))
    asked = exchanges.where(not_blank("question")).join(last, conversation, "left")
    rows = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("user").alias("role"), F.col("question").alias("text")),
        F.struct(F.lit(2).alias("step"), F.lit("assistant").alias("role"), F.col("reply").alias("text")),
    )
    added = asked.select(
        conversation, F.coalesce("_last", F.lit(-1)).alias("_last"), F.explode(rows).alias("m")
    ).select(
        conversation, (F.col("_last") + F.col("m.step")).alias("turn"), "m.role", "m.text"
    )
    return messages.unionByName(added)
