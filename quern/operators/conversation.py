"""Conversations: turns of question and answer, the last few of each, and questions expanded by the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import blank, strip


def pair_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer) of messages (conv_id, turn, role, text): each user turn and the next turn's answer.

    System messages are passed over; a question without an answer before the next question has an empty one.
    """
    rows = messages.filter(F.col("role").isin("user", "assistant"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("next_role", F.lead("role").over(order)).withColumn("next_text", F.lead("text").over(order))
    answer = F.when(F.col("next_role") == "assistant", blank("next_text")).otherwise("")
    return rows.filter("role = 'user'").select("conv_id", "turn", blank("text").alias("question"), answer.alias("answer"))


def tail(turns: DataFrame, n: int = 4) -> DataFrame:
    """The last n turns of each conversation, in their order."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n)


def expand(message: Column, previous: Column) -> Column:
    """The message with the previous question, unless that is blank or the same but for case."""
    before = strip(blank(previous))
    same = (before == "") | (F.lower(before) == F.lower(message))
    return F.when(same, message).otherwise(F.concat(message, F.lit("\n\nPrevious question in this conversation: "), before))


def expanded(turns: DataFrame) -> DataFrame:
    """turns with query: the question as retrieval sees it."""
    previous = F.lag("question").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("previous", previous).withColumn("query", expand(F.col("question"), F.col("previous")))


def history_text(turns: DataFrame, answer_chars: int = 500) -> DataFrame:
    """(conv_id, history) of each conversation's last turn."""
    last = turns.groupBy("conv_id").agg(F.max_by(F.struct("question", "answer"), "turn").alias("t"))
    text = F.concat(F.lit("Previous question: "), F.col("t.question"), F.lit("\nPrevious answer: "), F.substring("t.answer", 1, answer_chars))
    return last.select("conv_id", text.alias("history"))
