"""Conversations as stored: history for a follow-up, positions of new messages, recency, restored views, answer outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.operators.ordered import last_before

HISTORY = 6


def history(messages: DataFrame, turns: int = HISTORY) -> DataFrame:
    """The last turns of each conversation that a rewrite may see: user turns and answered assistant turns, numbered in order."""
    seen = messages.filter((F.col("role") == "user") | ((F.col("role") == "assistant") & (F.coalesce(F.col("payload.status"), F.lit("")) == "answered")))
    back = Window.partitionBy("conversation_id").orderBy(F.desc("position"), "id")
    kept = seen.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= turns)
    size = F.count("*").over(Window.partitionBy("conversation_id"))
    return kept.withColumn("turn", (size - F.col("back")).cast("int")).drop("back")


def next_positions(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(id, next_position): where the next message of each conversation goes; 0 for one without messages."""
    last = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.max("position").alias("last"))
    return conversations.select("id").join(last, "id", "left").select("id", (F.coalesce("last", F.lit(-1)) + 1).alias("next_position"))


def appended(new: DataFrame, next_position: DataFrame) -> DataFrame:
    """New messages (conversation_id, seq, …) with contiguous positions; a conversation that does not exist keeps none of its messages."""
    rank = F.row_number().over(Window.partitionBy("conversation_id").orderBy("seq"))
    start = next_position.select(F.col("id").alias("conversation_id"), "next_position")
    return new.join(start, "conversation_id").withColumn("position", (F.col("next_position") + rank - 1).cast("int")).drop("next_position")


def recency(updated: Column, today: Column) -> Column:
    """today, yesterday, week or older, by calendar day."""
    days = F.datediff(today, F.to_date(updated))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, "week").otherwise("older")


def restored(messages: DataFrame) -> DataFrame:
    """Assistant messages as a reopened view shows them: a missing status means answered; the search is shown if it is not the question."""
    asked = F.when(F.col("role") == "user", F.col("content"))
    rows = last_before(messages, ["conversation_id"], "position", asked, "id", "question").filter("role = 'assistant'")
    search = F.col("payload.retrieval_query")
    return rows.select("id", "conversation_id", F.coalesce("payload.status", F.lit("answered")).alias("status"), F.when(~search.eqNullSafe(F.col("question")), search).alias("shown_search"))


def scorecard(messages: DataFrame) -> DataFrame:
    """(status, answers, with_citations, citations) over assistant messages."""
    cited = F.coalesce(F.size("payload.citations"), F.lit(0))
    cited = F.when(cited < 0, 0).otherwise(cited)
    rows = messages.filter("role = 'assistant'")
    return rows.groupBy(F.coalesce("payload.status", F.lit("none")).alias("status")).agg(F.count("*").alias("answers"), F.count_if(cited > 0).alias("with_citations"), F.sum(cited).alias("citations"))


def contract_errors(events: DataFrame, key: str) -> DataFrame:
    """(key, valid): whether events (key, seq, type) follow the protocol of an answer stream.

    conversation first, then status events, then claims, citations and completed; or one abstention or error that ends the stream.
    """
    w = Window.partitionBy(key).orderBy("seq")
    before = F.lag("type").over(w)
    allowed = (
        F.when(before.isNull(), F.col("type") == "conversation")
        .when(before == "conversation", F.col("type").isin("status", "abstention", "error"))
        .when(before == "status", F.col("type").isin("status", "claim", "abstention", "error"))
        .when(before == "claim", F.col("type").isin("claim", "citations", "abstention", "error"))
        .when(before == "citations", F.col("type").isin("completed", "error"))
        .otherwise(F.lit(False))
    )
    end = F.lead("type").over(w).isNull()
    closed = F.when(end, F.col("type").isin("completed", "abstention", "error")).otherwise(True)
    return events.withColumn("fine", F.coalesce(allowed, F.lit(False)) & closed).groupBy(key).agg(F.bool_and("fine").alias("valid"))
