"""Conversations: messages(conversation_id, seq, role, content) paged, counted, summarised and copied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.functions import estimated_tokens, n_words, words


def page(messages: DataFrame, skip: int = 0, limit: int = 20, latest: bool = False) -> DataFrame:
    """The oldest messages of each conversation between bounds, or the latest."""
    nth = F.row_number().over(W.partitionBy("conversation_id").orderBy(F.desc("seq") if latest else F.asc("seq")))
    return messages.withColumn("nth", nth).filter((F.col("nth") > skip) & (F.col("nth") <= skip + limit)).drop("nth")


def token_usage(messages: DataFrame, budget: int = 4000) -> DataFrame:
    used = messages.groupBy("conversation_id").agg(F.sum(estimated_tokens(F.col("content"))).alias("tokens"), F.count(F.lit(1)).alias("n_messages"))
    return used.withColumn("remaining", F.greatest(F.lit(0), F.lit(budget) - F.col("tokens")))


def summaries(messages: DataFrame, limit: int = 1500, keep: int = 4) -> DataFrame:
    """conversation_id, summary of conversations of more words than the limit: the first words of all but the last messages."""
    w = W.partitionBy("conversation_id")
    rows = messages.withColumn("total", F.sum(n_words(F.col("content"))).over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("seq")))).filter((F.col("total") > limit) & (F.col("back") > keep))
    line = F.concat(F.initcap("role"), F.lit(": "), F.array_join(F.slice(words(F.col("content")), 1, 6), " "), F.lit("..."))
    got = rows.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("x"))
    return got.select("conversation_id", F.concat(F.lit("Earlier: "), F.array_join(F.col("x.line"), "; ")).alias("summary"))


def contexts(messages: DataFrame, limit: int = 1500, keep: int = 4) -> DataFrame:
    """One row per conversation: summary, last messages, tokens used and left."""
    last = page(messages, 0, keep, True).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("x"))
    rows = token_usage(messages).join(last, "conversation_id").join(summaries(messages, limit, keep), "conversation_id", "left")
    return rows.select("conversation_id", "summary", F.col("x.role").alias("roles"), F.col("x.content").alias("contents"), "n_messages", "tokens", "remaining")


def titles(messages: DataFrame) -> DataFrame:
    """The first six words of the first question."""
    first = messages.filter("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", "seq").alias("q"))
    ws = words(F.col("q"))
    return first.select("conversation_id", F.concat(F.array_join(F.slice(ws, 1, 6), " "), F.when(F.size(ws) > 6, "...").otherwise("")).alias("title"))


def copies(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages of ids(conversation_id, new_id) once more under their new ids."""
    return messages.join(ids, "conversation_id").select(F.col("new_id").alias("conversation_id"), "seq", "role", "content")
