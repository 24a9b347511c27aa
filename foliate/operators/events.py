"""Event logs folded in batch: deliveries, life cycles, timelines, costs, request metrics. Their streaming twins are in streaming/."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cost of a million tokens in and out by model; statuses that a restart sweeps; the next stage by status.
RATES = {"openai/gpt-oss-120b": (0.59, 0.79), "llama-3.3-70b-versatile": (0.59, 0.79), "gpt-4o-mini": (0.15, 0.60), "claude-3-5-sonnet": (3.00, 15.00), "gemini-1.5-pro": (1.25, 5.00), "llama3": (0.0, 0.0)}
TRANSIENT = ["ocr_running", "chunking_running", "embedding_running", "extraction_running", "conflict_running", "clarification_running", "ready_for_validation"]
NEXT = {
    "uploaded": "parsing", "failed": "parsing", "ocr_running": "parsing", "ready_for_chunking": "chunking", "ocr_completed": "chunking", "chunking_running": "chunking",
    "chunking_completed": "embedding", "embedding_running": "embedding", "embedding_completed": "extraction", "extraction_running": "extraction", "extraction_completed": "conflict",
    "conflict_running": "conflict", "conflict_completed": "clarification", "clarification_running": "clarification", "clarification_completed": "completion", "ready_for_embedding": "none", "completed": "none",
}
MAX_RETRIES = 3


def delivery_status(log: DataFrame) -> DataFrame:
    """log(message_id, attempt_ts, event_id, ok) to message_id, status, retry_count: done at the first success, dead at the third error.

    Of a message only its first success and its first errors, as many as make it dead, are looked at; a null ok is an error, a null time comes first.
    """
    rows = log.select("message_id", F.coalesce("ok", F.lit(False)).alias("ok"), F.struct("attempt_ts", "event_id").alias("at"))
    done = rows.groupBy("message_id").agg(F.min(F.when(F.col("ok"), F.col("at"))).alias("done"))
    nth = F.row_number().over(W.partitionBy("message_id").orderBy("at"))
    errors = rows.filter(~F.col("ok")).withColumn("nth", nth).filter(F.col("nth") <= MAX_RETRIES).select("message_id", "at")
    before = done.join(errors, "message_id", "left").groupBy("message_id").agg(F.max(F.col("done").isNotNull()).alias("is_done"), F.count_if(F.col("at").isNotNull() & (F.col("done").isNull() | (F.col("at") < F.col("done")))).cast("int").alias("retry_count"))
    status = F.when(F.col("retry_count") >= MAX_RETRIES, "dead_letter").when(F.col("is_done"), "completed").otherwise("pending")
    return before.select("message_id", status.alias("status"), "retry_count")


def lifecycle(log: DataFrame) -> DataFrame:
    """log(document_id, ts, event_id, is_valid) with the status after each: every third failure in a row fails the document."""
    w = W.partitionBy("document_id").orderBy("ts", "event_id")
    rows = log.withColumn("run", F.sum(F.col("is_valid").cast("int")).over(w))
    nth = F.sum((~F.col("is_valid")).cast("int")).over(W.partitionBy("document_id", "run").orderBy("ts", "event_id"))
    rows = rows.withColumn("nth", nth)
    status = F.when(F.col("is_valid"), "ready_for_chat").when(F.col("nth") % MAX_RETRIES == 0, "failed").otherwise("ready_for_reindex")
    return rows.select("document_id", "event_id", status.alias("status"), F.when(F.col("is_valid"), 0).otherwise(F.col("nth") % MAX_RETRIES).cast("int").alias("retry_count"))


def swept(docs: DataFrame, before: Column | None = None) -> DataFrame:
    """Statuses after a restart: transient ones fail, if they are older than `before` where it is given."""
    stuck = F.col("status").isin(TRANSIENT) if before is None else F.col("status").isin(TRANSIENT) & (F.col("created_at") < before)
    return docs.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def timeline(events: DataFrame, field: str = "$.k") -> DataFrame:
    """Events by the document that their payload names, with their place, oldest first."""
    rows = events.withColumn("document_id", F.get_json_object("props", field).cast("bigint")).filter("document_id is not null")
    return rows.select("document_id", "event_id", "event_type", F.row_number().over(W.partitionBy("document_id").orderBy("ts", "event_id")).alias("place"))


def stage_seconds(events: DataFrame) -> DataFrame:
    """events(document_id, event_id, ts, stage): seconds since the document's event before."""
    w = W.partitionBy("document_id").orderBy("ts", "event_id")
    return events.select("document_id", "event_id", "stage", F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")).alias("seconds"))


def costed(usage: DataFrame) -> DataFrame:
    """usage(model, prompt_tokens, completion_tokens, ...) with cost; unknown models cost nothing."""
    rates = usage.sparkSession.createDataFrame([(m, *r) for m, r in RATES.items()], "model string, rate_in double, rate_out double")
    rows = usage.join(F.broadcast(rates), "model", "left")
    part = lambda n, r: F.col(n) / 1_000_000 * F.coalesce(r, F.lit(0.0))
    return rows.withColumn("cost", F.round(part("prompt_tokens", "rate_in") + part("completion_tokens", "rate_out"), 6)).drop("rate_in", "rate_out")


def ledger(usage: DataFrame) -> DataFrame:
    return costed(usage).groupBy("project_id", "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.count(F.lit(1)).alias("calls"))


def request_metrics(tokens: DataFrame) -> DataFrame:
    """tokens(request_id, ts) with the first row as the request: seconds to the first token, tokens, tokens a second."""
    w = W.partitionBy("request_id").orderBy("ts", "event_id")
    rows = tokens.withColumn("nth", F.row_number().over(w))
    got = rows.groupBy("request_id").agg(F.min("ts").alias("begin"), F.min(F.when(F.col("nth") > 1, F.col("ts"))).alias("first"), F.max("ts").alias("last"), (F.count(F.lit(1)) - 1).alias("n"))
    whole = F.timestamp_diff("SECOND", F.col("begin"), F.col("last"))
    return got.select("request_id", F.timestamp_diff("SECOND", F.col("begin"), F.col("first")).alias("first_token_seconds"), F.col("n").alias("n_tokens"), F.when(whole > 0, F.round(F.col("n") / whole, 6)).alias("tokens_per_second"))


def storage(docs: DataFrame, kilobytes: int = 128) -> DataFrame:
    return docs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_documents"), (F.count(F.lit(1)) * kilobytes).alias("kilobytes"))


def resume_plan(docs: DataFrame) -> DataFrame:
    """document_id, stage: where each document goes on; statuses that are not known are reported."""
    stages = docs.sparkSession.createDataFrame(list(NEXT.items()), "status string, stage string")
    return docs.join(F.broadcast(stages), "status", "left").select("document_id", "status", F.coalesce("stage", F.lit("unknown")).alias("stage"))
