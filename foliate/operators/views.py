"""Listings and filters: documents, facts, members, conversations, workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statuses by class, stages by what a status contains, and how far each stage is.
RUNNING = ["uploaded", "parsing", "ready_for_chunking", "ready_for_embedding", "ready_for_validation", "ocr_running", "chunking_running", "embedding_running", "extraction_running", "conflict_running", "clarification_running"]
TERMINAL = ["ready_for_chat", "ready_for_reindex", "failed", "cancelled", "completed"]
READY = ["ready_for_chat", "completed"]
PROGRESS = {"uploaded": 5, "ocr": 20, "chunking": 40, "embedding": 60, "validation": 80, "ready_for_chat": 100}


def list_documents(docs: DataFrame, owner: int | None = None, project: str | None = None, text: str | None = None, since: str | None = None, until: str | None = None, sort: str = "created_at", descending: bool = True, skip: int = 0, limit: int = 20) -> DataFrame:
    """A page of documents with the count of all that match; dates that are none are not used. `limit` is the page's size."""
    rows = docs
    if owner is not None:
        rows = rows.filter(F.col("user_id") == owner)
    if project is not None:
        rows = rows.filter(F.col("project_id") == project)
    if text:
        rows = rows.filter(F.contains(F.lower("file_name"), F.lit(text.lower())))
    for day, keep in ((since, lambda d: F.col("created_at") >= d), (until, lambda d: F.col("created_at") <= d)):
        if day is not None:
            at = F.try_to_timestamp(F.lit(day))
            rows = rows.filter(at.isNull() | keep(at))
    order = F.desc(sort) if descending else F.asc(sort)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(order, "document_id").offset(skip).limit(limit).select("*", total.alias("total"))


def browse_facts(facts: DataFrame, entities: DataFrame, evidence: DataFrame, chunks: DataFrame, text: str, status: str | None = None, least: float = 0.0) -> DataFrame:
    """Facts whose subject, type, predicate, object or any evidence file contains the text, in any case."""
    files = evidence.join(chunks.select("chunk_id", F.lower("file_name").alias("file")), "chunk_id").groupBy("fact_id").agg(F.collect_set("file").alias("files"))
    rows = facts.join(entities.select(F.col("entity_id").alias("subject_id"), "name", "entity_type"), "subject_id", "left").join(files, "fact_id", "left")
    t = text.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(t), F.lit(False))
    met = has("name") | has("entity_type") | has("predicate") | has("object_text") | F.coalesce(F.exists("files", lambda f: f.contains(t)), F.lit(False))
    rows = rows.filter(met & (F.col("confidence") >= least))
    return rows.filter(F.col("status") == status) if status else rows


def match_count(text: Column, what: str) -> Column:
    return F.regexp_count(text, F.lit(r"(?i)\Q" + what + r"\E"))


def highlighted(text: Column, what: str) -> Column:
    return F.regexp_replace(text, r"(?i)(\Q" + what + r"\E)", "<mark>$1</mark>")


def status_class(status: Column) -> Column:
    s = F.lower(status)
    out = F.when(s == "cancelled", "cancelled").when(s == "failed", "failed").when(s.isin(READY), "ready").when(s.isin(TERMINAL), "terminal")
    return out.when(s.isin(RUNNING), "running").otherwise("unknown")


def progress(status: Column) -> Column:
    out = F.lit(0)
    for word, share in PROGRESS.items():
        out = F.when(F.lower(status).contains(word), share).otherwise(out)
    return out


def projects_of(members: DataFrame, user: int) -> DataFrame:
    return members.filter(F.col("user_id") == user).select("project_id", "role").distinct()


def roster(members: DataFrame, users: DataFrame, skip: int, limit: int) -> DataFrame:
    """A page of each project's members, with the number of its owners."""
    nth = F.row_number().over(W.partitionBy("project_id").orderBy("user_id"))
    owners = F.count_if(F.col("role") == "owner").over(W.partitionBy("project_id"))
    rows = members.join(users, "user_id").withColumn("nth", nth).withColumn("owners", owners)
    return rows.filter((F.col("nth") > skip) & (F.col("nth") <= skip + limit))


def list_conversations(conversations: DataFrame, archived: bool = False, title: str | None = None) -> DataFrame:
    rows = conversations.filter(F.upper("status").isin(["ACTIVE", "ARCHIVED"] if archived else ["ACTIVE"]))
    if title:
        rows = rows.filter(F.lower("title").contains(title.lower()))
    return rows.withColumn("position", F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("updated_at"), "conversation_id")))


def workspace(docs: DataFrame, conversations: DataFrame, messages: DataFrame, pages: DataFrame) -> DataFrame:
    """Of each document its latest active conversation, that one's messages in order, and its pages in order."""
    last = conversations.filter("status = 'ACTIVE'").groupBy("document_id").agg(F.max_by("conversation_id", F.struct("updated_at", "conversation_id")).alias("conversation_id"))
    said = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role"))).alias("m"))
    leaves = pages.groupBy("document_id").agg(F.array_sort(F.collect_list("page_number")).alias("pages"))
    rows = docs.select("document_id").join(last, "document_id", "left").join(said, "conversation_id", "left").join(leaves, "document_id", "left")
    return rows.select("document_id", "conversation_id", F.col("m.role").alias("roles"), "pages")


def with_result(docs: DataFrame, results: DataFrame) -> DataFrame:
    return docs.join(results, "document_id", "left")
