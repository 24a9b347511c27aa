"""Data-quality rules over all documents in one job: issues(document_id, code, severity, item)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.functions import n_words
from foliate.sources import cut


def issue(rows: DataFrame, code: str, severity: str, item: Column | str) -> DataFrame:
    item = F.col(item) if isinstance(item, str) else item
    return rows.select("document_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), item.cast("string").alias("item"))


def document_issues(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted(document_id): those that are not there, failed ones, and ones without a name or type."""
    rows = docs.join(wanted, "document_id", "left_semi")
    gone = wanted.join(docs.select("document_id"), "document_id", "left_anti")
    return issue(gone, "DOC_NOT_FOUND", "critical", "document_id").unionByName(issue(rows.filter("status = 'failed'"), "DOC_STATUS_FAILED", "critical", "status")).unionByName(issue(rows.filter("file_name is null or file_name = '' or file_type is null"), "DOC_METADATA_MISSING", "minor", "document_id"))


def page_issues(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """No pages; the n-th page not being number n, so one gap marks all later pages; numbers that repeat."""
    nth = F.row_number().over(W.partitionBy("document_id").orderBy("page_number"))
    again = F.row_number().over(W.partitionBy("document_id", "page_number").orderBy(F.lit(1)))
    none = docs.select("document_id").join(pages.select("document_id").distinct(), "document_id", "left_anti")
    gaps = pages.withColumn("nth", nth).filter("nth <> page_number")
    repeats = pages.withColumn("again", again).filter("again > 1")
    return issue(none, "NO_PAGES_FOUND", "critical", "document_id").unionByName(issue(gaps, "PAGE_NUMBER_GAP", "major", "nth")).unionByName(issue(repeats, "DUPLICATE_PAGE_NUMBER", "major", "page_number"))


def element_issues(elements: DataFrame) -> DataFrame:
    b = F.col("bounding_box")
    four = F.size(b) == 4
    parent = elements.select("document_id", F.col("block_id").alias("parent_block_id")).distinct()
    orphans = elements.filter("parent_block_id is not null").join(parent, ["document_id", "parent_block_id"], "left_anti")
    found = [
        issue(elements.filter("reading_order < 0"), "INVALID_READING_ORDER", "minor", "block_id"),
        issue(elements.filter(b.isNotNull() & ~four), "INVALID_BBOX_FORMAT", "minor", "block_id"),
        issue(elements.filter(four & ((b[0] > b[2]) | (b[1] > b[3]))), "INCONSISTENT_BBOX_BOUNDS", "minor", "block_id"),
        issue(orphans, "ORPHAN_ELEMENT_PARENT", "major", "block_id"),
        issue(cyclic(elements), "CYCLIC_ELEMENT_REFERENCE", "major", "block_id"),
        issue(elements.filter("element_type = 'heading' and trim(coalesce(content, '')) = ''"), "EMPTY_HEADING_ELEMENT", "warning", "block_id"),
    ]
    return reduce(DataFrame.unionByName, found)


def cyclic(elements: DataFrame) -> DataFrame:
    """Elements whose chain of parents never ends. Each round looks twice as far up; a chain of any length that ends has left when a round loses none.

    An element with several parents goes by the smallest. Each round's table is written out, and only elements that still have an ancestor are in it.
    """
    up = elements.filter("parent_block_id is not null").groupBy("document_id", "block_id").agg(F.min("parent_block_id").alias("at"))
    before = None
    while True:
        up = cut(up)
        left = up.count()
        if left in (0, before):
            return up.select("document_id", "block_id")
        before = left
        up = up.join(up.select("document_id", F.col("block_id").alias("at"), F.col("at").alias("next")), ["document_id", "at"]).select("document_id", "block_id", F.col("next").alias("at"))


def chunk_issues(chunks: DataFrame) -> DataFrame:
    """Empty chunks; texts that repeat within a document, after the first; indices out of order."""
    text = F.trim("content")
    again = F.row_number().over(W.partitionBy("document_id", F.sha2(text, 256)).orderBy("chunk_index"))
    nth = F.row_number().over(W.partitionBy("document_id").orderBy("chunk_index")) - 1
    repeats = chunks.filter(text != "").withColumn("again", again).filter("again > 1")
    return issue(chunks.filter(text == ""), "EMPTY_CHUNK", "major", "chunk_id").unionByName(issue(repeats, "DUPLICATE_CHUNK_CONTENT", "warning", "chunk_id")).unionByName(issue(chunks.withColumn("nth", nth).filter("nth <> chunk_index"), "INVALID_CHUNK_ORDERING", "minor", "chunk_id"))


def embedding_issues(embeddings: DataFrame, dimension: int = 768) -> DataFrame:
    """embeddings(document_id, chunk_id, embedding). An empty vector is looked at no further."""
    v = F.col("embedding")
    some = embeddings.filter(F.size(v) > 0)
    odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    found = [
        issue(embeddings.filter(v.isNull() | (F.size(v) <= 0)), "EMPTY_EMBEDDING_VECTOR", "critical", "chunk_id"),
        issue(some.filter(odd), "EMBEDDING_NAN_DETECTION", "critical", "chunk_id"),
        issue(some.filter(F.forall(v, lambda x: x == 0)), "ZERO_EMBEDDING_VECTOR", "major", "chunk_id"),
        issue(some.filter(F.size(v) != dimension), "INVALID_EMBEDDING_DIMENSION", "major", "chunk_id"),
    ]
    return reduce(DataFrame.unionByName, found)


def statistics(docs: DataFrame, pages: DataFrame, elements: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Counts by document, each table being grouped before it is joined, and the two coverages."""
    count = lambda df, name: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    text = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(n_words(F.col("content"))).alias("words"))
    parts = (count(pages, "pages"), count(elements, "elements"), text, count(embeddings, "embeddings"))
    rows = reduce(lambda a, b: a.join(b, "document_id", "left"), parts, docs.select("document_id")).na.fill(0)
    chunked = F.when(F.col("elements") > 0, F.least(F.lit(1.0), F.col("chunks") / (F.col("elements") * 0.5))).otherwise(0.0)
    embedded = F.when(F.col("chunks") > 0, F.col("embeddings") / F.col("chunks")).otherwise(0.0)
    return rows.withColumn("chunk_coverage", F.round(chunked, 6)).withColumn("embedding_coverage", F.round(embedded, 6))


def verdicts(docs: DataFrame, issues: DataFrame) -> DataFrame:
    bad = issues.groupBy("document_id").agg(F.bool_or(F.col("severity") == "critical").alias("critical"), F.count(F.lit(1)).alias("n_issues"))
    return docs.select("document_id").join(bad, "document_id", "left").select("document_id", F.coalesce("n_issues", F.lit(0).cast("bigint")).alias("n_issues"), (~F.coalesce("critical", F.lit(False))).alias("is_valid"))


def reports(docs: DataFrame, issues: DataFrame, stats: DataFrame) -> DataFrame:
    """document_id, warnings, critical_errors (codes, sorted), summary."""
    got = issues.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("severity").isin("warning", "minor"), F.col("code")))).alias("warnings"),
        F.array_sort(F.collect_list(F.when(F.col("severity").isin("critical", "major"), F.col("code")))).alias("critical_errors"),
    )
    none = F.array().cast("array<string>")
    rows = docs.select("document_id").join(got, "document_id", "left").join(stats, "document_id", "left")
    rows = rows.withColumn("warnings", F.coalesce("warnings", none)).withColumn("critical_errors", F.coalesce("critical_errors", none))
    text = F.format_string("%d pages, %d chunks, %d warnings, %d errors", "pages", "chunks", F.size("warnings"), F.size("critical_errors"))
    return rows.select("document_id", "warnings", "critical_errors", text.alias("summary"))


def fingerprints(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    own = docs.select("document_id", F.sha2(F.concat_ws("_", "file_name", "project_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")), 256).alias("fingerprint"))
    parts = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.sha2("content", 256).alias("h")))).alias("x"))
    return own.join(parts, "document_id", "left").select("document_id", "fingerprint", F.col("x.h").alias("chunks"))


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Values of a key that more than one row has."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
