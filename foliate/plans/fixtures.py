"""Inputs of the registered queries: projections of the given tables into the shapes that the operators take.

Each has a twin in ``fixtures_sql`` with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ["uploaded", "ocr_running", "ready_for_chunking", "chunking_running", "ready_for_embedding", "ready_for_chat", "failed", "completed", "cancelled"]
OBJECTS = ["5 mg", "5 MG, daily", "5 mcg", "500mg", "1000mg", "10 mg", "2019", "dose 5 in 2019", "dose 5 in 2021", "unknown", "", "café noir"]


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.unique = spark, sf_dir, None

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def one_row_each(self) -> bool:
        """Does each doc_id have one row? Then lines need no join to meet their document."""
        if self.unique is None:
            self.unique = self.t("documents").groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty()
        return self.unique

    def document(self, *further: str) -> DataFrame:
        ext, status = F.array(*map(F.lit, ["pdf", "png", "docx", "txt", "csv", "bin"])), F.array(*map(F.lit, STATUSES))
        created = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id as int))")
        return self.t("documents").select(
            F.col("doc_id").alias("document_id"), F.col("source").alias("project_id"), (F.col("doc_id") % 7).alias("user_id"),
            F.concat(F.lit("doc_"), "doc_id", F.lit("."), F.get(ext, F.col("doc_id") % 6)).alias("file_name"),
            F.get(status, F.col("doc_id") % 9).alias("status"), created.alias("created_at"),
            F.when(F.col("doc_id") % 17 == 0, created + F.expr("interval 1 day")).alias("deleted_at"), *further,
        )

    def line(self) -> DataFrame:
        return self.lines_of(self.t("documents").select(F.col("doc_id").alias("document_id"), "text"))

    def lines_of(self, rows: DataFrame) -> DataFrame:
        """document_id, p, page_number, line and the other columns of rows(document_id, text, ...)."""
        others = [c for c in rows.columns if c not in ("document_id", "text")]
        each = rows.select("document_id", *others, F.posexplode(F.split("text", "\n")).alias("p", "raw"))
        return each.select("document_id", F.col("p").cast("int"), (F.floor(F.col("p") / 20) + 1).cast("int").alias("page_number"), F.btrim("raw", F.lit(" \t\r")).alias("line"), *others)

    def marked_text(self) -> DataFrame:
        prefix = F.expr("CASE WHEN p % 11 = 0 THEN '# ' WHEN p % 11 = 4 THEN '## ' WHEN p % 11 = 7 THEN '### ' WHEN p % 5 = 3 THEN '- ' ELSE '' END")
        made = F.concat(prefix, "line", F.when(F.col("p") % 6 == 5, "\n").otherwise(""))
        # dealt by document alone, so that pages need no other shuffle to meet what is known of their document
        return self.line().repartition("document_id").groupBy("document_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", made.alias("s")))), lambda x: x["s"]), "\n").alias("raw_text"))

    def element(self) -> DataFrame:
        kind = F.expr("CASE WHEN p % 11 IN (0, 4, 7) THEN 'heading' WHEN p % 5 = 3 THEN 'bullet_list' WHEN p % 13 = 6 THEN 'table' WHEN p % 13 = 9 THEN 'image' WHEN p % 13 = 10 THEN 'caption' ELSE 'paragraph' END")
        level = F.expr("CASE WHEN p % 11 = 0 THEN 1 WHEN p % 11 = 4 THEN 2 WHEN p % 11 = 7 THEN 3 ELSE 4 END")
        p = F.col("p").cast("double")
        return self.line().filter("line <> ''").select(
            "document_id", F.concat_ws("_", "document_id", "p").alias("block_id"), F.lit(None).cast("string").alias("parent_block_id"), "page_number",
            kind.alias("element_type"), F.col("line").alias("content"), F.col("p").alias("reading_order"), level.alias("level"),
            F.array(p, p * 2, p + 50, p * 2 + 10).alias("bounding_box"),
        )

    def chunk(self) -> DataFrame:
        own = ["document_id", "project_id", "file_name", "deleted_at"]
        if self.one_row_each():
            rows = self.lines_of(self.document("text").select(*own, "text").filter("document_id is not null")).filter("line <> ''")
        else:
            rows = self.line().filter("line <> ''").join(self.document().select(*own), "document_id")
        return rows.select((F.col("document_id") * 1000 + F.col("p")).alias("chunk_id"), "document_id", "project_id", "file_name", "deleted_at", "page_number", F.col("p").alias("chunk_index"), F.col("line").alias("content"))

    def embedding(self) -> DataFrame:
        first = self.line().filter("line <> ''").groupBy("document_id").agg(F.min("p").alias("p"))
        rows = self.t("embeddings").join(first, F.col("vec_id") == F.col("document_id"))
        return rows.select((F.col("document_id") * 1000 + F.col("p")).alias("chunk_id"), "embedding", F.concat(F.lit("m"), F.col("vec_id") % 2).alias("model_name"))

    def query(self) -> DataFrame:
        words = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, 6)
        items = self.t("benchmark").select("item_id", F.concat(F.array_join(words, " "), F.lit("?")).alias("query_text"))
        vectors = self.t("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vec"))
        return items.join(vectors, "item_id").select("item_id", "query_text", "query_vec", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("s")).select((F.col("item_id") * 5 + F.col("s")).alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") * 5 + F.col("s")) % 20).alias("project_id"), "query_text", "query_vec")

    def entity(self) -> DataFrame:
        return self.t("part").selectExpr(
            "p_partkey AS entity_id", "p_partkey % 3 AS project_id",
            "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN concat('  ', p_name) ELSE concat(p_name, ' ') END AS name",
            "CASE WHEN p_partkey % 97 = 0 THEN 'unknown' WHEN p_partkey % 89 = 0 THEN NULL ELSE p_type END AS entity_type",
            "CASE WHEN p_partkey % 2 = 1 THEN concat(p_brand, ' ', p_size) END AS description",
            "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(p_partkey * 7 % 1000 as int)) AS created_at",
        )

    def fact(self) -> DataFrame:
        objects = F.get(F.array(*map(F.lit, OBJECTS)), F.col("o_orderkey") % 12)
        return self.t("orders").select(
            F.col("o_orderkey").alias("fact_id"), (F.col("o_custkey") % 3).alias("project_id"), F.col("o_custkey").alias("subject_id"),
            F.expr("CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN lower(o_orderstatus) ELSE concat(' ', o_orderstatus) END").alias("predicate"),
            objects.alias("object_text"), (F.lit(0.50) + (F.col("o_orderkey") % 50) / 100).cast("double").alias("confidence"),
            F.get(F.array(*map(F.lit, ["unverified", "verified", "pending", "conflicted", "rejected"])), F.col("o_orderkey") % 5).alias("status"),
            F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 23 == 0, F.col("o_orderdate")).alias("deleted_at"),
        )

    def evidence(self) -> DataFrame:
        first = self.chunk().groupBy("document_id").agg(F.min("chunk_id").alias("chunk_id"), F.max("chunk_id").alias("last_id"))
        ids = self.fact().select("fact_id", F.pmod("fact_id", F.lit(self.t("documents").count())).alias("document_id")).join(first, "document_id")
        second = F.when(F.col("fact_id") % 7 == 0, F.array("chunk_id", "last_id")).otherwise(F.array("chunk_id"))
        return ids.select("fact_id", F.explode(F.array_distinct(second)).alias("chunk_id")).withColumn("verbatim", F.concat(F.lit("v"), "fact_id"))

    def conflict(self) -> DataFrame:
        pairs = self.fact().filter("deleted_at is null").groupBy("subject_id").agg(F.slice(F.array_sort(F.collect_list("fact_id")), 1, 2).alias("x")).filter("size(x) = 2")
        return pairs.selectExpr("subject_id AS conflict_id", "subject_id % 3 AS project_id", "x[0] AS first_fact_id", "x[1] AS second_fact_id", "CASE subject_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'active' WHEN 2 THEN 'ignored' ELSE 'resolved' END AS status")

    def decision(self) -> DataFrame:
        return self.conflict().selectExpr("conflict_id", "CASE conflict_id % 3 WHEN 0 THEN 'resolve' WHEN 1 THEN 'ignore' ELSE 'merge' END AS action", "CASE WHEN conflict_id % 5 = 0 THEN -1 WHEN conflict_id % 2 = 0 THEN first_fact_id ELSE second_fact_id END AS winner_id", "concat('merged ', conflict_id) AS merged_text")

    def question(self) -> DataFrame:
        return self.fact().filter("fact_id % 4 = 1").selectExpr("fact_id + 100000 AS question_id", "project_id", "fact_id", "CASE fact_id % 8 WHEN 1 THEN 'low_confidence' ELSE 'missing_value' END AS trigger_type", "CASE fact_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'answered' ELSE 'dismissed' END AS status", "CASE WHEN fact_id % 5 = 0 THEN concat('q', fact_id) ELSE to_json(named_struct('question', concat('q', fact_id), 'priority', 'high')) END AS question")

    def review_log(self) -> DataFrame:
        return self.t("events").selectExpr("event_id", "event_id % 3000 AS fact_id", "CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'modify' WHEN 'view' THEN 'undo' ELSE 'other' END AS action", "ts AS created_at", "concat('new', event_id) AS new_object")

    def grid(self) -> DataFrame:
        rows = self.t("part").selectExpr("floor(p_partkey / 45) AS sheet_id", "p_partkey % 45 AS k", "array(p_name, p_brand, cast(p_size as string), cast(p_retailprice as string)) AS cells")
        empty, lead = F.array(*[F.lit("")] * 4), F.when(F.col("sheet_id") % 2 == 0, 1).otherwise(0)
        body = rows.select("sheet_id", (F.col("k") + 2 + lead + F.when(F.col("k") >= 20, 1).otherwise(0)).alias("rn"), "cells")
        one = rows.select("sheet_id").distinct()
        head = one.select("sheet_id", (lead + 1).cast("bigint").alias("rn"), F.array(*map(F.lit, ["name", "brand", "size", "price"])).alias("cells"))
        gaps = one.select("sheet_id", F.explode(F.when(F.col("sheet_id") % 2 == 0, F.expr("array(1L, 23L)")).otherwise(F.expr("array(22L, 48L, 49L, 50L)"))).alias("rn"), empty.alias("cells"))
        return body.unionByName(head).unionByName(gaps)

    def message(self) -> DataFrame:
        return self.t("conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))

    def usage(self) -> DataFrame:
        models = ["openai/gpt-oss-120b", "llama-3.3-70b-versatile", "gpt-4o-mini", "claude-3-5-sonnet", "gemini-1.5-pro", "llama3", "other"]
        return self.t("events").select("event_id", (F.col("user_id") % 5).alias("project_id"), F.get(F.array(*map(F.lit, models)), F.col("event_id") % 7).alias("model"), (F.get_json_object("props", "$.k").cast("bigint") * 100).alias("prompt_tokens"), F.floor(F.col("value") * 10).alias("completion_tokens"))


def by(*cols: str):
    return W.partitionBy(*cols)
