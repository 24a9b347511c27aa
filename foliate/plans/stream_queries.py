"""Streams drained over the given tables; their oracles are those of the batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate import streaming
from foliate.plans import fact_queries, view_queries
from foliate.plans.fixtures import Fixtures
from foliate.plans.fixtures_sql import sql

QUERIES, ORACLES = {}, {}


class Streamed(Fixtures):
    """The same inputs with some tables read as streams."""

    def __init__(self, spark: SparkSession, sf_dir: str, *streamed: str):
        super().__init__(spark, sf_dir)
        self.streamed = streamed

    def t(self, name: str) -> DataFrame:
        if name not in self.streamed:
            return super().t(name)
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        # a pattern, since a table may be one file, which a stream takes for a folder
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{self.sf_dir}/{name}.parque[t]")


def _old(facts: DataFrame) -> DataFrame:
    return facts.filter("not coalesce(created_at >= date'1998-01-01', false)")


def i01_stream_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, live = Fixtures(spark, sf_dir), Streamed(spark, sf_dir, "orders")
    return streaming.detect_conflicts(fact_queries.recent(live.fact()), _old(x.fact()), x.conflict())


#: What happens to the facts: each recent one comes, every 5th of them gets another value, every 7th goes; of the old ones every 13th gets another value, and every 17th of the others goes.
LOG = """filter(array(
    CASE WHEN recent THEN struct('insert' AS change, 1 AS version, object_text AS image) END,
    CASE WHEN again THEN struct('update_preimage' AS change, int(recent) AS version, object_text AS image) END,
    CASE WHEN again THEN struct('update_postimage' AS change, int(recent) + 1 AS version, '10 mg' AS image) END,
    CASE WHEN gone THEN struct('delete' AS change, int(recent) + int(again) AS version, if(again, '10 mg', object_text) AS image) END), x -> x IS NOT NULL)"""


def i01_stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, facts = Fixtures(spark, sf_dir), Streamed(spark, sf_dir, "orders").fact()
    recent = F.coalesce(F.expr("created_at >= date'1998-01-01'"), F.lit(False))
    told = facts.withColumn("recent", recent).withColumn("again", F.expr("fact_id % if(recent, 5, 13) = 0")).withColumn("gone", F.expr("if(recent, fact_id % 7 = 0, not again and fact_id % 17 = 0)"))
    log = told.withColumn("x", F.explode(F.expr(LOG))).withColumns({"change": F.col("x.change"), "version": F.col("x.version"), "object_text": F.col("x.image")})
    return streaming.watch_conflicts(log, _old(x.fact()), x.conflict())


CHANGED = f"""WITH told AS (SELECT *, coalesce(created_at >= DATE '1998-01-01', FALSE) AS recent, fact_id % CASE WHEN recent THEN 5 ELSE 13 END = 0 AS again, CASE WHEN recent THEN fact_id % 7 = 0 ELSE NOT again AND fact_id % 17 = 0 END AS gone FROM fact),
last AS (SELECT fact_id, project_id, subject_id, status, deleted_at, recent OR again AS counts, CASE WHEN again THEN '10 mg' ELSE object_text END AS object_text FROM told WHERE NOT gone)
SELECT DISTINCT least(n.fact_id, s.fact_id) AS first_fact_id, greatest(n.fact_id, s.fact_id) AS second_fact_id, {fact_queries._kind("n.object_text", "s.object_text")} AS kind FROM last n JOIN last s ON n.project_id = s.project_id AND n.subject_id = s.subject_id AND n.fact_id <> s.fact_id
WHERE n.counts AND s.deleted_at IS NULL AND s.status IN ('pending', 'verified', 'unverified', 'conflicted') AND NOT EXISTS (SELECT 1 FROM conflict c WHERE c.status = 'open' AND c.first_fact_id = least(n.fact_id, s.fact_id) AND c.second_fact_id = greatest(n.fact_id, s.fact_id))"""


def i02_stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.fold_deliveries(view_queries.delivery_log(Streamed(spark, sf_dir, "events")))


def i03_stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.fold_lifecycle(view_queries.validation_log(Streamed(spark, sf_dir, "events")))


def i04_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vectors of the table, some of which are spoilt: no numbers, cut short (which is no critical fault), or not there."""
    docs = Streamed(spark, sf_dir, "documents").t("documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    held = Fixtures(spark, sf_dir).t("embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    spoilt = F.when(F.col("document_id") % 10 == 3, F.transform("embedding", lambda x: x * F.lit("NaN").cast("float"))).when(F.col("document_id") % 10 == 7, F.slice("embedding", 2, 63)).otherwise(F.col("embedding"))
    return streaming.ingest(docs.join(held, "document_id", "left").withColumn("embedding", spoilt), "all-MiniLM-L6-v2", 64)


def i07_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.window_counts(Streamed(spark, sf_dir, "events").t("events").select("ts", "event_type"))


QUERIES |= {f.__name__: f for f in (i01_stream_conflicts, i01_stream_changes, i02_stream_deliveries, i03_stream_lifecycle, i04_stream_ingest, i07_stream_windows)}
ORACLES |= {"i01_stream_conflicts": fact_queries.ORACLES["f11_incremental"], "i01_stream_changes": sql("fact conflict", CHANGED), "i02_stream_deliveries": view_queries.ORACLES["i02_deliveries"], "i03_stream_lifecycle": view_queries.ORACLES["i03_lifecycle"], "i04_stream_ingest": "SELECT doc_id AS document_id, vec_id IS NOT NULL AND doc_id % 10 <> 3 AS is_valid FROM documents LEFT JOIN embeddings ON vec_id = doc_id", "i07_stream_windows": "SELECT date_trunc('day', ts) AS begin, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL"}
