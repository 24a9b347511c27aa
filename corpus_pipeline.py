"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Quality rejects by perplexity; exact and near duplicates leave one document of each group; documents that hold a benchmark window
go; what is left is packed. All stages but the last return the columns that they were given.

Each row is judged by itself: rows that share an id, or have a null one, go or stay by their own texts. Of equal or similar texts one row stays, so of
rows repeated whole one. Null and empty texts: quality has nothing against them, exact dedup keeps one of them all, the later stages keep it. Empty
tables give empty results; further columns are carried along, whatever their names (but _stage_row).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import decontaminate, exact_dedup, minhash, packing, quality
from foliate.llm.common import cut, table
from foliate.llm.queries import vocabulary

#: Shingles of five words and a similarity of 0.8 for near duplicates.
WORDS, PERCENT = 5, 80


ROW = "_stage_row"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with 128 bits of each row's id, language and text: rows may share an id, or have none. Rows alike in all three are judged alike."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return docs.withColumn(ROW, F.unhex(F.md5(F.concat_ws("\n", part("doc_id"), part("lang"), part("text")))))


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    return docs.join(rejected.select(ROW).distinct(), ROW, "left_anti").drop(ROW)


def one_of_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows that were kept; of rows alike, which share a key, one."""
    return docs.join(kept.select(ROW).distinct(), ROW, "left_semi").dropDuplicates([ROW]).drop(ROW)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    return without(rows, quality.classify(rows, quality.trusted_ids(table(spark, sf_dir, "labels")), ROW).filter("not kept"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    return one_of_each(rows, exact_dedup.exact_dedup(rows, ROW).filter("kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    return one_of_each(rows, minhash.near_duplicates(rows, WORDS, PERCENT, ROW).filter("stays"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    return without(rows, decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), ROW).filter("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: The first and the last stage are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
