"""What the corpus operators share: batches of documents, keys of rows, folded text, shards. The shared folder and cut lineages are the library's."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.sources import cut, shared_folder  # noqa: F401

BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(col))).first()[0] or 0


def row_key() -> Column:
    """128 bits of a document's id and text: what tells rows apart that share an id."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("\n"), F.coalesce("text", F.lit("")))))


def in_batches(docs: DataFrame, size: int, *cols: Column | str, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """Deal documents by a hash of doc_id (of the text, where that is null) into batches of about batch_bytes of text, a bounded unit of work for numpy.

    A small table has a batch for each shuffle partition, of a megabyte at least. The same rows get the same batch each time, so what
    was asked for a batch can be joined with its texts later.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, math.ceil(size / batch_bytes), min(tasks, math.ceil(size / min(batch_bytes, 1 << 20))))
    return docs.select(F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(n)).cast("int").alias("batch"), *cols), n


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() is quick and exact where the text is plain ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def by_shard(shard_of: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each shard that occurs, with the places where it does, in order."""
    order = np.argsort(shard_of, kind="stable")
    shards, first = np.unique(shard_of[order], return_index=True)
    return list(zip(shards.tolist(), np.split(order, first[1:]))) if len(order) else []


def table_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)
