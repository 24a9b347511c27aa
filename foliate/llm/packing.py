"""Packing by power-of-two decomposition: no sequence crosses documents, and none needs padding.

A document of n tokens is cut into as many full sequences as fit and into one piece for each bit of the rest, long ones
first. Each piece is a sequence of its own; equal lengths form a bucket, from which batches of one length are drawn.

Edge cases: a null text is empty and yields the end id alone, a piece of length 1. Repeated rows, and rows that share an id or have none, are packed each by itself.
Texts of any length stream through in Arrow batches. Extra columns are not read. No rows give no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.llm.common import cut
from foliate.llm.tokens import AT_ONCE, encoder
from foliate.llm.wordhash import slices

#: Bytes of text that are encoded at once, as in `records`: equal units are then looked up less often, and only a slice's pieces lie beside.
SLICE = 2 * AT_ONCE


def lengths(n: int, most: int) -> list[int]:
    """Powers of two that sum to n, none above most (itself a power of two)."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long"


def pieces(docs: DataFrame, vocabulary: str, most: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece; nth counts the pieces of a length within a task's part."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, end = TaskContext.get().partitionId(), {}, np.array([end_id], "<u4")
        encode = encoder(vocabulary)
        for batch in batches:
            for at, to in slices(batch.column(1), SLICE):
                ids, counts = encode.ids(batch.column(1)[at:to])
                rows, place = [], 0
                for key, count in zip(batch.column(0)[at:to].to_pylist(), counts.tolist()):
                    own = np.concatenate([ids[place : place + count], end]).tobytes()
                    place, n, start = place + count, count + 1, 0
                    for size in lengths(n, most):
                        nth = seen[size] = seen.get(size, -1) + 1
                        rows.append((part, key, start, size, zlib.crc32(own[4 * start : 4 * (start + size)]), n, nth))
                        start += size
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), *[pa.int64()] * 6])], names=["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"])

    return docs.select("doc_id", "text").mapInArrow(cut_up, PIECES)


def pack(docs: DataFrame, vocabulary: str, most: int = 1024, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (equal to the length), ordered by no one.

    sequence_id runs through the buckets without a gap. The pieces are written once, since their part numbers must stay as
    they are; then only a table of counts, one row for each part and length, is summed in order to place each part's pieces.
    """
    made = cut(pieces(docs, vocabulary, most, end_id))
    counts = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    within = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    sizes = made.groupBy("length").agg(F.count(F.lit(1)).alias("all"))  # a row for each power of two up to most
    before = F.coalesce(F.sum("all").over(W.orderBy("length").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = counts.withColumn("within", within).join(sizes.select("length", before.alias("before")), "length")
    return made.join(places, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("within") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"))
