"""Vectors as integers: floor(256 x) of every component, with built-in functions. What the vector operators share.

Rows whose vector is null or empty, or holds null or non-finite components, are left out, and so are vectors of another length than most have (of lengths
equally common, the larger counts), which nothing can be compared with. A component beyond 2^24 in size, whose squares could leave 64 bits, ends the job
with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import cut

LARGEST = 1 << 24


def whole(vector: Column) -> Column:
    """Neither null nor empty nor with components that are null or not finite."""
    return (F.size(vector) > 0) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integer(x: Column) -> Column:
    scaled = F.floor(x.cast("double") * 256)
    return F.when(F.abs(scaled) <= LARGEST, scaled.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact sums")).cast("int"))


def quantised(embeddings: DataFrame, *kept: Column | str) -> tuple[DataFrame, int]:
    """A written table of the kept columns and v array<int>, and the length of all v. 0 where no row is left."""
    rows = cut(embeddings.filter(whole(F.col("embedding"))).select(*kept, F.transform("embedding", integer).alias("v")))
    length = rows.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return (rows.filter(F.size("v") == length.length), length.length) if length else (rows, 0)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A row for each vector."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
