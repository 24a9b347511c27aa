"""Exact cosine search over a stored table of vectors, packed by project and cluster.

Each vector is brought to length 1 and goes to the nearest of a few centres, which a bounded sample gives. Vectors of one project and centre lie together in
blocks of bounded size; a block keeps its centre and the distance of its farthest vector. For a query and a block the triangle inequality bounds every score in
it from above. A query first meets the blocks with the highest bounds, as many as hold k vectors; then those whose bound reaches the k-th best score found.
What meets is scored by one matrix product for a block and its queries, and only the best k of each query leave the task.

Scores are rounded to six places, ties go to the smaller chunk_id. A vector of no length scores 0. Vectors that are null, or hold null or non-finite components, and those of
another length than the query's, have no score and are not found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.functions import dot, norm
from foliate.sources import cut

#: Rows of the sample, centres for each length of vectors at most, vectors of a block at most and (about, where there are so many) at least, queries that meet a block at once.
SAMPLE_ROWS, CENTRES, BLOCK, LEAST, QUERIES = 2048, 256, 4096, 16, 4096
#: Scores are compared after rounding to six places; what a bound may be off by.
SLACK = 1e-6


def whole(vector):
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def centres_of(sample: np.ndarray, n: int, rounds: int = 3) -> np.ndarray:
    """Rows that lie far apart, then moved to the means of what is nearest to them."""
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    centres = sample[chosen].copy()
    for _ in range(rounds):
        near = nearest(sample, centres)
        for i in range(len(centres)):
            if (near == i).any():
                centres[i] = sample[near == i].mean(axis=0)
    return centres


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None] - 2 * v @ centres.T).argmin(axis=1)


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length, and their units."""
    sizes = column.value_lengths().to_numpy()
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield own, unit(column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), size))


def kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def clustered(vectors: DataFrame) -> DataFrame:
    """The written index of vectors(project_id, chunk_id, embedding): project_id, size, block, n, centre, radius, ids, units; a row for each block."""
    rows = cut(vectors.filter(whole(F.col("embedding"))).select("project_id", "chunk_id", "embedding"))
    total, sample, found = rows.count(), rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE_ROWS).collect(), {}
    for r in sample:
        found.setdefault(len(r.embedding), []).append(r.embedding)
    most = min(CENTRES, total // (LEAST * len({r.project_id for r in sample})) + 1 if sample else 1)
    centres = {size: centres_of(unit(np.array(v)), min(most, -(-len(v) // 8))) for size, v in found.items()}
    salts = -(-total // (64 * BLOCK))  # so that no group of one project and centre is larger than some blocks
    project, chunk = kind_of(rows, "project_id"), kind_of(rows, "chunk_id")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, blobs = np.zeros(len(batch), np.int32), [b""] * len(batch)
            for own, v in by_size(batch.column(2)):
                near[own] = nearest(v, centres.get(v.shape[1], np.zeros((1, v.shape[1]))))
                for i, x in zip(own.tolist(), v):
                    blobs[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(2).value_lengths(), pa.array(near), pa.array(blobs, pa.binary())], names=["project_id", "chunk_id", "size", "near", "unit"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            project, size, near = batch.column(0).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            fresh = [i for i in range(len(batch)) if i == 0 or project[i] != project[i - 1] or size[i] != size[i - 1] or near[i] != near[i - 1]]
            for begin, end in zip(fresh, [*fresh[1:], len(batch)]):
                for at in range(begin, end, BLOCK):
                    own = batch.slice(at, min(BLOCK, end - at))
                    v = np.frombuffer(b"".join(own.column(4).to_pylist())).reshape(len(own), -1)
                    centre = v.mean(axis=0)
                    radius = float(np.sqrt(((v - centre) ** 2).sum(axis=1)).max())
                    row = [own.column(0).slice(0, 1), pa.array([v.shape[1]], pa.int32()), pa.array([part + nth]), pa.array([len(own)]), pa.array([centre.tolist()]), pa.array([radius]), pa.array([own.column(1).to_pylist()], pa.list_(own.column(1).type)), pa.array([v.tobytes()])]
                    yield pa.RecordBatch.from_arrays(row, names=["project_id", "size", "block", "n", "centre", "radius", "ids", "units"])
                    nth += 1

    by = ["project_id", "size", "near"]
    dealt = rows.mapInArrow(assign, f"project_id {project}, chunk_id {chunk}, size int, near int, unit binary")
    dealt = dealt.repartition(*by, F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, salts)))).sortWithinPartitions(*by, "chunk_id")
    return cut(dealt.mapInArrow(pack, f"project_id {project}, size int, block long, n long, centre array<double>, radius double, ids array<{chunk}>, units binary"))


def bounded(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, query_vec, block, n, bound: each query of queries(query_id, project_id, query_vec) with the blocks of its project. No score in the block is larger."""
    asked = queries.filter(whole(F.col("query_vec"))).select("query_id", "project_id", F.transform("query_vec", lambda x: x.cast("double")).alias("query_vec"), F.size("query_vec").alias("size"))
    asked = asked.withColumn("length", norm(F.col("query_vec")))
    heads = index.select("project_id", "size", "block", "n", "centre", "radius", norm(F.col("centre")).alias("high"))
    product = F.when(F.col("length") > 0, dot(F.col("query_vec"), F.col("centre")) / F.col("length")).otherwise(F.lit(0.0))
    one = F.when(F.col("length") > 0, 1.0).otherwise(0.0)
    gap = F.sqrt(F.greatest(one + F.col("high") * F.col("high") - 2 * product, F.lit(0.0))) - F.col("radius")
    # by the distance, for vectors of length 1 at most, and by the product with the centre and what lies off it
    bound = F.least((1 + one - F.greatest(gap, F.lit(0.0)) * F.greatest(gap, F.lit(0.0))) / 2, product + one * F.col("radius")) + SLACK
    return asked.join(heads, ["project_id", "size"]).select("query_id", "query_vec", "block", "n", bound.alias("bound"))


def slices_of(queries: DataFrame) -> int:
    """Into so many slices the queries of a block are dealt, so that a task has a bounded number of them."""
    return max(1, -(-queries.count() // QUERIES))


def scored(index: DataFrame, pairs: DataFrame, k: int | None, slices: int = 1) -> DataFrame:
    """query_id, chunk_id, score of pairs(query_id, query_vec, block, floor): the best k of a query and block that reach its floor, all where k is None."""
    chunk, query = index.schema["ids"].dataType.elementType.simpleString(), kind_of(pairs, "query_id")
    asked = pairs.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([left.column("query_id").slice(0, 0), right.column("ids").combine_chunks().flatten().slice(0, 0), pa.array([], pa.float64())], names=["query_id", "chunk_id", "score"])
        ids = right.column("ids").combine_chunks().flatten()
        v = np.frombuffer(right.column("units")[0].as_py()).reshape(len(ids), -1)
        rank = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")  # the order of ids, which may be texts
        floor, who, what, values = left.column("floor").to_numpy(), [], [], []
        for at in range(0, left.num_rows, 256):
            q = unit(left.column("query_vec").slice(at, 256).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, v.shape[1]))
            for i, s in enumerate(np.round(q @ v.T, 6) + 0.0, at):
                some = np.flatnonzero(s >= floor[i])
                if k is not None and len(some) > k:
                    some = some[np.lexsort((rank[some], -s[some]))[:k]]
                who.append(np.full(len(some), i))
                what.append(some)
                values.append(s[some])
        who, what = pa.array(np.concatenate(who)), pa.array(np.concatenate(what))
        return pa.table([left.column("query_id").take(who), ids.take(what), pa.array(np.concatenate(values))], names=["query_id", "chunk_id", "score"])

    needed = asked.select(F.col("block").alias("of"), F.col("slice").alias("part")).distinct()
    blocks = index.select(F.col("block").alias("held"), "ids", "units").join(needed, F.col("held") == F.col("of")).drop("of")
    return asked.groupBy("block", "slice").cogroup(blocks.groupBy("held", "part")).applyInArrow(product, f"query_id {query}, chunk_id {chunk}, score double")


def first_blocks(pairs: DataFrame, k: int) -> DataFrame:
    """pairs with first: is the block among those with the highest bounds that together hold k vectors?"""
    w = W.partitionBy("query_id").orderBy(F.desc("bound"), "block").rowsBetween(W.unboundedPreceding, -1)
    return pairs.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)) < k)


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: the best k chunks of each query's project."""
    pairs, slices = cut(first_blocks(bounded(index, queries), k)), slices_of(queries)
    hits = scored(index, pairs.filter("first").withColumn("floor", F.lit(float("-inf"))), k, slices)
    if not pairs.filter("not first").isEmpty():
        found = cut(hits)
        hits = found.unionByName(scored(index, second(pairs, found, k), k, slices))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def second(pairs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The other pairs whose bound reaches the k-th best score that was found for the query."""
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))
    floors = found.withColumn("nth", nth).filter(F.col("nth") == k).select("query_id", F.col("score").alias("floor"))
    rest = pairs.filter("not first").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return rest.filter(F.col("bound") >= F.col("floor"))


def within(index: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """query_id, chunk_id, score of all that score `least` or more; blocks whose bound is below are not read."""
    pairs = bounded(index, queries).filter(F.col("bound") >= least).withColumn("floor", F.lit(float(least)))
    return scored(index, pairs, None, slices_of(queries))


def of_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(query_id, chunk_id, query_vec, embedding) with their scores, some thousand at a time."""
    query, chunk = kind_of(pairs, "query_id"), kind_of(pairs, "chunk_id")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(len(batch))
            for own, v in by_size(batch.column(3)):
                q = unit(batch.column(2).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(v.shape))
                score[own] = np.round(np.einsum("ij,ij->i", q, v), 6) + 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score)], names=["query_id", "chunk_id", "score"])

    sound = whole(F.col("query_vec")) & whole(F.col("embedding")) & (F.size("query_vec") == F.size("embedding"))
    return pairs.filter(sound).select("query_id", "chunk_id", "query_vec", "embedding").mapInArrow(product, f"query_id {query}, chunk_id {chunk}, score double")
