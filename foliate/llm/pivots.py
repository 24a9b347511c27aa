"""Exact search for the largest inner products, by a table of distances to pivots.

A bounded sample gives pivots that lie far apart. Every vector's distances to all of them are computed once and kept. By the triangle inequality the largest
difference between a query's and a candidate's distance to a pivot bounds their distance from below; with both lengths that bounds the inner product
from above. Candidates are evaluated in the order of that bound until it falls below the k-th best score.

Vectors are dealt by ranges of (nearest pivot, distance to it, row) and packed into blocks, so a block holds near ones, and vectors that are all alike still
lie in many blocks. A block keeps the lowest and highest distance to each pivot. First each query is searched for in its own block, which gives it a score
to beat. Then queries, in groups, meet the blocks, in groups: pairs of groups that the bounds rule out are dropped before anything is moved. A cell, a
group of queries with a group of blocks, is bounded in both. Only the best of each cell go on.

Scores are exact: products in float64 where all sums stay below 2^53, else in 64-bit integers. Bounds are widened by what rounding can do.

Edge cases: rows without a whole vector, or of another length than most, take no part (see `integers`). A row is never its own candidate, but others of
its id are, with equal vectors too; ties go to the smaller vec_id, null last. Rows with a null id are candidates. A query with fewer candidates than k gets them all.
Repeated query rows are answered each. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.llm.common import cut
from foliate.llm.integers import LARGEST, matrix, quantised

#: Pivots, and the rows of the sample that they come from.
PIVOTS, SAMPLE_ROWS = 32, 1024
#: Vectors of a block; queries whose bounds are computed at a time.
BLOCK, QUERIES = 2048, 128
#: Vectors, and queries, of a cell.
CELL_ROWS, CELL_QUERIES = 1 << 15, 1 << 12
#: Candidates that are evaluated first; each further step takes twice as many.
STEP = 64
#: Distances are kept in float32: what a difference of two can be off by, as a share of their sum.
SLACK = 2.0**-22


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Each pivot is the row that is farthest from those before."""
    at, nearest, chosen = 0, np.full(len(sample), np.inf), []
    while len(chosen) < n and nearest[at] > 0:
        chosen.append(at)
        nearest = np.minimum(nearest, ((sample - sample[at]) ** 2).sum(axis=1))
        at = int(nearest.argmax())
    return sample[chosen]


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    v, p = v.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((v * v).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * v @ p.T, 0)).astype(np.float32)


@dataclass
class Block:
    """Vectors with their ids and distances to the pivots."""

    rows: np.ndarray
    ids: np.ndarray
    absent: np.ndarray  # where the id is null
    v: np.ndarray
    far: np.ndarray
    squares: np.ndarray = field(init=False)

    def __post_init__(self):
        self.squares = (self.v.astype(np.float64) ** 2).sum(axis=1)
        self.exact = np.float64 if self.v.shape[1] * float(np.abs(self.v).max(initial=0)) * LARGEST < 2**53 else np.int64
        self.wide = self.v.astype(self.exact)
        self.low, self.high = self.far.min(axis=0), self.far.max(axis=0)

    def take(self, which: np.ndarray) -> Block:
        return Block(self.rows[which], self.ids[which], self.absent[which], self.v[which], self.far[which])

    @staticmethod
    def joined(blocks: list[Block]) -> Block:
        return Block(*(np.concatenate([getattr(b, c) for b in blocks]) for c in ("rows", "ids", "absent", "v", "far")))


class Best:
    """The k best of each query so far, the best first: scores, ids, whether the id is null."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.found = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * n
        self.floor = np.full(n, -np.inf) if floor is None else floor.copy()

    def add(self, i: int, scores: np.ndarray, block: Block, which: np.ndarray) -> None:
        some = scores >= self.floor[i]
        if not some.any():
            return
        which = which[some]
        scores, ids, absent = (np.concatenate(x) for x in zip(self.found[i], (scores[some].astype(np.int64), block.ids[which], block.absent[which])))
        first = np.lexsort((ids, absent, -scores))[: self.k]
        self.found[i] = scores[first], ids[first], absent[first]
        if len(first) == self.k:
            least = float(scores[first[-1]])
            self.floor[i] = max(self.floor[i], least if abs(least) < 2**53 else least - abs(least) * 2**-50)


def search(queries: Block, block: Block, best: Best, some: np.ndarray | None = None) -> int:
    """Bring best up to date with a block's vectors, for some of the queries; a row is no candidate of its own. The number of products taken."""
    taken = 0
    outside = np.maximum(np.maximum(block.low - queries.far, queries.far - block.high), 0).max(axis=1)
    bound = bounds(queries.squares, block.squares.max(), outside, SLACK * (queries.far.max(initial=0) + block.far.max()))
    left = np.flatnonzero((bound >= best.floor) & (True if some is None else some))
    for at in range(0, len(left), QUERIES):
        own = left[at : at + QUERIES]
        apart = np.zeros((len(own), len(block.rows)), np.float32)
        for p in range(queries.far.shape[1]):
            np.maximum(apart, np.abs(queries.far[own, p, None] - block.far[None, :, p]), out=apart)
        highest = bounds(queries.squares[own, None], block.squares[None], apart, SLACK * (queries.far[own].max(axis=1)[:, None] + block.far.max(axis=1)[None]))
        for i, bound in zip(own.tolist(), highest):
            alive = np.flatnonzero((bound >= best.floor[i]) & (block.rows != queries.rows[i]))
            order, done, step = alive[np.argsort(-bound[alive], kind="stable")], 0, STEP
            while done < len(order) and bound[order[done]] >= best.floor[i]:
                which = order[done : done + step]
                best.add(i, block.wide[which] @ queries.wide[i].astype(block.exact), block, which)
                taken, done, step = taken + len(which), done + step, 2 * step
    return taken


def bounds(query, candidate, apart, slack):
    """No inner product is larger: of squared lengths, distances' lower bounds and what rounding may add."""
    apart = np.maximum(apart.astype(np.float64) - slack, 0)
    return (query + candidate - apart * apart) / 2 * (1 + 1e-12) + 1


BLOCKS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("asking", pa.int64()), ("square", pa.float64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), *((c, pa.binary()) for c in ("rows", "ids", "absent", "v", "far", "asks"))])
BLOCK_TYPE = "part long, block long, n long, asking long, square double, low array<double>, high array<double>, rows binary, ids binary, absent binary, v binary, far binary, asks binary"


def packed(rows: DataFrame, length: int, pivots: np.ndarray, parts: int) -> DataFrame:
    """rows(row, vec_id, v, asks) as a written table of blocks with their distances to the pivots."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(matrix(batch.column(2), length), pivots)
            near = far.argmin(axis=1)
            blobs = pa.array([x.tobytes() for x in far], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far[np.arange(len(far)), near].astype(np.float64)), blobs], names=["row", "vec_id", "v", "asks", "near", "gap", "far"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                own = batch.slice(at, BLOCK)
                far = np.frombuffer(b"".join(own.column(6).to_pylist()), np.float32).reshape(len(own), -1)
                v = matrix(own.column(2), length).astype(np.int32)
                asks = np.flatnonzero(own.column(3).to_numpy(zero_copy_only=False)).astype(np.int32)
                square, ids, absent = (v.astype(np.float64) ** 2).sum(axis=1).max(), own.column(1).fill_null(0).to_numpy(), own.column(1).is_null().to_numpy(zero_copy_only=False)
                blobs = [x.tobytes() for x in (own.column(0).to_numpy(), ids, absent, v, far, asks)]
                row = [part, part << 32 | nth, len(own), len(asks), float(square), far.min(axis=0).tolist(), far.max(axis=0).tolist(), *blobs]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCKS)], schema=BLOCKS)
                nth += 1

    table = rows.mapInArrow(measure, "row long, vec_id long, v array<int>, asks boolean, near int, gap double, far binary")
    return cut(table.repartitionByRange(parts, "near", "gap", "row").sortWithinPartitions("near", "gap", "row").mapInArrow(pack, BLOCK_TYPE))


def block_of(row: dict, length: int) -> Block:
    rows, ids = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids"))
    return Block(rows, ids, np.frombuffer(row["absent"], bool), np.frombuffer(row["v"], np.int32).reshape(-1, length), np.frombuffer(row["far"], np.float32).reshape(len(rows), -1))


def as_hits(queries: Block, best: Best) -> list[dict]:
    asked = [None if none else q for q, none in zip(queries.ids.tolist(), queries.absent.tolist())]
    return [{"row": r, "query_id": q, "vec_id": None if none else i, "score": s} for r, q, found in zip(queries.rows.tolist(), asked, best.found) for s, i, none in zip(*(x.tolist() for x in found))]


HIT = "array<struct<row:long,query_id:long,vec_id:long,score:long>>"
HIT_TYPE = pa.list_(pa.struct([(c, pa.int64()) for c in ("row", "query_id", "vec_id", "score")]))


def in_own_block(blocks: DataFrame, length: int, k: int) -> DataFrame:
    """The queries of each block with what they find in it: a written table of query blocks, with the least score to beat."""
    names = ["part", "block", "asking", "floor", "square", "low", "high", "rows", "ids", "absent", "v", "far", "floors", "hits"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = block_of(row, length)
                queries = block.take(np.frombuffer(row["asks"], np.int32))
                best = Best(len(queries.rows), k)
                search(queries, block, best)
                out = [row["part"], row["block"], len(queries.rows), float(best.floor.min()), float(queries.squares.max()), queries.low.astype(float).tolist(), queries.high.astype(float).tolist()]
                out += [x.tobytes() for x in (queries.rows, queries.ids, queries.absent, queries.v, queries.far, best.floor)]
                kinds = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.list_(pa.float64())] * 2 + [pa.binary()] * 6 + [HIT_TYPE]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*out, as_hits(queries, best)], kinds)], names=names)

    kind = "part long, block long, asking long, floor double, square double, low array<double>, high array<double>, rows binary, ids binary, absent binary, v binary, far binary, floors binary"
    return cut(blocks.filter("asking > 0").select("part", "block", "rows", "ids", "absent", "v", "far", "asks").mapInArrow(find, f"{kind}, hits {HIT}"))


def summary(blocks: DataFrame, group: str, pivots: int, *more: Column) -> DataFrame:
    """A row for each group: bounds of its distances to the pivots."""
    low, high = (F.array(*[f(F.col(c)[i]) for i in range(pivots)]) for f, c in ((F.min, "low"), (F.max, "high")))
    return blocks.groupBy(group).agg(low.alias("low"), high.alias("high"), F.max("square").alias("square"), *more)


def alive(queries: DataFrame, blocks: DataFrame, pivots: int, groups: int) -> DataFrame:
    """qg, cg: pairs of groups that the bounds do not rule out. Each group of queries is looked at with each group of blocks, by their summaries alone."""
    q = summary(queries, "qg", pivots, F.min("floor").alias("floor")).withColumn("cg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    c = summary(blocks, "cg", pivots).select("cg", *[F.col(x).alias(f"c_{x}") for x in ("low", "high", "square")])
    apart = F.array_max(F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("c_low", "c_high"), lambda x, y: F.greatest(x["low"] - y["c_high"], y["c_low"] - x["high"], F.lit(0.0))))
    slack = SLACK * (F.array_max("high") + F.array_max("c_high"))
    apart = F.greatest(apart - slack, F.lit(0.0))
    bound = (F.col("square") + F.col("c_square") - apart * apart) / 2 * (1 + 1e-12) + 1
    return q.join(c, "cg").filter(bound >= F.col("floor")).select("qg", "cg")


def in_cells(queries: DataFrame, blocks: DataFrame, pairs: DataFrame, length: int, k: int) -> DataFrame:
    """What groups of queries find in groups of blocks, but for each query's own block, which it has searched."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = left.to_pylist()
        queries = Block.joined([block_of(row, length) for row in asked])
        floors = [np.frombuffer(row["floors"]) for row in asked]
        home, best = np.repeat([row["block"] for row in asked], [len(x) for x in floors]), Best(len(queries.rows), k, np.concatenate(floors))
        for row in (x for batch in right.to_batches(max_chunksize=1) for x in batch.to_pylist()):
            search(queries, block_of(row, length), best, home != row["block"])
        hits = as_hits(queries, best)
        return pa.table([pa.array([h[c] for h in hits], pa.int64()) for c in ("row", "query_id", "vec_id", "score")], names=["row", "query_id", "vec_id", "score"])

    q = queries.select("qg", "block", "rows", "ids", "absent", "v", "far", "floors").join(pairs, "qg").groupBy("qg", "cg")
    c = blocks.select("cg", "block", "rows", "ids", "absent", "v", "far").join(pairs, "cg").groupBy("qg", "cg")
    return q.cogroup(c).applyInArrow(find, "row long, query_id long, vec_id long, score long")


def top_products(embeddings: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """Of embeddings(vec_id, embedding), for the rows for which `asks` holds: query_id, rank, vec_id, score."""
    spark = embeddings.sparkSession
    rows, length = quantised(embeddings, F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    if not length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("queries")).first()
    sample = rows.orderBy(F.xxhash64("row"), "row").select("v").limit(SAMPLE_ROWS).collect()
    pivots = far_apart(np.array([r.v for r in sample], np.int64), PIVOTS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-n.rows // CELL_ROWS), min(tasks, -(-n.rows // 256)))
    blocks = packed(rows.select("row", "vec_id", "v", "asks"), length, pivots, parts)
    made = blocks.agg(F.max("part")).first()[0] + 1
    per_cell = max(1, made // max(-(-n.rows // CELL_ROWS), min(made, tasks)))
    per_ask = max(1, made // max(1, -(-n.queries // CELL_QUERIES)))
    queries = in_own_block(blocks, length, k).withColumn("qg", F.expr(f"part div {per_ask}L"))
    blocks = blocks.withColumn("cg", F.expr(f"part div {per_cell}L"))
    pairs = cut(alive(queries, blocks, len(pivots), -(-made // per_cell)))
    hits = queries.select(F.explode("hits").alias("h")).select("h.*").unionByName(in_cells(queries, blocks, pairs, length, k))
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
