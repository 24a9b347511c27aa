"""Near-duplicates by min-max hashing: each hash function gives a document's smallest and its largest value.

A document's set: its distinct shingles of n words. 80 functions give 160 values, banded 5 by 5 in 32 bands. At a Jaccard
similarity of 0.8 a pair shares no band with a probability of 3e-6. Links are confirmed on the full sets.

Documents with equal sets are one class, known by a 128-bit hash of the set (of 64-bit hashes of its shingles), and only its representative goes
on, under a number of its own. In a bucket,
members are first compared with two pivots, the smallest and the largest number. If the others then lie in several components, those
outside the largest one are compared with the members of other components, in blocks of bounded size that give links, not pairs.

Edge cases: null, empty and blank texts have the empty set, are linked with nothing and kept. A text of fewer words than n has its
whole sequence as one shingle. Rows that share an id are classed by their own texts; `kept` goes by ids, so all rows with the id of their component
are kept, while `stays` holds for one row of each component. A null id is named only where a component has no other. Texts of any length are hashed
whole, in slices of about a megabyte. Extra columns are not read unless asked for. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import cut
from foliate.llm.components import components
from foliate.llm.wordhash import Words, mix, slices

FUNCTIONS, ROWS = 80, 5
BANDS = 2 * FUNCTIONS // ROWS
#: Shingles whose values are computed at once, for bounded memory.
BLOCK = 1 << 14
#: Members on a side of a block, and shingles in their sets (8 bytes each), at most about so many.
SIDE, SIDE_SHINGLES = 1024, 1 << 21


def sets(w: Words, n: int) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted."""
    grams = w.grams(n)
    short = mix(w.hashes ^ np.uint64(n))
    out = []
    for i, count in enumerate(w.counts):
        at = w.first[i]
        if count >= n:
            out.append(np.unique(grams[at : at + count - n + 1]))
        elif count:
            whole = np.uint64(count)
            for x in short[at : at + count]:
                whole = mix(np.array([whole ^ x], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:FUNCTIONS, None] | np.uint64(1), seeds[FUNCTIONS:, None]


def bands(found: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS bucket keys for each set that is not empty. The hash: high half of an odd multiple plus an offset."""
    times, plus = _functions()
    low = np.full((len(found), FUNCTIONS), np.iinfo(np.uint32).max, np.uint32)
    high = np.zeros((len(found), FUNCTIONS), np.uint32)
    at = 0
    while at < len(found):
        to, total = at, 0
        while to < len(found) and (to == at or total + len(found[to]) <= BLOCK):
            total += len(found[to])
            to += 1
        for part in range(0, max(total, 1), BLOCK) if to == at + 1 else (0,):
            own = [found[at][part : part + BLOCK]] if to == at + 1 else found[at:to]
            values = ((np.concatenate(own)[None, :] * times + plus) >> np.uint64(32)).astype(np.uint32)
            starts = np.cumsum([0, *map(len, own[:-1])])
            low[at:to] = np.minimum(low[at:to], np.minimum.reduceat(values, starts, axis=1).T)
            high[at:to] = np.maximum(high[at:to], np.maximum.reduceat(values, starts, axis=1).T)
        at = to
    both = np.stack([low, high], axis=2).reshape(len(found), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), both.shape[:2])
    for r in range(ROWS):
        key = mix((key * np.uint64(0x9E3779B97F4A7C15)) ^ both[:, :, r])
    return key.view(np.int64)


def _key(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def signatures(docs: DataFrame, n: int, *also: str) -> DataFrame:
    """doc_id, n_shingles, set_key (null for the empty set), bands, and the columns asked for."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for at, to in slices(text):
                found = sets(Words(text[at:to], fold=True), n)
                full = [x for x in found if len(x)]
                keys = bands(full) if full else np.zeros((0, BANDS), np.int64)
                offsets = np.cumsum([0, *[BANDS if len(x) else 0 for x in found]]).astype(np.int32)
                columns = [ids[at:to], pa.array([len(x) for x in found], pa.int64()), pa.array([_key(x) for x in found], pa.binary()), pa.ListArray.from_arrays(offsets, keys.ravel())]
                yield pa.RecordBatch.from_arrays([*columns, *[x[at:to] for x in batch.columns[2:]]], names=["doc_id", "n_shingles", "set_key", "bands", *also])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*also).schema) if also else ""
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>" + more)


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """set_key, shingles: the sorted sets as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(0)):
                found = sets(Words(batch.column(0)[at:to], fold=True), n)
                yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["set_key", "shingles"])

    return docs.select("text").mapInArrow(make, "set_key binary, shingles binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of two sorted sets: 100 * intersection >= percent * union."""
    if len(x) > len(y):
        x, y = y, x
    place = np.searchsorted(y, x)
    place[place == len(y)] = 0
    both = int(np.count_nonzero(y[place] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar: 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_of = [[np.frombuffer(x.as_py(), np.uint64) for x in batch.column(k)] for k in (2, 3)]
            keep = [similar(x, y, percent) for x, y in zip(*sets_of)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of_a = of.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    of_b = of.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def pairs_with_pivots(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows(key, doc_id, n): pairs a < b of each bucket's pivots with its other members; and the rows that are no pivots.

    The pivots are the smallest and the largest id, found by an aggregate. Sizes that rule a link out do so here.
    """
    ends = cut(rows.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("low"), F.max(F.struct("doc_id", "n")).alias("high")))
    met = rows.join(ends, "key").select("key", "doc_id", "n", F.col("low.doc_id").alias("x"), F.col("high.doc_id").alias("y"), F.col("low.n").alias("xn"), F.col("high.n").alias("yn"))
    near = lambda m: (F.lit(100) * F.least("n", m) >= F.lit(percent) * F.greatest("n", m))
    low = met.filter("doc_id <> x").filter(near("xn")).select(F.col("x").alias("a"), F.col("doc_id").alias("b"))
    high = met.filter("doc_id <> y and doc_id <> x").filter(near("yn")).select(F.col("doc_id").alias("a"), F.col("y").alias("b"))
    return low.unionByName(high).distinct(), met.filter("doc_id <> x and doc_id <> y").select("key", "doc_id", "n")


def open_buckets(rows: DataFrame) -> DataFrame:
    """rows(key, doc_id, n, comp) of buckets with two components or more, with odd (not in the bucket's largest component), and how many blocks all
    members (across) and the odd ones (down) make."""
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("total"))
    of_key = sizes.groupBy("key").agg(F.sum("many").alias("many"), F.sum("total").alias("total"), F.max(F.struct("many", "comp", "total")).alias("most"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    blocks = lambda many, total: F.ceil(F.greatest(many / SIDE, total / SIDE_SHINGLES)).cast("int")
    of_key = cut(of_key.select("key", F.col("most.comp").alias("major"), blocks(F.col("many"), F.col("total")).alias("across"), blocks(F.col("many") - F.col("most.many"), F.col("total") - F.col("most.total")).alias("down")))
    return rows.join(of_key, "key").select("key", "doc_id", "comp", "across", "down", (F.col("comp") != F.col("major")).alias("odd"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """Each bucket as a grid of blocks of bounded members and bytes: members are copied along one side of it, odd ones along the other, so a row for
    each pair is never made."""
    own = F.xxhash64("doc_id")
    member = rows.select("key", "doc_id", "comp", "odd", F.lit(False).alias("asks"), F.pmod(own, "across").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("j"))
    asking = rows.filter("odd").select("key", "doc_id", "comp", "odd", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("i"), F.pmod(own, "down").cast("int").alias("j"))
    return member.unionByName(asking)


def links_in_block(table: pa.Table, percent: int) -> pa.Table:
    """The links of odd members with members of other components; each pair is looked at in the first bucket that both share."""
    key = table.column("key")[0].as_py()
    ids, comp, odd, asks = (table.column(k).to_numpy() for k in ("doc_id", "comp", "odd", "asks"))
    held = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
    keys = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(ids), BANDS)
    sizes = np.array([len(x) for x in held])
    members, links = np.flatnonzero(~asks), []
    for q in np.flatnonzero(asks):
        fits = (comp[members] != comp[q]) & (100 * np.minimum(sizes[members], sizes[q]) >= percent * np.maximum(sizes[members], sizes[q]))
        fits &= ~odd[members] | (ids[members] > ids[q])
        near = members[fits]
        same = keys[near] == keys[q]
        near = near[keys[near, same.argmax(axis=1)] == key] if len(near) else near
        links += [(int(ids[q]), int(ids[m])) for m in near if similar(held[q], held[m], percent)]
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, *also: str) -> DataFrame:
    """Every row of docs(doc_id, text): doc_id, n_shingles, component_id, kept, class_id (smallest id with an equal set), stays, and the columns asked for."""
    signed = cut(signatures(docs, n, *also).withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = cut(signed.filter("set_key is not null").groupBy("set_key").agg(first).select("set_key", "first", F.col("first.row").alias("node")))
    rows = signed.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "bands").join(classes.select("node"), "node")
    rows = rows.select(F.explode("bands").alias("key"), F.col("node").alias("doc_id"), "n")  # from here on an id is the number of a class
    shared = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("key"))
    rows = cut(rows.join(shared, "key"))
    members = cut(rows.select(F.col("doc_id").alias("node")).distinct().join(classes, "node"))  # all that will be compared
    named = lambda c: F.coalesce(c, F.lit(-1))
    texts = docs.select(named(F.col("doc_id").cast("long")).alias("of"), "text").join(members.select(named(F.col("first.doc_id")).alias("of")).distinct(), "of", "left_semi")
    of = cut(shingle_sets(texts, n).join(members.select("set_key", F.col("node").alias("doc_id")), "set_key").select("doc_id", "shingles").dropDuplicates(["doc_id"]))
    pairs, rest = pairs_with_pivots(rows, percent)
    links = cut(confirmed(pairs, of, percent))
    known = components(links)
    rest = rest.join(known.select(F.col("u").alias("doc_id"), F.col("v").alias("comp")), "doc_id", "left")
    left = cut(open_buckets(cut(rest.select("key", "doc_id", "n", F.coalesce("comp", "doc_id").alias("comp")))))
    if not left.isEmpty():
        held = of.join(left.select("doc_id").distinct(), "doc_id").join(signed.select(F.col("row").alias("doc_id"), "bands"), "doc_id")
        blocks = in_blocks(left).join(cut(held), "doc_id").groupBy("key", "i", "j")
        more = blocks.applyInArrow(lambda t: links_in_block(t, percent), "a long, b long")
        known = components(cut(more.unionByName(known.select(F.col("u").alias("a"), F.col("v").alias("b")))))
    rooted = cut(classes.join(known.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("least")))
    named = cut(rooted.join(least, "root").select("set_key", F.col("first.doc_id").alias("class_id"), F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("stay")))
    out = signed.select("doc_id", "n_shingles", "set_key", "row", *also).join(named, "set_key", "left")
    alone = F.col("set_key").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("row") == F.col("stay"))).alias("stays"), *also)
