"""Benchmark decontamination as a prefix-filtered set join. Built-in functions only.

A window is 10 consecutive words of an item; an item of fewer words is one window. Its set is its shingles of 5 words (fewer in a
shorter window). One pass over the documents finds where they have any of the benchmark's shingles, by hash. Full containment needs every
shingle, so a prefix of one suffices: the window's rarest shingle over all documents. A document is a candidate for a window only where it
has that one, at a place that leaves room for the window on both sides (positional and length bounds); then the words themselves are compared.

Edge cases: null and empty texts have no words and are never hit; items without words have no window. Items that repeat, or share
windows, each count; a null item_id hits words but is not counted as an item. Each row is judged by its own text, whatever other rows share its
id; rows alike in both come out alike. A word's row is only a hash and its place; with the benchmark's shingles found come the 20 words about each, or, where
the benchmark is too large to broadcast, each candidate document's text once, however long. Extra columns are
not read unless asked for. Empty tables give no hits, or no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import cut, fold_ascii, row_key

#: Fixed value: what separates words after folding.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
#: Rows up to which a side that comes from the benchmark is broadcast (of hashes: 16 MB, of windows of ten words: about 150 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(fold_ascii(text), SEPARATORS), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, w: the distinct windows of each item."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("at")
    return w.select("item_id", "w", starts).select("item_id", F.slice("w", F.col("at") + 1, size).alias("w")).distinct()


def _hash(w: str, at: Column, n: int) -> Column:
    """Of n words from a place: a built-in hash over single words stays in generated code."""
    return F.xxhash64(F.lit(n), *[F.get(w, at + i) for i in range(n)])


def _spread(frame: DataFrame, n: int, *keep: str) -> DataFrame:
    """at, many (words in all), hash of each shingle of n of the words w, besides the kept columns; w itself is there to be read from, and is not to be output."""
    spread = frame.select(*keep, "w", F.posexplode("w").alias("at", "word")).drop("word").filter(F.col("at") <= F.size("w") - n)
    return spread.select(*keep, "w", "at", F.size("w").alias("many"), _hash("w", F.col("at"), n).alias("hash"))


def _shingles(frame: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """at, many, hash of each shingle of the given sizes."""
    return reduce(DataFrame.unionByName, [_spread(frame, n, *keep).drop("w") for n in sizes])


def _sized(small: DataFrame) -> DataFrame:
    """Broadcast what has been counted and is small; Spark chooses the join for the rest."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """key (of the row), start, n, win: each occurrence of a window; and the windows: win, item_id."""
    own = windows(items, size)
    distinct = cut(own.select("w").distinct().select("w", F.monotonically_increasing_id().alias("win")))
    own = own.join(distinct, "w").select("win", "item_id")
    short = F.least(F.size("w"), F.lit(shingle))
    sizes = sorted(r.n for r in distinct.select(short.alias("n")).distinct().collect())  # at most `shingle` values
    if not sizes:
        return docs.select(F.lit(b"").alias("key"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("win")).filter("false"), own
    of_windows = cut(reduce(DataFrame.unionByName, [_shingles(distinct.filter(short == n), [n], "win") for n in sizes]).withColumnsRenamed({"at": "offset", "many": "n"}))
    known = cut(of_windows.select("hash").distinct())
    texts, small = docs.select(row_key().alias("key"), words(F.col("text")).alias("w")), known.count() <= BROADCAST_ROWS
    if small:
        # the words about each shingle found come along, as many as a window can reach; within one stage, so that a row for each word never holds them all
        back = F.greatest(F.col("at") - (size - 1), F.lit(0))
        found = [_spread(texts, n, "key").join(F.broadcast(known), "hash").select("key", "at", "many", "hash", back.alias("back"), F.slice("w", back + 1, 2 * size).alias("about")) for n in sizes]
        met = reduce(DataFrame.unionByName, found)
    else:
        met = _shingles(texts, sizes, "key").join(known, "hash").select("key", "at", "many", "hash")
    met = cut(met)
    counts = met.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    # the rarest shingle of each window; one that no document has makes the window impossible
    order = of_windows.join(known.join(counts, "hash", "left"), "hash").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = order.groupBy("win").agg(F.min(F.struct("df", "hash", "offset", "n")).alias("r")).filter("r.df > 0").select("win", "r.hash", "r.offset", "r.n")
    start = F.col("at") - F.col("offset")
    near = met.join(_sized(cut(prefix)), "hash").filter((start >= 0) & (start + F.col("n") <= F.col("many")))
    if small:
        placed = near.select("key", start.alias("start"), "n", "win", F.slice("about", start - F.col("back") + 1, F.col("n")).alias("has"))
    else:  # the texts of the candidates, by a shuffle at every size
        near = near.select("key", start.alias("start"), "n", "win").distinct().groupBy("key").agg(F.collect_list(F.struct("start", "n", "win")).alias("near"))  # within one document
        whole = docs.select(row_key().alias("key"), "text").join(cut(near).hint("merge"), "key").select("key", words(F.col("text")).alias("w"), "near")
        placed = whole.select("key", "w", F.explode("near").alias("x")).select("key", "x.start", "x.n", "x.win", F.slice("w", F.col("x.start") + 1, F.col("x.n")).alias("has"))
    same = placed.join(_sized(distinct), "win").filter(F.col("has") == F.col("w"))
    return same.select("key", "start", "n", "win").distinct(), own


def decontaminate(docs: DataFrame, items: DataFrame, *also: str) -> DataFrame:
    """Every row of docs(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the columns asked for."""
    found, own = hits(docs, items)
    found = cut(found)
    span = F.explode(F.sequence("start", F.col("start") + F.col("n") - 1))
    n_hit = found.select("key", "start", "n").distinct().select("key", span.alias("at")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    which = found.select("key", "win").distinct().join(own, "win").select("key", F.col("item_id").cast("string").alias("item")).filter("item is not null").distinct()
    which = which.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    base = docs.select("doc_id", row_key().alias("key"), F.greatest(F.coalesce(F.size(words(F.col("text"))), F.lit(0)), F.lit(0)).cast("long").alias("n_words"), *also)
    zero = F.lit(0).cast("long")
    joined = base.join(n_hit.join(which, "key", "left"), "key", "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"), *also)
