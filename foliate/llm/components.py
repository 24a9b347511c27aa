"""Connected components of a graph of links, by alternating large and small stars. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import cut


def _state(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return r.n, r.x


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of bigints in any direction, repeated or with itself: u, v, where v is the smallest node of u's component.

    Nodes that are the smallest of their component, or have no link, are left out. Each round hangs a node's larger neighbours on
    its smallest one, then its smaller ones; the number of rounds grows with the logarithm of the longest path. Each round's
    table is written out, so that a lost executor costs one round.
    """
    e = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").filter("u <> v").distinct())
        before, state = state, _state(e)
        if state == before:
            return e
