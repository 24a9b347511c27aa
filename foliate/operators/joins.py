"""Joins that are not on equality: points in intervals, the last row before, texts within texts. None compares all pairs, and no key has to lie in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.sources import cut

#: Each level's bucket is made of 2^BITS of the level below; so many levels hold all whole numbers up to 2^60 in size.
BITS, LEVELS = 4, 16


def buckets(low: Column, high: Column) -> Column:
    """An array of (level, bucket) that tile the whole numbers from low to high: some dozens at most, however long the interval is.

    At each level the buckets that lie within the interval, but within no larger bucket that does.
    """
    begin = [-F.shiftright(-low, BITS * k) for k in range(LEVELS)]
    end = [F.shiftright(high + 1, BITS * k) for k in range(LEVELS)]  # exclusive
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    at = lambda k: lambda x: F.struct(F.lit(k).alias("level"), x.alias("bucket"))
    found = []
    for k in range(LEVELS):
        own = run(begin[k], end[k])
        if k + 1 < LEVELS:
            below = F.concat(run(begin[k], F.shiftleft(begin[k + 1], BITS)), run(F.shiftleft(end[k + 1], BITS), end[k]))
            own = F.when(begin[k + 1] < end[k + 1], below).otherwise(own)
        found.append(F.transform(own, at(k)))
    return F.when(low <= high, F.concat(*found))


def range_join(points: DataFrame, intervals: DataFrame, on: str, low: str, high: str, *by: str) -> DataFrame:
    """Each row of points with each row of intervals for which low <= on <= high (and the columns `by` are equal); whole numbers, nulls meet nothing.

    An interval is tiled by buckets of many sizes, a point lies in one bucket of each size that occurs. So a pair meets in exactly one bucket, and
    needs no other check. Both sides of the join are written tables, so that Spark can split a bucket that is hot.
    """
    tiles = cut(intervals.withColumn("_tile", F.explode(buckets(F.col(low).cast("bigint"), F.col(high).cast("bigint")))).withColumn("_level", F.col("_tile.level")).withColumn("_bucket", F.col("_tile.bucket")).drop("_tile"))
    levels = sorted(r["_level"] for r in tiles.select("_level").distinct().collect())  # LEVELS at most
    value = F.col(on).cast("bigint")
    places = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(value, BITS * k).alias("bucket")) for k in levels]) if levels else F.array().cast("array<struct<level:int,bucket:bigint>>")
    dealt = points.filter(F.col(on).isNotNull()).withColumn("_place", F.explode(places)).withColumn("_level", F.col("_place.level")).withColumn("_bucket", F.col("_place.bucket")).drop("_place")
    return cut(dealt).join(tiles, [*by, "_level", "_bucket"]).drop("_level", "_bucket")


def range_totals(points: DataFrame, intervals: DataFrame, on: str, low: str, high: str, n: str, **least: str) -> DataFrame:
    """Each row of intervals that has points with low <= on <= high, with their number (as column n) and the least value of a column of points for each of `least` (name=column).

    The pairs of `range_join` are not made, as intervals may hold many points each. Points are summed by value, these sums by buckets of the next size, and so on;
    an interval takes the sums of the buckets that tile it, and equal intervals are looked up once. So the work grows with the rows of both sides, not with the pairs.
    """
    ends = intervals.withColumn("_low", F.col(low).cast("bigint")).withColumn("_high", F.col(high).cast("bigint"))
    distinct = ends.select("_low", "_high").filter("_low <= _high").distinct()
    tiles = cut(distinct.withColumn("_tile", F.explode(buckets(F.col("_low"), F.col("_high")))).select("_low", "_high", F.col("_tile.level").alias("_level"), F.col("_tile.bucket").alias("_bucket")))
    levels = {r["_level"] for r in tiles.select("_level").distinct().collect()}  # LEVELS at most
    bucket = F.col(on).cast("bigint")
    sums = points.filter(bucket.isNotNull()).groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias(n), *[F.min(c).alias(name) for name, c in least.items()])
    met = []
    for k in range(max(levels, default=0) + 1):
        if k:
            sums = sums.groupBy(F.shiftright("_bucket", BITS).alias("_bucket")).agg(F.sum(n).alias(n), *[F.min(name).alias(name) for name in least])
        sums = cut(sums)
        if k in levels or not k:
            met.append(sums.withColumn("_level", F.lit(k)))
    found = tiles.join(reduce(DataFrame.unionByName, met), ["_level", "_bucket"])
    totals = found.groupBy("_low", "_high").agg(F.sum(n).alias(n), *[F.min(name).alias(name) for name in least])
    return ends.join(totals, ["_low", "_high"]).drop("_low", "_high")


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, tie: str) -> DataFrame:
    """Each row of left with found, the row of right of the same key that is the last at or before its time (of one time, that with the largest `tie`); null without one.

    Both lie in one order by key and time, dealt by ranges. Within a part the last row of right is carried on; across parts only the last one of each
    part's last key is, as each bound between parts splits one key at most. So a key may have any share of all rows. A null key or time meets nothing.
    """
    row = F.struct(*[F.col(c) for c in right.columns])
    theirs = right.filter(F.col(by).isNotNull() & F.col(on).isNotNull()).select(F.col(by).alias("_by"), F.col(on).alias("_on"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), row.alias("found"), F.lit(None).alias("own"))
    kind = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("own")).schema["own"].dataType
    theirs = theirs.withColumn("own", F.lit(None).cast(kind))
    ours = left.select(F.col(by).alias("_by"), F.col(on).alias("_on"), F.lit(1).alias("_side"), F.lit(None).cast(theirs.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(theirs.schema["found"].dataType).alias("found"), F.struct(*[F.col(c) for c in left.columns]).alias("own"))
    lost = ours.filter("_by is null or _on is null").select("own", "found")
    order = ["_by", "_on", "_side", "_tie"]
    dealt = cut(ours.filter("_by is not null and _on is not null").unionByName(theirs).repartitionByRange(*order, F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    w = W.partitionBy("_part", "_by").orderBy(*order[1:])
    carried = dealt.withColumn("found", F.last("found", True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = dealt.groupBy("_by", "_part").agg(F.max_by(F.when(F.col("_side") == 0, F.col("found")), F.when(F.col("_side") == 0, F.struct("_on", "_tie"))).alias("end"))
    before = F.last("end", True).over(W.partitionBy("_by").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    split = ends.withColumn("before", before).filter("before is not null").select("_by", "_part", "before")  # fewer rows than parts
    whole = carried.filter("_side = 1").join(F.broadcast(split), ["_by", "_part"], "left").select("own", F.coalesce("found", "before").alias("found"))
    return whole.unionByName(lost).select("own.*", "found")


def grams(text: Column, length: Column) -> Column:
    """Hashes of all runs of so many characters of a text, in order."""
    n = F.length(text) - length + 1
    each = lambda own: F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(own, i, length)))
    # the characters as a bound variable, as they would else be taken apart for each place
    return F.when(n > 0, F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), each)[0])


#: A key's needles and texts are compared as they are where that looks at no more than so many characters for each of its own.
DIRECT = 256


def containment_join(needles: DataFrame, texts: DataFrame, by: str, size: int = 12) -> DataFrame:
    """by, needle, text: the distinct pairs of needles(by, needle) and texts(by, text) of one key in which the text contains the needle.

    Keys of few or short needles and texts are compared pair by pair; what that looks at grows with their characters alone. Of the other keys (see `by_rarest_gram`) no pairs are made.
    Nulls meet nothing, and neither does an empty needle, which every text contains.
    """
    n = cut(needles.select(by, "needle").filter(F.col(by).isNotNull() & (F.length("needle") > 0)).distinct())
    t = texts.select(by, "text").filter(F.col(by).isNotNull() & (F.length("text") > 0)).join(n.select(by).distinct(), by, "left_semi").distinct()
    t = cut(t)
    own = n.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("needle").cast("double")).alias("n_chars"))
    theirs = t.groupBy(by).agg(F.count(F.lit(1)).alias("t"), F.sum(F.length("text").cast("double")).alias("t_chars"))
    direct = F.expr(f"n * t_chars + t * n_chars <= {DIRECT} * (n_chars + t_chars)")
    sizes = cut(own.join(theirs, by).select(by, direct.alias("direct")))
    few, many = sizes.filter("direct").select(by), sizes.filter("not direct").select(by)
    pairs = n.join(few, by, "left_semi").join(t, by).filter(F.col("text").contains(F.col("needle"))).select(by, "needle", "text")
    if many.isEmpty():
        return pairs
    return pairs.unionByName(by_rarest_gram(cut(n.join(many, by, "left_semi")), cut(t.join(many, by, "left_semi")), by, size))


def by_rarest_gram(needles: DataFrame, texts: DataFrame, by: str, size: int) -> DataFrame:
    """The pairs of distinct needles and texts, by runs of characters.

    Of each needle's runs of `size` characters (the whole needle, if it is shorter) the one that is rarest in its key's texts is joined with theirs; a needle with a run that
    no text has is done with. The places must leave room for the needle on both sides; then the texts are compared. Texts travel once, not with each
    of their runs, and runs of a length are made for keys with a needle of that length alone.
    """
    n = needles.withColumn("nid", F.xxhash64("needle")).withColumn("g", F.least(F.lit(size), F.length("needle")))
    t = texts.withColumn("tid", F.xxhash64("text"))
    mine = n.select(by, "nid", "g", F.length("needle").alias("n"), F.posexplode(grams(F.col("needle"), F.col("g"))).alias("off", "gram"))
    each = t.select(by, "tid", "text", F.length("text").alias("room")).join(n.select(by, "g").distinct(), by)
    theirs = each.select(by, "tid", "room", "g", F.posexplode(grams(F.col("text"), F.col("g"))).alias("at", "gram"))
    key = [by, "g", "gram"]
    counts = theirs.groupBy(*key).agg(F.count(F.lit(1)).alias("many"))
    rarest = mine.join(counts, key, "left").groupBy(by, "nid", "g", "n").agg(F.min(F.struct(F.coalesce("many", F.lit(0).cast("bigint")).alias("many"), "off", "gram")).alias("x"))
    chosen = cut(rarest.filter("x.many > 0").select(by, "nid", "g", "n", "x.off", "x.gram"))
    met = chosen.join(theirs, key).filter("at >= off and room - at >= n - off").select(by, "nid", "tid").distinct()
    pairs = met.join(n.select(by, "nid", "needle"), [by, "nid"]).join(t, [by, "tid"])
    return pairs.filter(F.col("text").contains(F.col("needle"))).select(by, "needle", "text")
