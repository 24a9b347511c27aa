"""Exact deduplication by 128-bit content hash, with the bytes compared inside each group. Built-in functions only.

Edge cases: a null text counts as empty, so null, empty and blank texts are one group. Ties in length go to the smallest id, a null id
being the last; of rows that are alike in both, the one with the smallest hash of its text and the columns asked for is kept, and of rows alike in those one. So one row of a group is kept, however often an id
is repeated. Very long texts are hashed whole. Extra columns are not read unless asked for. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import cut

#: Fixed value: the characters that do not count when texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _keeper() -> Column:
    """The longest original, then the smallest id, then the row's hash, as one aggregate that combines on the map side."""
    return F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "row"))


def collided(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """md5 of the groups whose members do not all have the same bytes.

    Only texts of groups with two or more rows are moved. Both joins are plain shuffled joins on tables without a partitioning
    of their own, so that Spark can split a hash that a large part of all rows has.
    """
    texts = docs.select(normalised(F.col("text")).alias("norm")).withColumn("hash", content_hash(F.col("norm")))
    members = cut(texts.join(groups.filter("group_size > 1").select("hash"), "hash").select("hash", "norm"))
    first = cut(members.groupBy("hash").agg(F.min("norm").alias("least")))
    return cut(members.join(first, "hash").filter("norm <> least").select("hash")).distinct()


def exact_dedup(docs: DataFrame, *also: str) -> DataFrame:
    """Every row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, and the columns asked for.

    One pass makes a light table of hashes, which numbers the rows; grouping it needs no text. A join brings the texts of repeated hashes together
    for the comparison of bytes. Groups in which it finds a difference are made anew by the texts' SHA-256 and the texts themselves.
    """
    norm = normalised(F.col("text"))
    light = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), norm.alias("norm"), F.xxhash64("text", *also).alias("mark"), *also)
    light = cut(light.select("doc_id", "chars", content_hash(F.col("norm")).alias("hash"), F.sha2("norm", 256).alias("text_sha256"), "mark", F.monotonically_increasing_id().alias("row"), *also))
    made = light.groupBy("hash").agg(F.count(F.lit(1)).alias("group_size"), _keeper().alias("k"))
    groups = cut(made.select("hash", "group_size", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row")))
    bad = cut(collided(docs, groups))
    found = light.join(groups, "hash").select(*light.columns, "group_size", "keep_id", "keep_row")
    if not bad.isEmpty():
        found = found.join(bad, "hash", "left_anti").unionByName(remade(docs, light.join(bad, "hash", "left_semi"), bad))
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", *also)


def remade(docs: DataFrame, light: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of light whose MD5 collided, grouped by the texts themselves, which their MD5 and SHA-256 together lead to."""
    texts = docs.select(normalised(F.col("text")).alias("norm")).withColumn("hash", content_hash(F.col("norm")))
    texts = cut(texts.join(bad, "hash", "left_semi").withColumn("text_sha256", F.sha2("norm", 256)))
    same = ["hash", "text_sha256"]
    whole = cut(light).join(texts.select(*same, "norm").distinct(), same)
    made = whole.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), _keeper().alias("k"))
    made = cut(made.select("norm", "group_size", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row")))
    return cut(whole.join(made, "norm").drop("norm"))
