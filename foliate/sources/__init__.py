"""Sources and sinks: corpora of files, delimited sheets, document exports, idempotent stage outputs, tables that cut a lineage."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: File types by extension, what may be uploaded, and how large.
TYPES = {"pdf": "pdf", "jpg": "image", "jpeg": "image", "png": "image", "docx": "docx", "txt": "text", "xlsx": "spreadsheet", "xls": "spreadsheet", "csv": "spreadsheet"}
ALLOWED = ["pdf", "jpg", "jpeg", "png", "docx", "txt", "csv", "xlsx", "xls"]
LARGEST = 10 * 1024 * 1024
SEPARATORS = [",", ";", "\t", "|"]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names; one of our own only where it names none and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/foliate-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What runs inside gives its shuffle files back at its end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again: its lineage ends there, and no lost executor takes it along."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def file_type(name: Column) -> Column:
    out = F.lit("unknown")
    for ext, kind in TYPES.items():
        out = F.when(extension(name) == ext, kind).otherwise(out)
    return out


def classified(files: DataFrame) -> DataFrame:
    """files(name, length) with type, and problem where a file would be refused."""
    ext = extension(F.col("name"))
    problem = F.when(ext == "", "no extension").when(~ext.isin(ALLOWED), "unsupported format").when(F.col("length") > LARGEST, "too large")
    return files.withColumn("extension", ext).withColumn("file_type", file_type(F.col("name"))).withColumn("problem", problem)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return classified(files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime"))


def decode_text(data: Column) -> Column:
    """UTF-8 where the bytes are that, else Latin-1, which any bytes are."""
    return F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")).otherwise(F.decode(data, "ISO-8859-1"))


def separator(lines: Column) -> Column:
    """The separator with the same count, above none, on most of a file's first lines; a comma where none has one."""
    full = F.filter(lines, lambda x: F.trim(x) != "")
    count = lambda x, sep: F.length(x) - F.length(F.replace(x, F.lit(sep), F.lit("")))
    steady = {sep: F.coalesce(F.when(count(F.get(full, F.lit(0)), sep) > 0, F.size(F.filter(full, lambda x, c=sep: count(x, c) == count(F.get(full, F.lit(0)), c)))), F.lit(0)) for sep in SEPARATORS}
    most, out = F.greatest(*steady.values()), F.lit(SEPARATORS[0])
    for sep in reversed(SEPARATORS):
        out = F.when((most > 0) & (steady[sep] == most), sep).otherwise(out)
    return out


#: A record: stretches outside quotes and quoted ones, which may hold line breaks. A quote that is never closed ends with the file.
RECORD = r'(?:[^"\r\n]++|"(?:[^"]++|"")*+(?:"|\z))++'


def fields(record: Column, sep: Column) -> Column:
    """The cells of a record; separators in quotes belong to their cell."""
    one = F.concat(F.lit(r"\Q"), sep, F.lit(r'\E((?:"(?:[^"]++|"")*+(?:"|\z)|[^"\Q'), sep, F.lit(r"\E])*+)"))
    return F.transform(F.regexp_extract_all(F.concat(sep, record), one, F.lit(1)), lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"')))


def line_text() -> Column:
    return F.when(F.col("utf8"), F.decode("raw", "UTF-8")).otherwise(F.decode("raw", "ISO-8859-1"))


LINES = "sheet string, start bigint, place bigint, raw binary, marks bigint, before bigint, even bigint, odd bigint"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a task with marks, their quotes, before, those of their block before them, and even and odd, the place of the block's last line so far
    that begins after an even or odd number (-1 without one). A block's lines come in order, in one task; only its last numbers are carried on.
    """
    block, held = None, (0, -1, -1)
    for batch in batches:
        t = pa.Table.from_batches([batch])
        marks = pc.count_substring(t["raw"], '"').to_numpy().astype(np.int64)
        place, start = t["place"].to_numpy(), t["start"].to_numpy()
        # an empty line has no block of its own in between, so a block ends where its file or its start changes
        name = t["sheet"].combine_chunks()
        fresh = np.ones(len(start), bool)
        if len(start) > 1:
            fresh[1:] = (start[1:] != start[:-1]) | pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False)
        bounds = [*np.flatnonzero(fresh).tolist(), len(start)]
        before, last = np.zeros_like(marks), [np.full_like(marks, -1), np.full_like(marks, -1)]
        for i, j in zip(bounds, bounds[1:]):
            own = (name[i].as_py(), int(start[i]))
            if own != block:
                block, held = own, (0, -1, -1)
            before[i:j] = held[0] + np.cumsum(marks[i:j]) - marks[i:j]
            for parity in (0, 1):
                begun = np.maximum.accumulate(np.where(before[i:j] % 2 == parity, place[i:j], -1))
                last[parity][i:j] = np.maximum(begun, held[1 + parity])
            held = (int(before[j - 1] + marks[j - 1]), int(last[0][j - 1]), int(last[1][j - 1]))
        for column, values in (("marks", marks), ("before", before), ("even", last[0]), ("odd", last[1])):
            t = t.append_column(column, pa.array(values))
        yield from t.to_batches()


def delimited_lines(spark: SparkSession, path: str, largest: int | None = None) -> DataFrame:
    """The bytes (raw) between line feeds of the files below a path, each with the block (start) of the file in which it begins, its place there, and what `counted` adds.
    Spark splits files as it reads them, so a file of any size is read by many tasks. Written once, as blocks hang on how many executors there are.
    """
    files = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("sheet"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("raw"))
    if largest is not None:
        files = files.filter(F.col("size") <= largest)
    return cut(files.select("sheet", "start", F.monotonically_increasing_id().alias("place"), "raw").mapInArrow(counted, LINES))


def delimited_pieces(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """sheet, start, place, text: lines put together again where a quote is open between them, under the place of the first one.

    Whether a quote is open at the start of a block follows from the number of quotes before it, so only one row of each block is looked at in order. Lines that begin
    and end outside quotes are not grouped.
    """
    begun = F.when(F.col("open") == 0, F.col("even")).otherwise(F.col("odd"))
    heads = lines.groupBy("sheet", "start").agg(F.max("even").alias("even"), F.max("odd").alias("odd")).join(blocks, ["sheet", "start"]).select("sheet", "start", "open", "utf8", F.when(begun >= 0, F.struct("start", begun.alias("place"))).alias("head"))
    carried = F.last("head", True).over(W.partitionBy("sheet").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    own = lines.join(cut(heads.select("sheet", "start", "open", "utf8", carried.alias("carried"))), ["sheet", "start"])
    whole = ((F.col("open") + F.col("before")) % 2 == 0) & (F.col("marks") % 2 == 0)
    first = F.when(begun >= 0, F.struct("start", begun.alias("place"))).otherwise(F.col("carried"))
    parts = own.filter(~whole).select("sheet", first.alias("first"), F.struct("start", "place", line_text().alias("text")).alias("line"))
    made = parts.groupBy("sheet", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]), "\n").alias("text"))
    return own.filter(whole).select("sheet", "start", "place", line_text().alias("text")).unionByName(made.select("sheet", F.col("first.start").alias("start"), F.col("first.place").alias("place"), "text"))


def separators(lines: DataFrame, blocks: DataFrame, head: int) -> DataFrame:
    """sheet, sep: by the first lines of each file, which lie in its first blocks."""
    top = lines.filter(F.col("start") <= 4 * head).join(blocks, ["sheet", "start"])
    top = top.withColumn("nth", F.row_number().over(W.partitionBy("sheet").orderBy("start", "place"))).filter("nth <= 50")
    first = top.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("nth", F.left(line_text(), F.lit(head)).alias("text")))).alias("x"))
    begin = F.split(F.left(F.array_join(F.col("x.text"), "\n"), F.lit(head)), r"\r?\n")
    return first.select("sheet", separator(F.slice(begin, 1, 50)).alias("sep"))


def load_sheets(spark: SparkSession, path: str, head: int = 4000, largest: int | None = None, sep: str | None = None) -> DataFrame:
    """sheet, rn, cells of the delimited files below a path, each with its own separator unless one is given; blank lines are left out, quoted line breaks and separators stay
    in their cell, rows after the last one that is not empty are left out.

    Files are read in blocks by many tasks, whatever their size, and numbered by sums over blocks; only a single record has to fit into a task. A quote that is never closed
    makes the rest of its file one record (a line feed at the file's very end is not part of it). A mark of byte order is not part of the first cell.
    Bytes are UTF-8 if all of the file is, else Latin-1. Where `largest` is given, a file of more bytes comes back as one row without rn and cells.
    """
    lines = delimited_lines(spark, path, largest)
    each = lines.groupBy("sheet", "start").agg(F.sum("marks").alias("n"), F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("utf8"))
    before = W.partitionBy("sheet").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    blocks = cut(each.select("sheet", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2).alias("open"), F.bool_and("utf8").over(W.partitionBy("sheet")).alias("utf8")))
    pieces = delimited_pieces(lines, blocks)
    pieces = pieces.join(separators(lines, blocks, head), "sheet") if sep is None else pieces.withColumn("sep", F.lit(sep))
    records = pieces.select("sheet", "start", "place", "sep", F.posexplode(F.regexp_extract_all("text", F.lit(RECORD), F.lit(0))).alias("nth", "record")).filter(F.trim("record") != "")
    made = records.withColumn("k", F.row_number().over(W.partitionBy("sheet", "start").orderBy("place", "nth")))
    made = cut(made.select("sheet", "start", F.col("k").cast("bigint").alias("k"), fields(F.col("record"), F.col("sep")).alias("cells")))
    counts = made.groupBy("sheet", "start").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(filled(F.col("cells")), F.col("k"))).alias("full"))
    counts = counts.select("sheet", "start", "full", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    counts = counts.select("sheet", "start", "offset", F.max(F.col("offset") + F.col("full")).over(W.partitionBy("sheet")).alias("last"))
    rows = made.join(counts, ["sheet", "start"]).select("sheet", (F.col("offset") + F.col("k")).alias("rn"), "cells", "last").filter("rn <= last").drop("last")
    if largest is None:
        return rows
    refused = spark.read.format("binaryFile").load(path).filter(F.col("length") > largest)
    return rows.unionByName(refused.select(F.col("path").alias("sheet"), F.lit(None).cast("bigint").alias("rn"), F.lit(None).cast("array<string>").alias("cells")))


def filled(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.coalesce(c, F.lit("")) != "")


def trimmed(grid: DataFrame, sheet: str = "sheet_id") -> DataFrame:
    """grid(sheet, rn, cells) without the empty rows after each sheet's last row that is not."""
    last = F.max(F.when(filled(F.col("cells")), F.col("rn"))).over(W.partitionBy(sheet))
    return grid.withColumn("last", last).filter(F.col("rn") <= F.col("last")).drop("last")


def export_rows(results: DataFrame) -> DataFrame:
    """results(document_id, fields map, full_text) as (document_id, nth, key, value) rows, the full text last."""
    own = results.select("document_id", F.posexplode(F.array_sort(F.map_entries("fields"))).alias("nth", "e")).select("document_id", "nth", F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    text = results.select("document_id", F.size("fields").alias("nth"), F.lit("full_text").alias("key"), F.col("full_text").alias("value"))
    return own.unionByName(text)


def export(df: DataFrame, path: str, form: str, *by: str) -> None:
    """Write as text, json, csv or parquet, partitioned by columns."""
    writer = df.write.mode("overwrite").partitionBy(*by)
    writer.option("header", "true").csv(path) if form == "csv" else getattr(writer, form)(path)


def replace_keys(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """A stage's output again: the rows of re-processed keys go, the new ones come."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def aligned(df: DataFrame, schema) -> DataFrame:
    """All columns of a schema, missing ones as typed nulls, further ones after them."""
    have = set(df.columns)
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], *[c for c in df.columns if c not in set(schema.names)])


def cascade(keys: DataFrame, tables: dict[str, DataFrame], key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without the rows of the keys; and how many rows each loses."""
    left = {name: t.join(keys, key, "left_anti") for name, t in tables.items()}
    counts = [t.join(keys, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table_name"), "deleted") for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return left, out
