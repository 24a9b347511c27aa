"""Cell grids: grid(sheet_id, rn, cells), rn being the 1-based row of the sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.operators.joins import range_join
from foliate.sources import filled

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def column_letters(i: Column) -> Column:
    """A to ZZ for 1 to 702, in base 26 without a zero."""
    one = lambda n: F.substring(F.lit(LETTERS), n.cast("int"), F.lit(1))
    return F.when(i <= 26, one(i)).otherwise(F.concat(one(F.floor((i - 1) / 26)), one((i - 1) % 26 + 1)))


def header_rows(grid: DataFrame) -> DataFrame:
    """sheet_id, header_rn, header: the first row of each sheet that is not empty."""
    return grid.filter(filled(F.col("cells"))).groupBy("sheet_id").agg(F.min("rn").alias("header_rn"), F.min_by("cells", "rn").alias("header"))


def cell_text(value: Column, kind: str) -> Column:
    """A typed cell as text: nothing for null, ISO dates, whole numbers without a fraction."""
    if kind in ("double", "float"):
        out = F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    elif kind == "timestamp":
        out = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        out = F.trim(value.cast("string"))
    return F.coalesce(out, F.lit(""))


def row_elements(grid: DataFrame) -> DataFrame:
    """Rows below the header as text and as a map from coordinates such as B7 to values."""
    rows = grid.join(header_rows(grid).select("sheet_id", "header_rn"), "sheet_id").filter((F.col("rn") > F.col("header_rn")) & filled(F.col("cells")))
    names = F.transform(F.sequence(F.lit(1), F.size("cells")), lambda i: F.concat(column_letters(i), F.col("rn").cast("string")))
    return rows.select("sheet_id", "rn", F.array_join("cells", " | ").alias("content"), F.map_from_arrays(names, F.col("cells")).alias("coordinates"))


def fill_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """cells(sheet_id, rn, cn, value): those inside a range of merges take the value at its top left.

    Rows are joined with ranges of rows, then held against the columns, so a range of a million cells makes some dozens of rows and not a million.
    """
    ranges = merges.select("sheet_id", "min_row", "max_row", "min_col", "max_col")
    top = ranges.join(cells.select("sheet_id", F.col("rn").alias("min_row"), F.col("cn").alias("min_col"), F.col("value").alias("top")), ["sheet_id", "min_row", "min_col"])
    inside = range_join(cells.select("sheet_id", "rn", "cn"), top, "rn", "min_row", "max_row", "sheet_id").filter(F.col("cn").between(F.col("min_col"), F.col("max_col")))
    return cells.join(inside.select("sheet_id", "rn", "cn", "top"), ["sheet_id", "rn", "cn"], "left").select("sheet_id", "rn", "cn", F.coalesce("top", "value").alias("value"))


def as_html(grid: DataFrame) -> DataFrame:
    """sheet_id, html: one table for each sheet."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", lambda c: F.concat(F.lit("<td>"), safe(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    rows = grid.select("sheet_id", "rn", row.alias("html")).groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("rn", "html"))).alias("rows"))
    return rows.select("sheet_id", F.concat(F.lit("<table>"), F.array_join(F.col("rows.html"), ""), F.lit("</table>")).alias("html"))


def search_grid(grid: DataFrame, text: str, first: int = 1000) -> DataFrame:
    """Of each sheet's first rows those with a cell that contains the text, in any case."""
    return grid.filter(F.col("rn") <= first).filter(F.exists("cells", lambda c: F.lower(c).contains(text.lower())))


def mixed_order(grid: DataFrame, column: int) -> DataFrame:
    """The place of each row when a column is sorted: numbers by value, then texts. A total order."""
    cell = F.get("cells", F.lit(column))
    rank = F.row_number().over(W.partitionBy("sheet_id").orderBy(F.expr(f"try_cast(get(cells, {column}) AS double)").asc_nulls_last(), cell, "rn"))
    return grid.select("sheet_id", "rn", cell.alias("cell"), rank.alias("place"))


def sheet_chunks(grid: DataFrame, size: int = 20) -> DataFrame:
    """Chunks of rows with a line that names the sheet and its columns."""
    head = header_rows(grid)
    rows = grid.join(head, "sheet_id").filter((F.col("rn") > F.col("header_rn")) & filled(F.col("cells")))
    nth = F.row_number().over(W.partitionBy("sheet_id").orderBy("rn"))
    line = F.concat(F.lit("Row "), "rn", F.lit(": "), F.array_join("cells", " | "))
    got = rows.withColumn("chunk_index", F.floor((nth - 1) / size)).groupBy("sheet_id", "chunk_index").agg(F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).alias("lines"))
    title = F.concat(F.lit("Sheet: "), "sheet_id", F.lit("\nColumns: "), F.array_join("header", ", "), F.lit("\n---\n"))
    return got.select("sheet_id", "chunk_index", F.concat(title, F.array_join(F.col("lines.line"), "\n")).alias("content"))
