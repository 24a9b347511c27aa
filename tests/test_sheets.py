"""Delimited files in many blocks against the standard reader; merged ranges against brute force."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from foliate import sources
from foliate.operators import sheets


@pytest.mark.parametrize("block", [700, 1 << 27])
def test_files_read_in_blocks_equal_the_standard_reader(spark, tmp_path, block):
    draw = random.Random(block)
    cells = ["plain", 'with "quotes"', "two\nlines", "a\r\nb", "x,y", "", "é漢字", "1", '"', "long " * 40, "\n\n", 'end"\n"']
    want = {}
    for name, sep in (("a.csv", ","), ("b.csv", ";"), ("c.csv", ",")):
        rows = [[str(i), "h" if i < 60 else draw.choice(cells), "t" if i < 60 else draw.choice(cells)] for i in range(400)]
        out = io.StringIO()
        csv.writer(out, delimiter=sep, lineterminator="\r\n" if name == "b.csv" else "\n").writerows(rows)
        data = out.getvalue()
        (tmp_path / name).write_bytes((data + f"\n{sep}{sep}\n").encode("utf-8"))
        want[name] = [[c.strip(" ") for c in r] for r in csv.reader(io.StringIO(data, newline=""), delimiter=sep)]
    (tmp_path / "empty.csv").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sources.load_sheets(spark, str(tmp_path / "*.csv")).collect()
        starts = sources.delimited_lines(spark, str(tmp_path / "*.csv")).select("sheet", "start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert block > 1000 or starts > 30
    for name, rows in want.items():
        own = sorted((r.rn, r.cells) for r in got if r.sheet.endswith(name))
        assert [n for n, _ in own] == list(range(1, len(rows) + 1))
        # outer blanks of cells go, as in single files; quoted and unquoted ones alike
        assert [[c.strip(" ") for c in r] for _, r in own] == rows
    assert not [r for r in got if r.sheet.endswith("empty.csv")]


def test_a_file_of_other_bytes_is_latin_in_all_its_blocks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(("plain,1\n" * 200 + "caf\xe9,\"two\nlines\xfc\"\n").encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        got = {r.rn: r.cells for r in sources.load_sheets(spark, str(tmp_path / "a.csv")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 201 and got[201] == ["café", "two\nlinesü"]


def test_a_quote_that_is_never_closed_reaches_over_blocks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + 'x,"open\n' + "line\n" * 100, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
        got = {r.rn: r.cells for r in sources.load_sheets(spark, str(tmp_path / "a.csv")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {1: ["a", "b"], 2: ["x", "open\n" + "\n".join(["line"] * 100)]}


def test_merged_ranges_of_any_size(spark):
    draw = random.Random(4)
    cells = [(s, r, c, f"{s}.{r}.{c}" if draw.random() < 0.8 else None) for s in (1, 2) for r in range(1, 30) for c in range(1, 6)]
    merges = [(1, 2, 1_000_000, 2, 3), (1, 1, 1, 1, 5), (2, 4, 9, 1, 1), (2, 20, 25, 4, 5), (3, 1, 5, 1, 5)]
    frame = spark.createDataFrame(cells, "sheet_id long, rn long, cn long, value string")
    ranges = spark.createDataFrame(merges, "sheet_id long, min_row long, max_row long, min_col long, max_col long")
    at = {(s, r, c): v for s, r, c, v in cells}
    want = {}
    for (s, r, c), v in at.items():
        own = [at.get((a, x, p)) for a, x, y, p, q in merges if a == s and x <= r <= y and p <= c <= q]
        want[s, r, c] = own[0] if own and own[0] is not None else v
    got = sheets.fill_merged(frame, ranges).collect()
    assert {(r.sheet_id, r.rn, r.cn): r.value for r in got} == want and len(got) == len(want)
