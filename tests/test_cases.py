"""Small cases with values worked out by hand, and invariants of the operators that SQL cannot express."""

import pytest
from pyspark.sql import functions as F

from foliate import sources
from foliate.functions import cosine, estimated_tokens
from foliate.operators import chunking, events, facts, quality, search, sheets, vectors


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_merge_adjacent_makes_pairs(spark):
    rows = [(1, 1, 1, 1), (1, 1, 2, 2), (1, 1, 3, 3), (2, 1, 1, 11), (2, 1, 3, 13), (3, 1, 1, 21), (3, 2, 2, 22)]
    items = spark.createDataFrame([(1, d, p, i, c, f"t{c}", c / 10, c == 2) for d, p, i, c in rows], "query_id long, document_id long, page_number int, chunk_index int, chunk_id long, content string, score double, keyword_matched boolean")
    got = {(r.document_id, r.page_number, r.chunk_index): r for r in search.merge_adjacent(items).collect()}
    assert set(got) == {(1, 1, 1), (1, 1, 3), (2, 1, 1), (2, 1, 3), (3, 1, 1), (3, 2, 2)}
    assert got[1, 1, 1].content == "t1\n\nt2" and got[1, 1, 1].keyword_matched and got[1, 1, 1].score == 0.2


@pytest.mark.parametrize(("budget", "counts", "kept"), [(10, [6, 3, 5], [6, 3]), (100, [60, 80, 5], [60, 41])])
def test_compress(spark, budget, counts, kept):
    items = spark.createDataFrame([(1, i, i, " ".join(["w"] * n)) for i, n in enumerate(counts)], "query_id long, rank int, chunk_id long, content string")
    got = sorted(search.compress(items, budget).collect(), key=lambda r: r.rank)
    assert [len(r.content.replace("...", " x").split()) for r in got] == kept


def test_confidence_fold(spark):
    def fold(*c):
        rows = [(i, 1, 1, "p", "o", x, None, i, None) for i, x in enumerate(c)]
        f = spark.createDataFrame(rows, "fact_id long, project_id long, subject_id long, predicate string, object_text string, confidence double, status string, created_at long, deleted_at timestamp")
        return facts.merged_facts(f).first().confidence

    assert fold(0.9, 0.8, 0.5) == 0.99 and fold(0.99, 0.99, 0.99) == 0.9999 and fold(1.0) == 1.0


def test_windows(spark):
    rows = spark.createDataFrame([(1, "", "a b c d e f g h i j")], "id long, header string, content string")
    got = [r.content for r in chunking.windows(rows, 6, 2).orderBy("window").collect()]  # 4 words, 1 shared
    assert got == ["a b c d", "d e f g", "g h i j", "j"]


def test_page_gaps(spark):
    def codes(*pages):
        docs = spark.createDataFrame([(1,)], "document_id long")
        return sorted(r.code for r in quality.page_issues(docs, spark.createDataFrame([(1, p) for p in pages], "document_id long, page_number int")).collect())

    assert codes(1, 3, 4) == ["PAGE_NUMBER_GAP"] * 2 and codes(1, 1, 2) == ["DUPLICATE_PAGE_NUMBER", "PAGE_NUMBER_GAP", "PAGE_NUMBER_GAP"] and codes(1, 2) == []


def test_diversify(spark):
    def picks(q, *vs):
        rows = [(1, i + 1, i, list(map(float, v)), list(map(float, q))) for i, v in enumerate(vs)]
        c = spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, embedding array<double>, query_vec array<double>")
        return [r.chunk_id for r in search.diversify(c, 3).orderBy("pick").collect()]

    assert picks((1, 0), (0.8, 0.6), (0.8, 0.6), (0.6, -0.8)) == [0, 2, 1]
    assert picks((0.8, 0.6), (0.8, 0.6), (0.8, 0.6), (0.6, -0.8)) == [0, 1, 2]


@pytest.mark.parametrize(("text", "number"), [("500mg", None), ("500 mg", 500.0), ("1.5", 1.5), ("x", None)])
def test_number(spark, text, number):
    assert one(spark, text, "string", facts.number_in) == number


@pytest.mark.parametrize(("a", "b", "kind"), [("5 mg", "5 MG, daily", "duplicate"), ("5 mg", "5 mcg", "duplicate"), ("5 mg", "10 mg", "numeric"), ("500mg", "1000mg", "needs_llm"), ("2019", "10 mg", "numeric"), ("dose 5 in 2019", "dose 5 in 2021", "temporal"), ("unknown", "café noir", "needs_llm")])
def test_pair_kind(spark, a, b, kind):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(facts.pair_kind(F.col("a"), F.col("b"))).first()
    assert row[0] == kind


def test_grounding(spark):
    answers = spark.createDataFrame([(1, "It is so. Alpha beta gamma delta epsilon. Nothing matches whatever here."), (2, search.REFUSAL), (3, "Unknown words entirely.")], "query_id long, answer string")
    contexts = spark.createDataFrame([(1, "alpha beta only")], "query_id long, content string")
    got = {r.query_id: r.grounded for r in search.ground(answers, contexts).collect()}
    assert got == {1: "It is so. Alpha beta gamma delta epsilon.", 2: search.REFUSAL, 3: ""}


def test_packing_pages_is_sequential():
    head = lambda s: f"[{s}] "
    blocks = [("A", "a " * 10), ("A", "b " * 10), ("B", "c " * 90), ("B", "d d")]
    out = chunking.packed(blocks, head, 20, 40, 8)
    assert out[0] == "[A] " + "a " * 10 and out[1].startswith("[A] a a a a a a\n\nb")
    assert all("c" in x for x in out[2:-1]) and out[-1] == "[B] d d"


def test_packing_elements_loses_nothing():
    elements = [("paragraph", "w " * n, 1) for n in (50, 30, 40, 300)] + [("table", "t " * 500, 2), ("paragraph", " ", 2), ("paragraph", "end", 3)]
    out = chunking.grouped(elements, 100, 40)
    assert [p for _, p in out] == [1, 1, 1, 2, 2] or all(any(e[1] in c for c, _ in out) for e in elements if e[1].strip())
    assert out[-1][0] == ["end"]


def test_embedding_model():
    a, b = vectors.unit_vector("x", "m", 384), vectors.unit_vector("x", "m", 384)
    assert (a == b).all() and abs((a**2).sum() - 1) < 1e-9 and not (a == vectors.unit_vector("x", "n", 384)).all()


def test_cosine_without_length(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).first()
    assert row[0] == 0.0


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), ("a b c", 3), (" a\nb ", 2), ("w " * 10, 13)])
def test_tokens(spark, text, n):
    assert one(spark, text, "string", estimated_tokens) == n


def test_column_letters(spark):
    got = {r.id: r.c for r in spark.range(1, 703).select("id", sheets.column_letters(F.col("id")).alias("c")).collect()}
    assert (got[1], got[26], got[27], got[52], got[53], got[702]) == ("A", "Z", "AA", "AZ", "BA", "ZZ")


def test_sheets_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name;n\n"x;y";1\n\n;\nz;2\n;\n', encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("caf\xe9,1\nb,2\n".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"1")
    got = {}
    for r in sources.load_sheets(spark, str(tmp_path / "*.csv")).orderBy("rn").collect():
        got.setdefault(r.sheet[-5:], []).append((r.rn, r.cells))
    assert got == {"a.csv": [(1, ["name", "n"]), (2, ["x;y", "1"]), (3, ["", ""]), (4, ["z", "2"])], "b.csv": [(1, ["café", "1"]), (2, ["b", "2"])]}
    assert {r.name: r.problem for r in sources.catalog(spark, str(tmp_path)).collect()} == {"a.csv": None, "b.csv": None, "c.bin": "unsupported format"}


def test_sheets_with_quoted_line_breaks_and_files_over_the_limit(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x\ny, ""z""",2\n"",\n,3\n"open, to the end\nof it', encoding="utf-8")
    (tmp_path / "b.csv").write_text("a|b|c\n1|2|3\n" + "x" * 400 + "|y|z\n", encoding="utf-8")
    got = {}
    for r in sources.load_sheets(spark, str(tmp_path / "*.csv"), largest=300).orderBy("rn").collect():
        got.setdefault(r.sheet[-5:], []).append((r.rn, r.cells))
    assert got == {"a.csv": [(1, ["a", "b"]), (2, ['x\ny, "z"', "2"]), (3, ["", ""]), (4, ["", "3"]), (5, ["open, to the end\nof it"])], "b.csv": [(None, None)]}
    assert sources.load_sheets(spark, str(tmp_path / "b.csv"), largest=None).count() == 3


def test_chains_and_trees_of_any_depth(spark):
    chain = lambda d, n, first: [(d, str(i), str(i - 1) if i else first) for i in range(n)]
    rows = chain(1, 80, None) + chain(2, 300, None) + chain(3, 5, "4") + [(3, "x", "2"), (3, "y", None), (4, "a", "a"), (5, "b", "gone")]
    frame = spark.createDataFrame(rows, "document_id long, block_id string, parent_block_id string")
    found = {(r.document_id, r.block_id) for r in quality.cyclic(frame).collect()}
    assert found == {(3, str(i)) for i in range(5)} | {(3, "x"), (4, "a")}
    assert quality.cyclic(frame.filter("document_id = 1")).count() == 0
    deep = chunking.flattened(frame.filter("document_id = 1 and cast(block_id as int) < 12 or document_id in (3, 4)"))
    assert sorted((r.document_id, r.level_down) for r in deep.collect()) == [(1, i) for i in range(12)] + [(3, 0)]
    levels = [1, 2, 4, 5, 6, 7, 5, 3, 9]
    heads = spark.createDataFrame([(1, f"b{i}", i, level) for i, level in enumerate(levels)], "document_id long, block_id string, reading_order int, level int")
    got = {r.block_id: r.parent_block_id for r in chunking.parents(heads).collect()}
    assert got == {"b0": None, "b1": "b0", "b2": "b1", "b3": "b2", "b4": "b3", "b5": "b4", "b6": "b2", "b7": "b1", "b8": "b7"}


@pytest.mark.parametrize("form", ["json", "csv", "parquet", "text"])
def test_export(spark, tmp_path, form):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, value string")
    sources.export(df, str(tmp_path / "out"), form, "document_id")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["document_id=1", "document_id=2"]


def test_deliveries_close(spark):
    rows = [("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False), ("b", 2, False), ("b", 3, False), ("b", 4, True), ("c", 1, False)]
    log = spark.createDataFrame([(m, t, t, ok) for m, t, ok in rows], "message_id string, attempt_ts long, event_id long, ok boolean")
    got = {r.message_id: (r.status, r.retry_count) for r in events.delivery_status(log).collect()}
    assert got == {"a": ("completed", 1), "b": ("dead_letter", 3), "c": ("pending", 1)}
