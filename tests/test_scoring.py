"""Scores of one pass over the texts against brute force."""

import random

import pytest

from foliate.operators import scoring, search
from foliate.plans.fixtures import Fixtures
from pyspark.sql import functions as F

CHUNK = "chunk_id {}, project_id string, content string, deleted_at string"


@pytest.mark.parametrize("kind", ["long", "string"])
def test_best_texts_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(scoring, "QUERIES", 3)  # several passes
    monkeypatch.setattr(scoring, "TOKENS", 5)
    monkeypatch.setattr(scoring, "CELLS", 40)
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("aaäB") for _ in range(draw.randint(1, 6)))
    name = (lambda i: i) if kind == "long" else (lambda i: f"é{i}")
    chunks = [(name(i), draw.choice("pqr"), draw.choice(["\t", " ", ""]) + " \n".join(word() for _ in range(draw.randint(0, 30))), None) for i in range(300)]
    chunks += [(name(900), "p", None, None), (name(901), None, "aa", None), (name(902), "p", "aaaa aaaa", "gone"), (name(903), "p", "", None)]
    queries = [(i, draw.choice(["p", "q", "none", None]), " ".join(word() for _ in range(draw.randint(0, 4)))) for i in range(12)] + [(50, "p", "aa aaaa AA aa")]
    want = {}
    for q, project, text in queries:
        found = []
        for c, p, content, gone in chunks:
            if project is not None and p == project and content is not None and gone is None:
                score = sum(content.lower().count(w) for w in text.lower().split())
                if score:
                    found.append((-score, c))
        for rank, (score, c) in enumerate(sorted(found)[:20], 1):
            want[q, c] = (-score, rank)
    got = search.lexical_search(spark.createDataFrame(queries, "query_id long, project_id string, query_text string"), spark.createDataFrame(chunks, CHUNK.format(kind)).repartition(3))
    assert {(r.query_id, r.chunk_id): (r.score, r.rank) for r in got.collect()} == want
    # neither texts nor hits are dealt by chunk
    assert "hashpartitioning(chunk_id" not in got._jdf.queryExecution().toString()


def test_chunks_meet_their_documents_without_a_join_and_as_before_where_ids_repeat(spark, tmp_path):
    rows = [(1, "a \n\t\nb", "src1"), (2, None, "src1"), (3, " ", None), (17, "x", "src2"), (None, "lost", "src1")]
    for path, further in (("once", []), ("twice", [(1, "c", "src5")])):
        (tmp_path / path).mkdir()
        spark.createDataFrame(rows + further, "doc_id long, text string, source string").write.parquet(str(tmp_path / path / "documents.parquet"))
    once, twice = (Fixtures(spark, str(tmp_path / path)).chunk() for path in ("once", "twice"))
    assert "Join" not in once._jdf.queryExecution().toString()
    assert sorted((r.chunk_id, r.content, r.project_id, r.deleted_at is None) for r in once.collect()) == [(1000, "a", "src1", True), (1002, "b", "src1", True), (17000, "x", "src2", False)]
    assert sorted((r.chunk_id, r.content, r.project_id) for r in twice.filter(F.col("document_id") == 1).collect()) == sorted((1000 + p, c, s) for p, c in ((0, "a"), (2, "b"), (0, "c")) for s in ("src1", "src5"))


def test_keywords_are_looked_for_in_chunks_with_a_vector_alone(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, 1, "p", "some alpha text", None) for i in range(10)], CHUNK.format("long").replace("chunk_id long,", "chunk_id long, document_id long,"))
    vectors = spark.createDataFrame([(3, [1.0, 0.0], "m"), (4, [0.0, 1.0], "other")], "chunk_id long, embedding array<float>, model_name string")
    queries = spark.createDataFrame([(1, "p", "alpha", [0.0, 1.0])], "query_id long, project_id string, query_text string, query_vec array<float>")
    read, before = [], search.word_hits
    monkeypatch.setattr(search, "word_hits", lambda texts, asked: read.append(texts.count()) or before(texts, asked))
    got = search.search_with_keywords(queries, chunks, vectors, "m", 0.5).collect()
    assert [(r.chunk_id, r.score, r.keyword_matched) for r in got] == [(3, 0.0, True)] and read == [1]
