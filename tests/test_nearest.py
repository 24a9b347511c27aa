"""Pruned vector search against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliate.operators import nearest, vectors

VECTORS, QUERIES = "project_id string, chunk_id long, embedding array<float>", "query_id long, project_id string, query_vec array<float>"


def brute(rows, asked, k=None, least=None):
    out = []
    for q, project, qv in asked:
        found = []
        for p, c, v in rows:
            if p == project and v is not None and len(v) == len(qv) and all(x is not None and np.isfinite(x) for x in v):
                a, b = np.array(qv, np.float32).astype(float), np.array(v, np.float32).astype(float)
                length = np.linalg.norm(a) * np.linalg.norm(b)
                found.append((-round(float(a @ b / length) if length else 0.0, 6), c))
        found = [x for x in sorted(found) if least is None or -x[0] >= least][:k]
        out += [(q, c, -s, r) for r, (s, c) in enumerate(found, 1)]
    return sorted(out)


def clusters(n, length=24, groups=40, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, length))
    return [("p" if i % 3 else "q", i, (centres[i % groups] + 0.05 * draw.normal(size=length)).tolist()) for i in range(n)], centres


ODD = [("p", 9001, None), ("p", 9002, [float("nan")] * 24), ("p", 9003, [0.0] * 24), ("p", 9004, [1.0, 2.0]), ("p", 9005, []), (None, 9006, [1.0] * 24)]


@pytest.mark.parametrize("block", [16, 4096])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rows, centres = clusters(600)
    rows += ODD + [("p", 9100 + i, rows[1][2]) for i in range(5)]  # ties
    asked = [(i, "pq"[i % 2], c.tolist()) for i, c in enumerate(centres[:20])] + [(100, "p", [0.0] * 24), (101, "p", [3.0, 4.0]), (102, "nobody", [1.0] * 24), (103, "p", rows[1][2])]
    index = nearest.clustered(spark.createDataFrame(rows, VECTORS))
    queries = spark.createDataFrame(asked, QUERIES)
    got = sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in nearest.search(index, queries, 10).collect())
    assert got == brute(rows, asked, 10)
    got = sorted((r.query_id, r.chunk_id, r.score) for r in nearest.within(index, queries, 0.5).collect())
    assert got == sorted(x[:3] for x in brute(rows, asked, None, 0.5))


def test_fewer_than_a_third_of_the_pairs_are_compared(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 32)
    rows, centres = clusters(3000)
    asked = [(i, "p", c.tolist()) for i, c in enumerate(centres)]
    index, queries = nearest.clustered(spark.createDataFrame(rows, VECTORS)), spark.createDataFrame(asked, QUERIES)
    pairs = nearest.first_blocks(nearest.bounded(index, queries), 20).cache()
    found = nearest.scored(index, pairs.filter("first").withColumn("floor", F.lit(float("-inf"))), 20)
    compared = pairs.filter("first").select("n").unionByName(nearest.second(pairs, found, 20).select("n")).agg(F.sum("n")).first()[0]
    assert compared < len(asked) * sum(p == "p" for p, *_ in rows) / 3
    plan = nearest.search(index, queries, 20)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pair_scores(spark):
    rows, _ = clusters(50)
    pairs = spark.createDataFrame([(0, c, rows[0][2], v) for _, c, v in rows], "query_id long, chunk_id long, query_vec array<float>, embedding array<float>")
    got = sorted((r.query_id, r.chunk_id, r.score) for r in nearest.of_pairs(pairs).collect())
    assert got == sorted(x[:3] for x in brute([("p", c, v) for _, c, v in rows], [(0, "p", rows[0][2])]))


def test_no_vectors_and_no_queries(spark):
    index = nearest.clustered(spark.createDataFrame([], VECTORS))
    asked = spark.createDataFrame([(1, "p", [1.0])], QUERIES)
    assert nearest.search(index, asked, 3).count() == 0 and nearest.within(index, asked, 0.0).count() == 0
    full = nearest.clustered(spark.createDataFrame([("p", 1, [1.0])], VECTORS))
    assert nearest.search(full, asked.filter("false"), 3).count() == 0


def test_embeddings_value_by_value(spark):
    texts = ["", "one text", "日本", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    import hashlib

    for r in frame.select("i", vectors.embed(F.col("t"), "all-MiniLM-L6-v2").alias("v")).collect():
        seed = int(hashlib.sha256(f"all-MiniLM-L6-v2:{texts[r.i] or ''}".encode()).hexdigest()[:8], 16)
        want = np.random.default_rng(seed).standard_normal(384)
        assert np.array_equal(np.array(r.v, np.float32), (want / np.linalg.norm(want)).astype(np.float32))
