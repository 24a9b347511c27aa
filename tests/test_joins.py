"""Joins on order against brute force; trees, folds and life cycles in any order."""

import random

import numpy as np
from pyspark.sql import functions as F

from foliate import streaming
from foliate.operators import chunking, events, facts, joins, search
from foliate.operators.totals import totals


def test_buckets_tile_intervals_without_overlap(spark):
    draw = random.Random(1)
    rows = [(5, 20), (-7, 300), (16, 31), (100, 99), (0, 0), (-1, 0), (-(1 << 50), 1 << 50), (None, 3)] + [tuple(sorted((draw.randint(-5000, 5000), draw.randint(-5000, 5000)))) for _ in range(30)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a long, b long")
    for r in frame.select("*", joins.buckets(F.col("a"), F.col("b")).alias("x")).collect():
        spans = sorted((x.bucket << 4 * x.level, (x.bucket + 1 << 4 * x.level) - 1) for x in r.x or [])
        if r.a is None or r.a > r.b:
            assert not spans
        else:
            assert spans[0][0] == r.a and spans[-1][1] == r.b and all(p[1] + 1 == q[0] for p, q in zip(spans, spans[1:])) and len(spans) <= 30 * 16


def test_range_join_equals_between(spark):
    draw = random.Random(2)
    points = [(i, draw.choice("ab"), draw.randint(-1000, 1000) if i % 3 else 7) for i in range(500)] + [(900, "a", None), (901, None, 7)]
    bands = [(i, draw.choice("ab"), x, x + draw.choice([-1, 0, 3, 100, 5000])) for i in range(60) for x in [draw.randint(-1500, 1000)]] + [(70, "a", None, 5)]
    p = spark.createDataFrame(points, "i int, k string, v long")
    b = spark.createDataFrame(bands, "j int, k string, low long, high long")
    want = sorted((i, j) for i, k, v in points for j, h, x, y in bands if None not in (k, v, x) and k == h and x <= v <= y)
    got = joins.range_join(p, b, "v", "low", "high", "k")
    assert sorted((r.i, r.j) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    every = sorted((i, j) for i, _, v in points for j, _, x, y in bands if None not in (v, x) and x <= v <= y)
    assert sorted((r.i, r.j) for r in joins.range_join(p, b.drop("k"), "v", "low", "high").select("i", "j").collect()) == every


def test_range_totals_equal_sums_of_pairs_without_making_them(spark):
    draw = random.Random(5)
    points = [(i, draw.randint(-1000, 1000) if i % 3 else 7) for i in range(500)] + [(900, None)]
    bands = [(i, x, x + draw.choice([-1, 0, 3, 100, 5000])) for i in range(60) for x in [draw.randint(-1500, 1000)]] + [(70, None, 5), (71, -5000, 5000), (72, -5000, 5000), (73, 6000, 7000)]
    p, b = spark.createDataFrame(points, "i int, v long"), spark.createDataFrame(bands, "j int, low long, high long")
    want = {}
    for j, low, high in bands:
        inside = [i for i, v in points if None not in (v, low) and low <= v <= high]
        if inside:
            want[j] = (len(inside), min(inside))
    assert {r.j: (r.n, r.first) for r in joins.range_totals(p, b, "v", "low", "high", "n", first="i").collect()} == want
    assert joins.range_totals(p, b.filter("j = 70"), "v", "low", "high", "n").isEmpty()
    # 20,000 points in each of 2,000 bands: 40 million pairs
    many = spark.range(20000).select(F.col("id").alias("i"), (F.col("id") % 5000).alias("v"))
    wide = spark.range(2000).select(F.col("id").alias("j"), (-F.col("id")).alias("low"), (F.col("id") + 6000).alias("high"))
    assert joins.range_totals(many, wide, "v", "low", "high", "n", first="i").groupBy("n", "first").count().collect() == [(20000, 0, 2000)]


def test_asof_join_with_a_key_of_most_rows_over_many_parts(spark):
    draw = random.Random(3)
    left = [(i, 1 if i % 3 else draw.randint(2, 9), draw.randint(0, 200)) for i in range(400)] + [(900, None, 5), (901, 1, None)]
    right = [(1000 + i, 1 if i % 3 else draw.randint(2, 9), draw.randint(0, 200)) for i in range(90)] + [(1900, None, 5), (1901, 1, None)]
    schema = "id long, k long, t long"
    want = {}
    for i, k, t in left:
        found = [(u, j) for j, h, u in right if None not in (k, t, u) and h == k and u <= t]
        want[i] = max(found)[::-1] if found else None
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = joins.asof_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "t", "id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.id: (r.found.id, r.found.t) if r.found else None for r in got} == want and len(got) == len(left)


def test_tree_order_of_a_deep_chain_and_of_what_hangs_nowhere(spark):
    rows = [(1, f"n{i}", f"n{i - 1}" if i else None, 0) for i in range(5000)]
    rows += [(2, "a", None, 5), (2, "b", None, 3), (2, "c", "b", 9), (2, "d", "b", 9), (2, "e", "c", 0), (2, "f", "a", 1)]
    rows += [(3, "x", "y", 0), (3, "y", "x", 1), (3, "z", "y", 2), (3, "w", "missing", 3), (3, "v", None, 4)]
    got = {(r.document_id, r.block_id): (r.position, r.level_down) for r in chunking.tree_order(spark.createDataFrame(rows, "document_id long, block_id string, parent_block_id string, reading_order int")).collect()}
    assert all(got[1, f"n{i}"] == (i + 1, i) for i in range(5000))
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {"b": (1, 0), "c": (2, 1), "e": (3, 2), "d": (4, 1), "a": (5, 0), "f": (6, 1)}
    assert {k: v for k, v in got.items() if k[0] == 3} == {(3, "v"): (1, 0)}


def fact_rows(n, seed=4):
    draw = random.Random(seed)
    return [(i, 1, 1 if i % 3 == 0 else draw.randint(2, 40), "is", "so", draw.choice([0.0012, 0.5, 0.0005, 0.123456, 0.05, 1.0 if i > n - 3 else 0.00035]) / (50 if i % 3 == 0 else 1), "unverified", f"2024-01-{draw.randint(1, 28):02d}", None) for i in range(n)]


def test_folded_confidence_of_a_hot_key_in_parts(spark):
    schema = "fact_id long, project_id long, subject_id long, predicate string, object_text string, confidence double, status string, created_at string, deleted_at string"
    frame = spark.createDataFrame(fact_rows(900), schema)
    whole = {r.canonical_id: (len(r.fact_ids), round(r.confidence, 6)) for r in facts.merged_facts(frame).collect()}
    for few in (1, 20, 10_000):
        got = {r.canonical_id: (r.n_facts, round(r.confidence, 6)) for r in facts.folded_confidence(frame, few).collect()}
        assert got == whole
    assert {(r.fact_id, r.canonical_id) for r in facts.fact_map(frame).collect()} == {(i, r.canonical_id) for r in facts.merged_facts(frame).collect() for i in r.fact_ids}


def test_maps_of_parts_compose():
    draw = np.random.default_rng(5)
    c = draw.random(60) / 20
    states = np.arange(facts.STATES)
    for x in c.tolist():
        states = facts.step(states, x)
    first, second = facts.part_map(c[:25]), facts.part_map(c[25:])
    assert (second[first] == states).all()
    assert facts.four_places(np.array([0.12345, 0.12355, 0.00005, 0.99995])).tolist() == [1235, 1236, 1, 10000]


def lifecycle_files(spark, folder):
    draw = random.Random(6)
    rows = [(d, f"2024-01-{1 + i // 4:02d} 00:00:{i % 4:02d}", i, draw.random() < 0.3) for i in range(24) for d in (1, 2)] + [(1, None, 99, False)]
    log = spark.createDataFrame(rows, "document_id long, ts string, event_id long, is_valid boolean").withColumn("ts", F.to_timestamp("ts"))
    for k in (3, 1, 0, 2):
        log.filter(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(folder)
    return log, spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_lifecycle_of_late_events_equals_its_batch_twin(spark, tmp_path):
    log, stream = lifecycle_files(spark, str(tmp_path / "log"))
    key = ["document_id", "event_id", "status", "retry_count"]
    got = sorted(tuple(r) for r in streaming.fold_lifecycle(stream).select(key).collect())
    assert got == sorted(tuple(r) for r in events.lifecycle(log).select(key).collect())


def test_lifecycle_state_ends_and_names_what_came_too_late(spark, tmp_path):
    rows = [[(1, f"2024-01-{d:02d} 00:00:00", d, False)] for d in (1, 2, 20, 21, 3)]
    schema = "document_id long, ts string, event_id long, is_valid boolean"
    for r in rows:
        spark.createDataFrame(r, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(spark.createDataFrame([], schema).withColumn("ts", F.to_timestamp("ts")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = {r.event_id: (r.status, r.retry_count) for r in streaming.fold_lifecycle(stream, keep=5 * 86_400_000_000).collect()}
    assert got == {1: ("ready_for_reindex", 1), 2: ("ready_for_reindex", 2), 20: ("failed", 0), 21: ("ready_for_reindex", 1), 3: (None, None)}


def test_containment_of_short_needles_makes_few_runs_and_both_ways_agree(spark, monkeypatch):
    draw = random.Random(9)
    text = lambda n: "".join(draw.choice("ab é") for _ in range(n))
    texts = [(d, text(draw.randint(0, 60))) for d in range(4) for _ in range(20)] + [(5, text(3000))]
    needles = [(d, text(draw.randint(1, 5))) for d in range(4) for _ in range(6)] + [(d, x[3 : 3 + draw.randint(5, 20)]) for d, x in texts] + [(5, None), (None, "a")]
    n, t = spark.createDataFrame(needles, "d long, needle string"), spark.createDataFrame(texts, "d long, text string")
    want = sorted({(d, x, y) for d, x in needles for e, y in texts if d == e and x and x in y})
    made = []
    monkeypatch.setattr(joins, "by_rarest_gram", lambda *a, f=joins.by_rarest_gram: made.append(1) or f(*a))
    for direct in (256, 0):
        monkeypatch.setattr(joins, "DIRECT", direct)
        assert sorted(tuple(r) for r in joins.containment_join(n, t, "d").collect()) == want
    assert len(made) == 1  # small keys need no runs of characters


def test_containment_join_equals_contains(spark):
    draw = random.Random(6)
    text = lambda n: "".join(draw.choice("ab é𝄞") for _ in range(n))
    texts = [(draw.randint(1, 3), text(draw.randint(0, 60))) for _ in range(150)] + [(1, None), (None, "ab"), (1, "a" * 3000), (9, "nobody asks")]
    needles = [(d, t[i : i + draw.choice([1, 2, 5, 12, 13, 30])]) for d, t in texts if t for i in [draw.randint(0, max(0, len(t) - 5))]] + [(1, ""), (1, None), (None, "a"), (2, "not there at all"), (1, "a" * 40)]
    n, t = spark.createDataFrame(needles, "d long, needle string"), spark.createDataFrame(texts, "d long, text string")
    want = {(d, x, y) for d, x in needles for e, y in texts if None not in (d, x, e, y) and d == e and x and x in y}
    got = [tuple(r) for r in joins.containment_join(n, t, "d").collect()]
    assert set(got) == want and len(got) == len(want)
    assert joins.containment_join(n.limit(0), t, "d").count() == 0 and joins.containment_join(n, t.limit(0), "d").count() == 0


def test_layout_in_a_document_of_many_elements(spark):
    elements = spark.range(100_000).selectExpr("1L AS document_id", "cast(id AS string) AS block_id", "CASE WHEN id % 10 = 0 THEN NULL ELSE cast(id - id % 10 AS string) END AS parent_block_id", "CASE WHEN id % 10 = 0 THEN 'heading' ELSE 'paragraph' END AS element_type", "concat('this is the text of element ', id, '.') AS content", "cast(id AS int) AS reading_order", "array(1D) AS bounding_box")
    items = [(1, i, 1, f"before this is the text of element {7 * i}. after") for i in range(300)] + [(2, 1, 1, "of element 4"), (2, 2, 1, ""), (2, 3, 1, None), (2, 4, 1, "nothing like it"), (2, 5, 7, "of element 4")]
    got = {(r.query_id, r.chunk_id): (r.block_id, r.heading) for r in search.layout_of(spark.createDataFrame(items, "query_id long, chunk_id long, document_id long, content string"), elements).collect()}
    want = {(1, i): (str(7 * i), f"this is the text of element {7 * i - 7 * i % 10}.") for i in range(300)}
    first = "this is the text of element 0."
    assert got == want | {(2, 1): ("4", first), (2, 2): ("0", first), (2, 3): (None, None), (2, 4): (None, None), (2, 5): (None, None)}


def test_totals_at_several_levels_and_errors_of_sketches(spark):
    draw = random.Random(8)
    rows = [(draw.choice(["x", "y", None]) if i % 3 else "x", draw.randint(0, 4), draw.randint(0, 9000), draw.randint(-5, 100)) for i in range(30_000)] + [("z", 1, None, None)]
    frame = spark.createDataFrame(rows, "a string, b long, user long, v long")
    got = {(r.level, r.a, r.b): r for r in totals(frame, [["a", "b"], ["b"], []], ["v"], ["user"], ["v"]).collect()}
    groups = {}
    for a, b, u, v in rows:
        for key in ((0, a, b), (2, None, b), (3, None, None)):
            groups.setdefault(key, []).append((u, v))
    assert set(got) == set(groups)
    for key, own in groups.items():
        r, values = got[key], sorted(v for _, v in own if v is not None)
        users = len({u for u, _ in own if u is not None})
        assert r.n == len(own) and r.sum_v == (sum(values) if values else None) and abs(r.distinct_user - users) <= max(1, 0.08 * users)
        if values:
            low, high = sum(v < r.median_v for v in values) / len(values), sum(v <= r.median_v for v in values) / len(values)
            assert low - 0.02 <= 0.5 <= high + 0.02
        else:
            assert r.median_v is None
    none = totals(frame.limit(0), [["a"], []], ["v"], ["user"], ["v"]).collect()
    assert [r.n for r in none if r.level == 1] in ([], [0])


def test_trees_write_only_what_large_documents_still_need(spark, monkeypatch):
    rows = [(1, f"a{i}", f"a{i - 1}" if i else None, i) for i in range(300)] + [(d, f"b{i}", "b0" if i else None, i) for d in range(2, 60) for i in range(4)] + [(90, "x", "y", 0), (90, "y", "x", 1), (90, "z", None, 2)]
    e = spark.createDataFrame(rows, "document_id long, block_id string, parent_block_id string, reading_order int")
    sizes, before = [], chunking.cut

    def cut(df):
        made = before(df)
        sizes.append(made.count() if "step" in made.columns else 0)
        return made

    monkeypatch.setattr(chunking, "cut", cut)
    got = {(r.document_id, r.block_id): (r.level_down, r.position) for r in chunking.tree_order(e).collect()}
    assert got == {(1, f"a{i}"): (i, i + 1) for i in range(300)} | {(d, f"b{i}"): (min(i, 1), i + 1) for d in range(2, 60) for i in range(4)} | {(90, "z"): (0, 1)}
    assert [n for n in sizes if n][-1] == 600  # the last rounds are of the one deep document alone
    read = []
    monkeypatch.setattr(chunking, "cut", lambda df: read.append(df.columns) or before(df))
    levels = chunking.flattened(e.filter("document_id = 2 or document_id = 90")).collect()
    assert sorted((r.block_id, r.level_down) for r in levels) == [("b0", 0), ("b1", 1), ("b2", 1), ("b3", 1), ("z", 0)] and read[0] == ["document_id", "block_id", "parent_block_id"]
