"""The corpus pipeline: each stage against a plain version of its decision, on rows that share ids, nulls and empty tables."""

import pytest

import corpus_pipeline
from foliate.llm import minhash, quality


@pytest.fixture
def sf_dir(spark, tmp_path, words):
    benchmark = [(1, words(12, 900)), (2, "short item")]
    labels = [(i, 1, 0) for i in range(40)] + [(200, 0, 0)]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def clean(i, words):
    return " ".join(f"the {a} and of {b}" for a, b in zip(words(40, i).split(), words(40, i + 50).split()))


@pytest.fixture
def rows(words):
    near = clean(7, words).split()
    near[100] = "changed"
    return [(i, clean(i, words)) for i in range(40)] + [
        (300, clean(3, words).replace(" ", "  ")),  # exact copy, longer: it stays, the shorter one goes
        (301, clean(4, words)), (4, clean(5, words)), (None, clean(6, words)), (None, clean(45, words)),
        (302, " ".join(near)), (303, clean(46, words) + " " + words(12, 900)), (304, "a short item here"), (305, None), (306, ""), (306, "  "), (46, clean(47, words)), (46, clean(48, words)),
    ]


def texts(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_stages_keep_and_drop_rows(spark, docs, sf_dir, rows, words):
    stages = dict(corpus_pipeline.STAGES)
    frame = docs(rows)
    quality_out = stages["quality"](spark, frame, sf_dir)
    kept = {(r.doc_id, r.copy) for r in quality.classify(frame.selectExpr("*", "text AS copy"), quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")), "copy").filter("kept").collect()}
    assert quality_out.columns == frame.columns and set(texts(quality_out)) == kept
    exact = stages["exact_dedup"](spark, frame, sf_dir)
    gone = [(3, clean(3, words)), (301, clean(4, words)), (5, clean(5, words)), (None, clean(6, words))]
    left = [x for x in rows if x not in gone and x[0] != 306 and x[0] != 305]
    got = texts(exact)
    assert [x for x in got if (x[1] or "").strip()] == sorted(left, key=str) and exact.columns == frame.columns
    assert [x[0] for x in got if not (x[1] or "").strip()] == [306]  # of null, empty and blank texts the longest
    near = stages["near_dedup"](spark, exact, sf_dir)
    assert set(got) - set(texts(near)) == {x for x in rows if x[0] == 302} and len(texts(near)) == len(got) - 1 and near.columns == frame.columns
    last = stages["decontaminate"](spark, near, sf_dir)
    assert {x[0] for x in texts(near)} - {x[0] for x in texts(last)} == {303, 304} and last.columns == frame.columns
    packed = stages["packing"](spark, last, sf_dir).collect()
    assert {r.doc_id for r in packed} == {x[0] for x in texts(last)}


def test_stages_of_empty_tables(spark, docs, sf_dir):
    empty = docs(["a"]).filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == [], name


def test_whole_run_on_repeated_rows_and_clashing_columns(spark, docs, sf_dir, rows):
    frame = docs(rows + rows[:5]).selectExpr("*", "1 AS stays", "2 AS lang2", "3 AS shard", "4 AS row")
    frame.write.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0)  # each text that stays lies in the pieces whole, and once
    first = [(r.doc_id, r.ids_crc32, r.doc_tokens) for r in out if r.start == 0]
    assert len(set(first)) == len(first) and {4, 46, None} <= {i for i, _, _ in first}


def test_near_copies_that_reach_the_similarity_are_caught(docs):
    """One word in 300 changed: shingles of five words keep a similarity of 0.96 or more. All planted pairs must be found."""
    import random

    draw = random.Random(4)
    made = []
    for i in range(80):
        w = [f"v{draw.randrange(5000)}" for _ in range(300)]
        made.append(" ".join(w))
        for at in draw.sample(range(300), 6):  # at most 30 of 296 shingles change: similarity 0.81 or more
            w[at] = "other"
        made.append(" ".join(w))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(made), corpus_pipeline.WORDS, corpus_pipeline.PERCENT).collect()}
    assert sum(found[i + 1] == i for i in range(0, 160, 2)) >= 79
