"""Chunks of many pages and documents in one stream against those of each one by itself."""

import random

from foliate.operators import chunking


def test_streams_of_pages_and_documents_equal_each_one_by_itself(spark):
    draw = random.Random(11)
    text = lambda: " ".join("w" * draw.randint(1, 5) for _ in range(draw.choice([0, 3, 9, 40])))
    pages = [(d, p, f"f{d}", b, draw.choice("st"), text()) for d in range(30) for p in (1, 2) for b in range(draw.randint(1, 8))]
    elements = [(d, p, draw.choice(["paragraph", "table", "caption"]), draw.choice([text(), None]), p * 10 + b) for d, p, _, b, _, _ in pages] + [(900, 1, "paragraph", " ", 0)]
    draw.shuffle(pages), draw.shuffle(elements)
    rows = spark.createDataFrame(pages, "document_id long, page_number int, file_name string, block_index int, section_path string, content string")
    made = chunking.pack_pages(rows.repartition(3), 20, 30, 8)
    want = [(d, p, i, x) for d, p in {r[:2] for r in pages} for i, x in enumerate(chunking.packed([r[4:] for r in sorted(pages, key=lambda r: r[3]) if r[:2] == (d, p)], chunking.page_head(f"f{d}", p), 20, 30, 8))]
    assert sorted(map(tuple, made.collect())) == sorted(want)
    rows = spark.createDataFrame(elements, "document_id long, page_number int, element_type string, content string, reading_order int")
    packed = chunking.pack_elements(rows.repartition(3), 20, 8)
    want = [(d, i, p, "\n\n".join(x)) for d in {r[0] for r in elements} for i, (x, p) in enumerate(chunking.grouped([(r[2], r[3] or "", r[1]) for r in sorted(elements, key=lambda r: r[4]) if r[0] == d], 20, 8))]
    assert sorted(map(tuple, packed.collect())) == sorted(want)
    # no call of Python for each page or document
    assert all("FlatMapGroups" not in x._jdf.queryExecution().toString() for x in (made, packed))
