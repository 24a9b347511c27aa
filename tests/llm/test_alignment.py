import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest

from foliate.llm import alignment
from foliate.llm.alignment import Aligner, Pieces, align, alignments, asked_by_chunk, link_counts

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HOSTILE = [
    "plain words here", "", None, " ", "  ", "a ", " a", "a\nb", "a \n b\n", "\n", "\n\nx", "a\n\n\nb ", "<|endoftext|> x<|endoftext|>", "<s> </s> <unk> <0x41>", "a▁b", "▁", "é ß  123 45", "日本 語 テキスト。", "🙂🙃 x",
    "ﬁ ①　z y", "a\tb\x00c\x7f", "word " * 300, "aaaaaaaaaaaaaaaaaaaaaa" * 20, "x" + " " * 77 + "y", "Don't stop, it's 3.14!", "́́", "a\r\nb\r\n",
]


@pytest.fixture(scope="module")
def both():
    return Aligner(*PATHS)


@pytest.fixture(scope="module")
def plain_tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATHS[1])


def brute(texts, tools):
    """Per text: ids, groups of ids cut at common ends, and links, from untouched libraries, token by token."""
    a, b = tools
    letters = alignment.byte_level()
    out = []
    for text in texts:
        row = None
        if text:
            want = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
            if b"".join(bytes_a) == want and b"".join(bytes_b) == want:
                ends = [[sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (bytes_a, bytes_b)]
                groups, cuts = [], sorted(set(ends[0]) & set(ends[1]))
                for low, high in zip([0, *cuts], cuts):
                    groups.append(tuple([i for i, e in zip(ids, own) if low < e <= high] for ids, own in zip((ids_a, ids_b), ends)))
                row = ids_a, ids_b, groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])
        out.append(row)
    docs = Counter(p for row in out if row for p in row[3])
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    rows = []
    for row in out:
        if row is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in row[2])
        links = row[3]
        rows.append((len(row[0]), len(row[1]), len(row[2]), sum(links.values()), sum(n for p, n in links.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return rows, docs


def rows_of(frame):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return {r.doc_id: tuple(r[c] for c in names) for r in frame.collect()}


def test_units_give_the_ids_of_whole_texts(plain_tools):
    pieces = Pieces(PATHS[1])
    assert pieces.cuts
    texts = [x for x in HOSTILE if x]
    for _ in range(2):
        ids, counts = pieces.ids(pa.array([" " + x for x in texts]))
        assert counts.tolist() == [len(plain_tools[1].encode(x)) for x in texts]
        assert ids.tolist() == [i for x in texts for i in plain_tools[1].encode(x)]


def test_units_of_random_texts(plain_tools):  # U+2581 left out: its texts have no tokens
    pieces, draw = Pieces(PATHS[1]), random.Random(7)
    texts = ["".join(draw.choice("ab cd\n é<0x1>  \t日") for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    ids, counts = pieces.ids(pa.array([" " + x for x in texts]))
    assert ids.tolist() == [i for x in texts for i in plain_tools[1].encode(x)]


def test_align_equals_brute_force(spark, docs, plain_tools):
    texts = HOSTILE + HOSTILE[:9] + ["plain words there", "other words here"]
    want, _ = brute(texts, plain_tools)
    found = rows_of(align(docs(texts), *PATHS))
    assert [found[i] for i in range(len(texts))] == want
    assert any(w[0] and w[3] > w[0] for w in want) and want[HOSTILE.index("a▁b")][-1] == ""


def test_many_chunks_give_the_same(spark, docs, plain_tools):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["alpha", "betas", "γάμμα", "12", "naïve", "🙂", "extraordinarily", "\n"]) for _ in range(draw.randint(0, 30))) for _ in range(200)]
    want, counts = brute(texts, plain_tools)
    found = rows_of(align(docs(texts).repartition(3), *PATHS, chunk_bytes=1))
    assert [found[i] for i in range(len(texts))] == want
    rows = alignments(docs(texts), *PATHS, chunk_bytes=500)
    assert rows.select("chunk").distinct().count() > 1
    links = link_counts(asked_by_chunk(rows, "<u4"), Aligner(*PATHS).base).collect()
    assert {(r.a_id, r.b_id): r.docs for r in links} == dict(counts)


def test_large_groups_go_by_distinct_ids(monkeypatch, both, plain_tools):
    texts = [x for x in HOSTILE if x]
    want, _ = brute(texts, plain_tools)
    monkeypatch.setattr(alignment, "SMALL_GROUP", 0)
    made = both.align(pa.array(texts))
    assert [x[:5] for x in made] == [(*w[:4], w[6]) for w in want]
    monkeypatch.setattr(alignment, "SMALL_GROUP", 256)
    assert both.align(pa.array(texts)) == made


def test_ids_nulls_and_empty_tables(spark, docs, plain_tools):
    rows = [(5, "same text"), (5, "same text"), (None, "same text"), (7, None), (None, None)]
    frame = align(docs(rows), *PATHS)
    got = sorted(((r.doc_id, r.n_a, r.count_sum) for r in frame.collect()), key=repr)
    assert got == sorted([(5, 2, 6), (5, 2, 6), (None, 2, 6), (7, 0, 0), (None, 0, 0)], key=repr)
    assert align(docs([]), *PATHS).count() == 0 and align(docs([None, ""]), *PATHS).filter("n_links = 0 and groups_sha256 = ''").count() == 2


def test_a_very_long_text_is_one_document(spark, docs, plain_tools):
    long = "many words of a long text, " * 120_000
    short = "many words of a long text, " * 3
    found = rows_of(align(docs([long, short]), *PATHS))
    assert found[0][0] > 700_000 and found[0][2] > 700_000
    assert found[1][:4] == brute([short], plain_tools)[0][0][:4]
