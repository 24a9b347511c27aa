import base64
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from foliate.llm import files, packing, records, warc
from foliate.llm.common import shared_folder
from foliate.llm.tokens import Encoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["it's. so's, don't! 'x' a'b.c", "a.b,c;d 1.5 2,5% (x) [y]\n- z\n\nq\n r \n", "x_y-z\n", "\n", "a\n\tb", "plain words here", "a  b", " a", "a ", "a \n b", "x  y", "don't  do 's", "\0a b", "", "a\tb c", "\n\n a  \n", "é ß  123 45", "<|endoftext|> x", "日本 語 テキスト", "word " * 3000]


def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def as_lists(e, texts):
    ids, counts = e.ids(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_cut_and_cached_ids_are_the_library_s():
    t, e = model(), Encoder(VOCABULARY)
    spaces = [f"a{s}b {s}c{s} d \u3042{s} \u201cq\u201d {s}" for s in "\x1c\x85\xa0\u1680\u2000\u200a\u2028\u202f\u205f\u3000"]
    texts = ODD + spaces + ["x "] + ODD
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert as_lists(e, texts) == want and as_lists(e, texts) == want
    assert as_lists(e, [None, "a", None]) == [[], t.encode("a").ids, []] and len(e.ids(pa.array([], pa.string()))[0]) == 0
    assert as_lists(e, pa.array(texts)[5:9]) == want[5:9]


def test_added_tokens_in_texts_are_encoded_as_the_untouched_library_does():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    texts = ["end <|endoftext|> start", "plain words", None, "<|endoftext|>", "<|endoftext|><|endoftext|> x\ny.z", "<|endoftext |> <|endof\ntext|>", "", "a<|endoftext|>b", "w x " * 3000 + "<|endoftext|>\n", "end of it"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert as_lists(e, texts) == want and as_lists(e, texts) == want and 50256 in want[0]
    assert as_lists(e, pa.array(texts)[3:8]) == want[3:8] and all(len(x) <= 1 << 12 for x in e.known)


def test_long_words_of_two_letters_keep_their_own_ids(thue_morse):
    t, e = model(), Encoder(VOCABULARY)
    for k in (6, 10, 11, 12, 14):
        a, b = thue_morse(k)
        texts = [a, b, f"{a} {b}", f"x {b} y {a} {a}", f"({b})"]
        assert as_lists(e, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_units_that_share_a_hash_are_kept_apart(monkeypatch):
    from foliate.llm import tokens, wordhash

    monkeypatch.setattr(wordhash.Bytes, "hashes", lambda self, which=0: (self.sizes % 3).astype(np.uint64))
    t, e = model(), Encoder(VOCABULARY)
    texts = ["some words of many lengths, and a word of them again. A 'quoted' one.", "x" * 100 + " " + "y" * 100 + " " + "x" * 100, *ODD]
    assert as_lists(e, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert tokens.JOINED > 1


def test_generations_of_the_cache(monkeypatch):
    from foliate.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e, t = Encoder(VOCABULARY), model()
    for text in ["a b c d e", "f g h", "a b c", "e f g h i j"] * 3:
        assert as_lists(e, [text]) == [t.encode(text, add_special_tokens=False).ids]


def wanted(texts):
    t = model()
    return {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for i, x in enumerate(texts)}


def test_records_round_trip(spark, docs):
    texts = [*ODD, None]
    ids, start = wanted(texts), 0
    manifest = records.write_records(docs(texts), shared_folder(spark), VOCABULARY)
    rows = {r.doc_id: r for r in records.read_records(manifest).collect()}
    for i in sorted(ids):
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])
    path = rows[3].path
    own = sorted((r.nth, r.doc_id) for r in rows.values() if r.path == path)
    nth = [n for n, _ in own][::-1]
    assert [k for k, _ in records.read_at(path, nth)] == [k for _, k in own][::-1]
    assert all(b == ids[k].tobytes() for k, b in records.read_at(path, nth))


def test_records_and_pieces_of_repeated_rows_and_very_long_texts(spark, docs, thue_morse):
    a, b = thue_morse(12)
    long = "a word and one more, " * 20_000 + a + " " + b
    texts = [(3, "same"), (3, "same"), (3, None), (1, long), (2, b), (4, a), (0, "")]
    want = sorted((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, x in texts for ids in [model().encode(x or "", add_special_tokens=False).ids + [0]])
    manifest = records.write_records(docs(texts), shared_folder(spark), VOCABULARY)
    back = records.read_records(manifest).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in back) == want
    starts = sorted((r.start, r.n_tokens) for r in back)
    assert [x for x, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
    pieces = packing.pack(docs(texts), VOCABULARY).collect()
    assert sum(r.length for r in pieces) == sum(n for _, n, _ in want) and sorted(r.sequence_id for r in pieces) == list(range(len(pieces)))


def test_a_changed_byte_is_found():
    data = records.frame(b"payload" * 9)
    assert records.read_record(io.BytesIO(data)) == b"payload" * 9 and records.read_record(io.BytesIO(b"")) is None
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(records.Damaged):
            records.read_record(io.BytesIO(bytes(bad)))


def test_records_of_an_empty_table(spark, docs):
    manifest = records.write_records(docs(["a"]).filter("false"), shared_folder(spark), VOCABULARY)
    assert records.read_records(manifest).collect() == []


def test_lengths():
    assert packing.lengths(2059, 1024) == [1024, 1024, 8, 2, 1] and packing.lengths(1024, 1024) == [1024] and packing.lengths(1, 1024) == [1]


def test_packing_places_each_id_once(docs):
    texts = [*ODD, None]
    ids = wanted(texts)
    rows = packing.pack(docs(texts), VOCABULARY, 64).collect()
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert packing.pack(docs(["a"]).filter("false"), VOCABULARY).collect() == []


def member(page, payload, refers=None):
    state = zlib.compressobj(6, zlib.DEFLATED, 31)
    return state.compress(warc.build(page, "http://x/", payload, refers, "2024-01-01T00:00:00Z")) + state.flush()


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_logs_gaps_and_goes_on(packed):
    make = member if packed else lambda page, payload: warc.build(page, "http://x/", payload, None, "2024-01-01T00:00:00Z")
    parts = [make(i, f"page {i} WARC/1.1 in its text \x1f".encode() * 40) for i in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = b"junk" + parts[0] + parts[1] + bytes(broken) + parts[3] + b"\x1f\x8b\x08 not a member" + parts[4] + parts[5][:-9]
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    assert [x.headers["x-page-id"] for x in found if not isinstance(x, tuple)] == ["0", "1", "3", "4"]
    gaps = [x[:2] for x in found if isinstance(x, tuple)]
    spans = sorted(gaps + [(x.begin, x.end) for x in found if not isinstance(x, tuple)])
    assert gaps[0] == (0, 4) and spans[0][0] == 0 and spans[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # no byte is lost or read twice


def zipped(data):
    state = zlib.compressobj(6, zlib.DEFLATED, 31)
    return state.compress(data) + state.flush()


def record(kind, block, version="1.0", **more):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC-Type": kind, "Content-Length": len(block), **more}.items())
    return f"WARC/{version}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def read(data):
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    return [x for x in found if not isinstance(x, tuple)], [x for x in found if isinstance(x, tuple)]


@pytest.mark.parametrize("large", [0, 3 << 20])
def test_salvage_of_members_with_many_records(large):
    made = [warc.build(i, None, b"p%d " % i + b"x" * large, None, "2024-01-01T00:00:00Z") for i in range(5)]
    wrong = bytearray(made[2])
    wrong[made[2].index(b"p2 ")] ^= 1  # its digest no longer holds
    for parts, ids, why in ((made, "01234", []), ([*made[:2], bytes(wrong), *made[3:]], "0134", ["digest"]), ([b"junk", *made], "01234", None)):
        data = zipped(b"".join(parts))
        records, gaps = read(data + member(9, b"after"))
        if why is None:  # what begins with junk is no archive
            assert [x.headers["x-page-id"] for x in records] == ["9"] and gaps == [(0, len(data), "version line")]
        else:
            assert [x.headers["x-page-id"] for x in records] == [*ids, "9"] and [x[2] for x in gaps] == why
            assert {(x.begin, x.end) for x in records[:-1]} == {(0, len(data))} and all(x[:2] == (0, len(data)) for x in gaps)
    data = zipped(b"".join(made))
    records, gaps = read(data[: len(data) - 12])  # cut off within the last record or after it
    ids = [x.headers["x-page-id"] for x in records]
    assert ids == list("0123")[: len(ids)] and len(ids) >= 3 and [x[2] for x in gaps] == ["cut off"]
    damaged = bytearray(data)
    damaged[-3] ^= 1
    records, gaps = read(bytes(damaged) + member(9, b"after"))
    assert [x.headers["x-page-id"] for x in records] == ["9"] and gaps[0][:2] == (0, len(data))


@pytest.mark.parametrize("pack", [zipped, bytes])
def test_salvage_reads_what_other_writers_make(pack):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nbody"
    sha1 = hashlib.sha1(b"body").digest()
    good = [
        record("warcinfo", b"software: x\r\n", "0.18"), record("response", http, "0.17"), record("response", b"20240101\nexample.org. 60 IN A 1.2.3.4\n", "1.1", Content_Type="text/dns", WARC_Payload_Digest="sha1:" + warc.sha1_base32(b"20240101\nexample.org. 60 IN A 1.2.3.4\n")),
        record("response", http, WARC_Payload_Digest="sha1:" + sha1.hex()), record("response", http, WARC_Payload_Digest="sha256:" + base64.b32encode(hashlib.sha256(b"body").digest()).decode()), record("response", http, WARC_Payload_Digest="md5:" + hashlib.md5(b"body").hexdigest()),
        record("response", http, WARC_Payload_Digest="blake3:unknown"), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", WARC_Profile="p", WARC_Payload_Digest="sha1:other", WARC_Block_Digest="sha1:" + warc.sha1_base32(b"HTTP/1.1 304 Not Modified\r\n\r\n")),
        record("revisit", b"", WARC_Profile="p"), record("metadata", b"a: b", X_Folded="one\r\n two"),
    ]
    records, gaps = read(b"".join(map(pack, good)))
    assert len(records) == len(good) and not gaps
    assert records[1].digest == base64.b32encode(sha1).decode() and records[1].size == 4 and records[2].payload.startswith(b"2024") and records[10].headers["x-folded"] == "one two"
    bad = [record("response", http, WARC_Payload_Digest="sha1:" + "A" * 32), record("revisit", b""), record("response", http, WARC_Block_Digest="md5:00"), record("response", b"HTTP/1.1 200 OK\r\nno end"), record("response", http).replace(b"Content-Length: ", b"Content-Length: 9"), record("response", http).replace(b"Content-Length: ", b"Content-Length: x")]
    for x in bad:
        records, gaps = read(pack(x) + pack(good[1]))
        assert len(records) == 1 and [g[:2] for g in gaps] == [(0, len(pack(x)))], x


def test_warc_pages_without_id_and_with_two_payloads(spark):
    pages = spark.createDataFrame([(None, "u", "a"), (3, "u", "a"), (3, "u", "b"), (4, "u", "b"), (3, "u", "a"), (None, "u", "c")], "page_id long, url string, html string")
    rows = warc.read_warc(warc.write_warc(pages, shared_folder(spark))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == [(0, "response", 0), (0, "revisit", 3), (3, "response", 0), (3, "response", 0), (3, "response", 0), (4, "revisit", 3)]


@pytest.mark.parametrize("packed", [True, False])
def test_warc_round_trip(spark, packed):
    html = ["<p>é</p>", "<p>é</p>", None, "", "x" * 300_000, "\r\n\r\nWARC/1.1\r\n", "<p>é</p>"]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i}\n", h, 7) for i, h in enumerate(html)], "page_id long, url string, html string, hash int")
    manifest = warc.write_warc(pages, shared_folder(spark), gzip=packed)
    rows = {r.page_id: r for r in warc.read_warc(manifest, payloads=True).collect()}
    for i, h in enumerate(html):
        data, r = (h or "").encode(), rows[i]
        assert r.problem is None and r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("revisit", 0) if i in (1, 6) else ("revisit", 2) if i == 3 else ("response", None))
        assert r.payload == (data if r.record_type == "response" else b"")
    least = {r.page_id: r.record_type for r in warc.read_warc(warc.write_warc(pages, shared_folder(spark), least=5)).collect()}
    assert least[3] == "response" and least[6] == "revisit"
    assert warc.read_warc(warc.write_warc(pages.filter("false"), shared_folder(spark))).collect() == []


def test_files_are_never_named_twice(tmp_path):
    names = {files.new_name(str(tmp_path), 1, ".rec") for _ in range(50)}
    assert len(names) == 50


@pytest.mark.parametrize("pack", [zipped, bytes])
def test_salvage_takes_time_in_proportion_to_size_however_many_lengths_are_false(pack):
    import time

    took = {}
    for n in (2000, 8000):
        made = [warc.build(i, None, b"p%d " % i + b"x" * 700, None, "2024-01-01T00:00:00Z") for i in range(n)]
        for i in range(0, n, 2):
            made[i] = made[i].replace(b"Content-Length: 7", b"Content-Length: 99999" if i % 4 else b"Content-Length: 17", 1).replace(b"\r\nContent-Length: 8", b"\r\nContent-Length: 99998")
        data = pack(b"".join(made))
        began = time.process_time()
        records, gaps = read(data)
        took[n] = time.process_time() - began
        ids = {x.headers["x-page-id"] for x in records}
        assert {str(i) for i in range(1, n, 2)} <= ids and gaps
    assert took[8000] < 8 * took[2000] + 0.5, took


@pytest.mark.parametrize("pack", [zipped, bytes])
def test_heads_of_any_length_are_read(pack):
    http = b"HTTP/1.1 200 OK\r\nX-Long: " + b"y" * (2 << 20) + b"\r\n\r\nbody"
    good = [record("response", http, X_Long="z" * (3 << 20), WARC_Payload_Digest="sha1:" + warc.sha1_base32(b"body")), record("metadata", b"a: b")]
    records, gaps = read(b"".join(map(pack, good)))
    assert len(records) == 2 and not gaps and records[0].size == 4 and len(records[0].headers["x-long"]) == 3 << 20
    without_end = b"WARC/1.1\r\nWARC-Type: response\r\nX: " + b"q" * 5000 + b"\r\n"
    records, gaps = read(pack(without_end + good[1]))
    assert len(records) == 1 and len(gaps) == 1


def test_records_of_null_and_repeated_ids(spark):
    frame = spark.createDataFrame([(5, "b c", 1), (None, "x", 1), (5, "a", 1), (None, None, 1), (-(1 << 63), "y z", 1), (5, "a", 1)], "doc_id long, text string, mark int")
    got = []
    for x in (frame, frame.repartition(3)):
        manifest = records.write_records(x, shared_folder(spark), VOCABULARY)
        rows = records.read_records(manifest).sort("start").collect()
        got.append([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows])
    assert got[0] == got[1] and [r[0] for r in got[0]] == [None, None, -(1 << 63), 5, 5, 5]
    assert [r[1] for r in got[0]] == [sum(y[2] for y in got[0][:i]) for i in range(6)]
    at = records.read_at(rows[0].path, [r.nth for r in rows if r.path == rows[0].path])
    assert at[0][0] is None
    made = packing.pack(frame, VOCABULARY).collect()
    assert sum(r.length for r in made if r.doc_id is None) == 3 and sum(r.start == 0 for r in made) == 6
