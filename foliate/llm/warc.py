"""WARC 1.1 archives: written from pages with revisit records for repeated payloads, and read back by a salvage reader.

After a record that fails a check (compression, version line, headers, lengths, digests of payload and block, what a revisit must name), the reader
searches for the next place where a whole record passes, goes on from there, and logs the bytes between as a quarantined gap. A gzip member may hold
one record or many; within a sound member the search goes on at the next version line. Of a member that is cut off, the records that lie wholly
before the cut are read; of one that is damaged, none, as any of its bytes may be wrong. Places are those of the member in the file. Records of all
versions of the format are read, responses without HTTP head (of other protocols) as well; their payload is the whole block.

Blocks are read in pieces: a record's payload is held only where payloads are asked for, however large the record. Heads may have any length. Whether a record can
end where its length says is looked up before its block is read (in a member: among all places where one can, found in one more pass at the first
failure), so the time grows with the archive, not with the number of false lengths in it. A false length that leads to another record's very end is
found out by the digest, after as many bytes.

Edge cases: a null html is an empty payload; a null url leaves the target header out, line breaks in it are escaped; a null page_id leaves its header out
and is read back as null (with the payload of another page it is a revisit). Rows that
repeat a page with the same payload are all responses if the page is the smallest of its payload, all revisits if not; a page with two payloads is
written once for each. Very long pages are one record. Extra columns are not read. An empty table writes and reads nothing.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm import files
from foliate.llm.common import cut

#: Fixed values of the file formats.
VERSION, MAGIC, END = b"WARC/1.1", b"\x1f\x8b\x08", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_VERSION_WITHIN = re.compile(rb"\r\nWARC/\d+\.\d+\r\n")
_CLOSING = re.compile(rb"(?=\r\n\r\n)")
_MARK = b"WARC/"
CHUNK = 1 << 14
#: Bytes of a member that are kept for reading after its check.
KEPT = 1 << 20


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record. refers_to: the page whose response has this payload, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


@dataclass
class Record:
    begin: int
    end: int
    headers: dict[str, str]
    http: bytes
    size: int  # of the payload
    digest: str  # of the payload, SHA-1 in base 32
    payload: bytes  # where it was asked for


class Bad(ValueError):
    """A check that a record fails."""


class Member:
    """The decompressed bytes of the gzip member at a place of a file, in pieces."""

    def __init__(self, source, at: int):
        self.source, self.at, self.place, self.state, self.held, self.passed, self.closings = source, at, at, zlib.decompressobj(31), b"", 0, None
        source.seek(at)

    def more(self) -> bool:
        """Hold some more bytes; False at the member's end, where zlib has checked its CRC and length."""
        data = self.state.unconsumed_tail
        if self.state.eof:
            return False
        if not data:
            data = self.source.read(CHUNK)
            self.place += len(data)
            if not data:
                raise Bad("cut off")
        try:
            self.held += self.state.decompress(data, 1 << 18)
        except zlib.error as error:
            raise Bad(str(error)) from None
        return True

    def end(self) -> int:
        return self.place - len(self.state.unused_data)

    def mark(self) -> tuple:
        """Where the stream stands, for `back`: the state of a decompressor is some 40 KB."""
        return self.place, self.state.copy(), self.held, self.passed

    def back(self, mark: tuple) -> None:
        self.place, state, self.held, self.passed = mark
        self.state = state.copy()
        self.source.seek(self.place)

    def closes(self, n: int) -> bool:
        """May a record end n bytes on? Not known before `look_ahead`."""
        if self.closings is None:
            return True
        place = self.passed + n
        at = np.searchsorted(self.closings, place)
        return at < len(self.closings) and self.closings[at] == place

    def look_ahead(self) -> bool:
        """Find all places where a record may end, once and for all, so that no false length makes the member be read again. False if that was done."""
        if self.closings is not None:
            return False
        other, found, tail = Member(self.source, self.at), [np.zeros(0, np.int64)], b""
        with contextlib.suppress(Bad):  # cut off
            while data := other.read(1 << 18):
                seen, base = tail + data, other.passed - len(data) - len(tail)
                found.append(np.array([base + m.start() for m in _CLOSING.finditer(seen)], np.int64))
                tail = seen[-len(END) + 1 :]
        self.closings = np.concatenate(found)
        self.source.seek(self.place)
        return True

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        return self.held[:n]

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self.held, self.passed = self.held[len(out) :], self.passed + len(out)
        return out


class Plain:
    """The bytes of a file from a place, in pieces."""

    def __init__(self, source, at: int, size: int):
        self.source, self.at, self.size, self.passed = source, at, size, 0

    def mark(self) -> int:
        return self.passed

    def back(self, mark: int) -> None:
        self.passed = mark

    def closes(self, n: int) -> bool:
        """Does a record end n bytes on?"""
        place = self.at + self.passed + n
        if place + len(END) > self.size:
            return False
        self.source.seek(place)
        return self.source.read(len(END)) == END

    def look_ahead(self) -> bool:
        return False

    def peek(self, n: int) -> bytes:
        self.source.seek(self.at + self.passed)
        return self.source.read(n)

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self.passed += len(out)
        return out


def until(stream, mark: bytes, why: str, most: int | None = None, alone: bool = False) -> bytes:
    """What stands before a mark that follows (within `most` bytes); both are passed. alone: no version line may come before it."""
    n, before = 1 << 10, 0
    while True:
        n = n if most is None else min(most, n)
        seen = stream.peek(n)
        found = seen.find(mark, max(0, before - len(mark)))
        if alone and (other := _VERSION_WITHIN.search(seen, max(0, before - 32))) and (found < 0 or other.start() < found):
            raise Bad(why)
        if found >= 0:
            return stream.read(found + len(mark))[:found]
        if len(seen) < n or n == most:
            raise Bad(why)
        n, before = n * 4, n


def matches(digest: str, made: dict[str, bytes]) -> bool:
    """Does a digest header agree with what was computed, in base 32 or 16? One by another algorithm can't be checked."""
    name, _, value = digest.partition(":")
    own = made.get(name.lower().replace("-", ""))
    return own is None or value.strip().lower().rstrip("=") in (base64.b32encode(own).decode().lower().rstrip("="), own.hex())


def pieces(stream, n: int) -> Iterator[bytes]:
    while n:
        data = stream.read(min(n, 1 << 16))
        if not data:
            raise Bad("length")
        n -= len(data)
        yield data


#: Digests that can be checked.
ALGORITHMS = {"sha1", "sha256", "md5"}


def parse(stream, payloads: bool) -> Record:
    """The record at a stream's place, with its closing line breaks; begin and end are the caller's."""
    if not _VERSION_LINE.match(stream.peek(16)):
        raise Bad("version line")
    lines = re.sub(r"\r\n[ \t]+", " ", until(stream, END, "headers", alone=True).decode("utf-8", "replace")).split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size, kind = headers.get("content-length", ""), headers.get("warc-type")
    if not size.isascii() or not size.isdigit() or len(size) > 18 or not stream.closes(int(size)):
        raise Bad("length")
    left, http, kept = int(size), b"", []
    need = ALGORITHMS & {headers.get(k, "").partition(":")[0].lower().replace("-", "") for k in ("warc-block-digest", "warc-payload-digest")}
    block, payload = ({name: hashlib.new(name) for name in {"sha1", *need}} for _ in range(2))
    if kind in ("response", "revisit") and stream.peek(5) == b"HTTP/" and left >= 5:
        before = stream.passed
        try:
            whole = (http := until(stream, END, "HTTP head", left)) + END
        except Bad:
            if kind == "response":
                raise
            whole = http = stream.read(left)
        left -= stream.passed - before
        for h in block.values():
            h.update(whole)
    n = left
    for data in pieces(stream, left):
        for h in (*block.values(), *payload.values()):
            h.update(data)
        if payloads:
            kept.append(data)
    if stream.read(len(END)) != END:
        raise Bad("length")
    done = {k: h.digest() for k, h in payload.items()}
    if not matches(headers.get("warc-block-digest", ""), {k: h.digest() for k, h in block.items()}):
        raise Bad("digest")
    if kind == "revisit":
        if "warc-profile" not in headers:
            raise Bad("revisit")
    elif not re.search(rb"(?i)\r\n(?:transfer|content)-encoding:", http) and not matches(headers.get("warc-payload-digest", ""), done):
        raise Bad("digest")
    return Record(0, 0, headers, http, n, base64.b32encode(done["sha1"]).decode(), b"".join(kept))


def search(source, at: int, size: int, mark: bytes) -> int:
    """The next place of a mark, or the end."""
    tail = b""
    while at < size:
        source.seek(at)
        chunk = tail + source.read(CHUNK)
        if (found := chunk.find(mark)) >= 0:
            return at - len(tail) + found
        at, tail = at + len(chunk) - len(tail), chunk[-len(mark) + 1 :]
    return size


def checked(source, at: int) -> tuple[int | None, bytes | None]:
    """Where a sound member ends (None if it is cut off), and its bytes if they are few. A first look rules out what is no archive."""
    probe = Member(source, at)
    try:
        if not probe.peek(len(_MARK)).startswith(_MARK):
            raise Bad("version line")
        few = []
        while data := probe.read(1 << 16):
            few.append(data) if few is not None else None
            if few is not None and probe.passed > KEPT:
                few = None
        return probe.end(), b"".join(few) if few is not None else None
    except Bad as why:
        if str(why) == "cut off":
            return None, None
        raise


class Held(Plain):
    """Bytes in memory as a stream."""

    def __init__(self, data: bytes):
        super().__init__(io.BytesIO(data), 0, len(data))


def in_member(source, at: int, size: int, payloads: bool) -> Iterator[Record | tuple[int, int, str]]:
    """The records of a member and a gap for what is wrong in it; Bad if it is no sound member or has no record."""
    end, data = checked(source, at)
    stream = Held(data) if data is not None else Member(source, at)
    stop, wrong, some = size if end is None else end, None, False
    while True:
        start, mark = stream.passed, None
        try:
            mark = stream.mark()
            if not stream.peek(1):
                break
            found = parse(stream, payloads)
            if end is None and not stream.peek(1):
                raise Bad("cut off")
            found.begin, found.end, some = at, stop, True
            yield found
        except Bad as why:
            wrong = wrong or str(why)
            again = stream.look_ahead()  # the same record once more, as all false lengths are known now
            if str(why) == "cut off" and not again:
                break
            stream.back(mark)
            if not again and not onward(stream, start + 1):
                break
    if wrong and not some:
        raise Bad(wrong)
    if wrong:
        yield at, stop, wrong


def onward(stream, at: int) -> bool:
    """Pass on to the next version line from a place on; False if there is none."""
    try:
        while stream.passed < at:
            if not stream.read(min(at - stream.passed, 1 << 16)):
                return False
        while True:
            seen = stream.peek(CHUNK)
            found = seen.find(_MARK)
            if found >= 0:
                stream.read(found)
                return True
            if len(seen) < CHUNK:
                return False
            stream.read(len(seen) - len(_MARK) + 1)
    except Bad:
        return False


def salvage(source, size: int, payloads: bool = True) -> Iterator[Record | tuple[int, int, str]]:
    """Records in order; between them (begin, end, why) for bytes that belong to none."""
    source.seek(0)
    packed = source.read(len(MAGIC)) == MAGIC or search(source, 0, size, MAGIC) < search(source, 0, size, _MARK)
    mark, at, gap = (MAGIC if packed else _MARK), 0, None
    while at < size:
        try:
            if packed:
                for x in in_member(source, at, size, payloads):
                    if gap:
                        yield gap[0], at, gap[1]
                        gap = None
                    yield x
                    end = x[1] if isinstance(x, tuple) else x.end
            else:
                stream = Plain(source, at, size)
                x = parse(stream, payloads)
                x.begin, x.end = at, (end := at + stream.passed)
                if gap:
                    yield gap[0], at, gap[1]
                    gap = None
                yield x
        except Bad as why:
            gap = gap or (at, str(why))
            at = search(source, at + 1, size, mark)
            continue
        at = end
    if gap:
        yield gap[0], size, gap[1]


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """of_page, of_hash, refers_to (null for a response). Payloads of under `least` bytes are never revisits.

    Only hashes and ids are shuffled; the table of first pages has been cut, so a hash that many pages share can be split.
    """
    html = F.coalesce("html", F.lit(""))
    light = cut(pages.select("page_id", F.octet_length(html).alias("size"), F.unhex(F.sha2(html, 256)).alias("hash")).distinct())
    first = cut(light.filter(F.col("size") >= least).groupBy("hash").agg(F.min("page_id").alias("first")))
    joined = light.join(first, "hash", "left")
    again = (F.col("first") < F.col("page_id")) | F.col("page_id").isNull()
    return joined.select(F.col("page_id").alias("of_page"), F.col("hash").alias("of_hash"), F.when(again, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", gzip: bool = True, rotate_bytes: int = 256 << 20) -> DataFrame:
    """Archives of pages(page_id, url, html), one gzip member a record; the manifest: path, records."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("hash", F.unhex(F.sha2("html", 256)))
    rows = own.join(revisits(pages, least), F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("hash") == F.col("of_hash"))).select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, out = TaskContext.get().partitionId(), [], None
        for batch in batches:
            html = batch.column(2).cast(pa.binary())
            for page, url, payload, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), html, batch.column(3).to_pylist()):
                if out is None or out.tell() > rotate_bytes:
                    if out is not None:
                        out.close()
                    made.append([files.new_name(folder, part, ".warc.gz" if gzip else ".warc"), 0])
                    out = files.create(made[-1][0])
                data = build(page, url, payload.as_py(), refers_to, date)
                if gzip:
                    state = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = state.compress(data) + state.flush()
                out.write(data)
                made[-1][1] += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["path", "records"])

    return cut(rows.mapInArrow(write, "path string, records long"))


READ = "path string, begin long, end long, problem string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Records (problem null) and gaps (problem says why) of the archives named in manifest(path).

    A revisit has no payload of its own; its size is in its HTTP headers, its digest in its WARC headers.
    """
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, size = files.read_from(path)
                rows: list[tuple] = []
                held = 0
                for x in salvage(source, size, payloads):
                    if isinstance(x, tuple):
                        rows.append((path, x[0], x[1], x[2], *[None] * (6 + payloads)))
                    else:
                        rows.append(as_row(path, x))
                        held += len(x.payload)
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    def as_row(path: str, x: Record) -> tuple:
        h, kind = x.headers, x.headers.get("warc-type")
        size = x.size
        if kind == "revisit" and (found := re.search(rb"(?i)content-length:\s*(\d+)", x.http)):
            size = int(found[1])
        whole = lambda k: int(h[k]) if re.fullmatch(r"-?\d+", h.get(k, "")) else None
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or x.digest
        return (path, x.begin, x.end, None, whole("x-page-id"), h.get("warc-target-uri"), size, digest, kind, whole("x-refers-to-page-id"), *[x.payload] * payloads)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    n = max(1, manifest.count())  # one row for each archive
    return manifest.select("path").repartition(n).mapInArrow(read, READ + ", payload binary" * payloads)
