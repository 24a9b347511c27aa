"""Token ids in length-delimited binary files, with a separate index of offsets for shuffled reads.

A record: length of the payload (u64), masked checksum of those 8 bytes (u32), payload, masked checksum of the payload (u32).
A payload: doc_id (i64), bytes per id (u8: 2 where every id of the vocabulary fits, else 4; 128 more where doc_id is null, and 0 stands for it), the
ids. All little-endian. The index has for each record: doc_id (i64), offset in the file (u64), number of ids (u32), 1 for a null doc_id (u8). The checksum is CRC-32, masked
as ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2^32, so that a checksum of bytes that hold checksums stays sound.

Edge cases: null and empty texts give the end id alone. Rows with a null id come first, rows that share an id in the order of a hash of
their texts, then of the texts; repeated rows are written one after the other. Documents of any length
are one record. Extra columns are not read. An empty table writes no record and reads back none.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.llm import files
from foliate.llm.common import cut
from foliate.llm.tokens import AT_ONCE, encoder
from foliate.llm.wordhash import slices

#: Bytes of text that are encoded at once: more than elsewhere, as equal units are then looked up less often and no other arrays lie beside.
SLICE = 2 * AT_ONCE
HEAD, INDEX, NULL = struct.Struct("<QI"), struct.Struct("<qQIB"), 0x80


def index_entry(doc_id: int | None, at: int, n: int) -> bytes:
    return INDEX.pack(doc_id or 0, at, n, doc_id is None)


class Damaged(ValueError):
    """A record whose checksum does not hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_record(source) -> bytes | None:
    """The payload at the place where the file stands; None at its end."""
    head = source.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size or masked(head[:8]) != HEAD.unpack(head)[1]:
        raise Damaged("length")
    size = HEAD.unpack(head)[0]
    body = source.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise Damaged("payload")
    return body[:size]


def pack_payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    return struct.pack("<qB", doc_id or 0, ids.itemsize | NULL * (doc_id is None)) + ids.tobytes()


def unpack(payload: bytes) -> tuple[int | None, bytes]:
    """doc_id and the ids as unsigned 32-bit integers."""
    doc_id, width = struct.unpack_from("<qB", payload)
    doc_id, width = None if width & NULL else doc_id, width & ~NULL
    return doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4").tobytes()


def read_at(uri: str, nth: list[int]) -> list[tuple[int | None, bytes]]:
    """Records by their number in the file, in the order asked for, through its index."""
    index, _ = files.read_from(uri + ".idx")
    source, _ = files.read_from(uri)
    out = []
    for i in nth:
        index.seek(i * INDEX.size)
        source.seek(INDEX.unpack(index.read(INDEX.size))[1])
        out.append(unpack(read_record(source)))
    return out


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write docs(doc_id, text) in ascending doc_id order; the manifest: part, path, records, tokens, first (ids before it).

    The texts are dealt by ranges of doc_id (and a hash of the text, as an id may have many), so the only sort is within a task, and the parts' numbers follow the ids.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, end = TaskContext.get().partitionId(), encoder(vocabulary), np.array([end_id], "<u4")
        width = 2 if encode.model.get_vocab_size() <= 1 << 16 else 4
        path, at, records, tokens = files.new_name(folder, part, ".rec"), 0, 0, 0
        with files.create(path) as out, files.create(path + ".idx") as index:
            for batch in batches:
                for low, high in slices(batch.column(1), SLICE):
                    ids, counts = encode.ids(batch.column(1)[low:high])
                    place = 0
                    for key, count in zip(batch.column(0)[low:high].to_pylist(), counts.tolist()):
                        own = np.concatenate([ids[place : place + count], end])
                        place += count
                        record = frame(pack_payload(key, own.astype(f"<u{width}")))
                        out.write(record)
                        index.write(index_entry(key, at, len(own)))
                        at, records, tokens = at + len(record), records + 1, tokens + len(own)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "records": pa.array([records], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    by = [F.asc_nulls_first("doc_id"), "mark"]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).repartitionByRange(*by).sortWithinPartitions(*by, "text").select("doc_id", "text")
    manifest = cut(ordered.mapInArrow(write, "part int, path string, records long, tokens long"))
    return manifest.withColumn("first", F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def read_records(manifest: DataFrame, at_once: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, path, nth of every record in the manifest's files; every checksum is verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                source, _ = files.read_from(path)
                rows: list[tuple] = []
                nth = 0
                while (payload := read_record(source)) is not None:
                    doc_id, ids = unpack(payload)
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), path, nth))
                    start, nth = start + len(ids) // 4, nth + 1
                    if len(rows) == at_once:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 4 else pa.int64()) for i, x in enumerate(zip(*rows))], names=["doc_id", "start", "n_tokens", "ids_crc32", "path", "nth"])

    n = max(1, manifest.count())  # one row for each file
    return manifest.filter("records > 0").select("path", "first").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, nth long")
