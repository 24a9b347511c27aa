"""Product codes of vectors, with Orchard's search for the nearest entry.

A vector is cut into equal parts, and each part gets the index of its codebook's nearest entry. Each entry keeps the others sorted by their distance from it.
A search starts at some entry and walks its list; an entry that is nearer becomes the current one, and the walk goes on in its list; entries that were
seen are marked; the walk ends where the list goes beyond twice the distance between the vector and the current entry, for no entry there can be nearer (or
as near). All is in integers, so ties are exact: they go to the lower index.

Rounds read the vectors where they lie: a task sends the sums of each entry's parts, never a vector, and the driver holds the codebooks alone.

Edge cases: rows without a whole vector, or of another length than most, are left out (see `integers`). Rows that share an id are coded each by
itself; the first codebook takes the smallest ids, null last, ties by the vector. Fewer rows than entries give smaller codebooks. Null labels are one label.
A length that the parts do not divide is an error. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import cut
from foliate.llm.integers import matrix, quantised

#: Vectors that are searched for at a time.
AT_ONCE = 1 << 14


class Book:
    """The entries of one part, each with the others in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries, n = entries, len(entries)
        gaps = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        np.fill_diagonal(gaps, -1)
        order = np.argsort(gaps, axis=1, kind="stable")
        end = np.full((n, 1), np.iinfo(np.int64).max)
        self.lists, self.gaps = np.hstack([order[:, 1:], order[:, :1]]), np.hstack([np.take_along_axis(gaps, order, 1)[:, 1:], end])
        self.by_first = np.argsort(entries[:, 0], kind="stable")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of x the entry and the squared distance; and how many distances were taken."""
        firsts = self.entries[self.by_first, 0]
        best = self.by_first[np.minimum(np.searchsorted(firsts, x[:, 0]), len(firsts) - 1)]
        gap = ((x - self.entries[best]) ** 2).sum(axis=1)
        live, at, seen, taken = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros((len(x), len(self.entries)), bool), len(x)
        seen[live, best] = True
        while len(live):
            on, place = best[live], at[live]
            near = self.gaps[on, place] <= 4 * gap[live]  # the lists hold squares; the end of a list is beyond all
            live, on, place = live[near], on[near], place[near]
            at[live] += 1
            entry = self.lists[on, place]
            new = ~seen[live, entry]
            own, entry = live[new], entry[new]
            seen[own, entry] = True
            d = ((x[own] - self.entries[entry]) ** 2).sum(axis=1)
            taken += len(own)
            better = (d < gap[own]) | ((d == gap[own]) & (entry < best[own]))
            own = own[better]
            best[own], gap[own], at[own] = entry[better], d[better], 0
        return best, gap, taken


def parts_of(column: pa.Array, parts: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Some rows at a time: where they begin, and rows x parts x width."""
    for at in range(0, len(column), AT_ONCE):
        some = column[at : at + AT_ONCE]
        yield at, matrix(some, parts * width).reshape(len(some), parts, width)


def sums(rows: DataFrame, books: np.ndarray) -> list:
    """What the parts of each entry sum up to: part, entry, place, n, total; as many rows as the codebooks have components."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, n, total = [Book(x) for x in books], np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, x in parts_of(batch.column(0), parts, width):
                for p, book in enumerate(made):
                    code = book.nearest(x[:, p])[0]
                    n[p] += np.bincount(code, minlength=entries)
                    for c in range(width):
                        total[p, :, c] += np.bincount(code, x[:, p, c], entries).astype(np.int64)  # below 2^24 times 2^14 rows: exact
        p, e, c = (x.ravel() for x in np.indices(books.shape))
        some = n[p, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (p, e, c, n[p, e], total[p, e, c])], names=["part", "entry", "place", "n", "total"])

    found = rows.select("v").mapInArrow(add, "part long, entry long, place long, n long, total long")
    return found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()


def fit(rows: DataFrame, length: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks, parts x entries x width, from rows(vec_id, v)."""
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        found, books = sums(rows, books), books.copy()
        for r in found:
            books[r.part, r.entry, r.place] = r.total // r.n  # Python's division goes down
    return books


def encode(rows: DataFrame, books: np.ndarray, *kept: str) -> DataFrame:
    """rows(v, ...): the columns kept, code, error. A code has two hexadecimal digits for each part."""
    parts, entries, width = books.shape
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Book(x) for x in books]
        for batch in batches:
            for at, x in parts_of(batch.column(len(kept)), parts, width):
                codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p, book in enumerate(made):
                    codes[:, p], gap, _ = book.nearest(x[:, p])
                    error += gap
                text, own = codes.tobytes().hex(), batch.slice(at, len(x))
                texts = pa.array([text[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(x))])
                yield pa.RecordBatch.from_arrays([*own.columns[: len(kept)], texts, pa.array(error)], names=[*kept, "code", "error"])

    return rows.select(*kept, "v").mapInArrow(code, f"{schema}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Every whole row of embeddings(vec_id, embedding, label): vec_id, label, code, error, label_error, codebooks_sha256."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits for each part, so 256 entries at most")
    rows, length = quantised(embeddings, "vec_id", "label")
    books = fit(rows, length, parts, entries, rounds) if length else np.zeros((parts, 1, 1), np.int64)
    coded = cut(encode(rows, books, "vec_id", "label"))
    totals = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
