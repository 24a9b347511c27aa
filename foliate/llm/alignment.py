"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and links that many documents have.

Interval coalescing: the tokens of both are sorted by where they start, with the running maximum of where they end; a group breaks where a start
reaches that maximum. In a group each A token is linked with each B token. A is a byte-level BPE, B a piece model with byte fallback that puts a space
before a text; both see the text with that space, and special tokens' strings are plain text. Texts are taken in slices of about a megabyte.

A document's links are kept as distinct id pairs with how often each occurs. Documents lie in chunks of some megabytes; a chunk asks for each of its pairs
once, with how many of its documents hold it, so that a pair that all documents have is a row for each chunk and no more.

Edge cases: null and empty texts, and texts whose joined A or B bytes are not the text's (a text that holds U+2581, say), have no tokens: zeros
and an empty digest. Repeated rows, and rows that share an id or have none, each count as a document. A text of any length is aligned whole, in a slice of its own; a
group in which the two never meet gives its distinct id pairs with products of counts, not a pair for each two places. Extra columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import cut
from foliate.llm.tokens import AT_ONCE, LONGEST, REMEMBERED, encoder
from foliate.llm.wordhash import Bytes, raw, slices

#: Bytes of text that make a chunk.
CHUNK_BYTES = 16 << 20
#: Groups with more links than this go by distinct ids.
SMALL_GROUP = 256
#: Pairs of a chunk that are brought together at a time.
PAIRS_AT_ONCE = 4 << 20
SPACE = "▁"


def byte_level() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Table:
    """Things of different lengths in one array of bytes."""

    def __init__(self, values: list[bytes]):
        self.sizes = np.array([len(x) for x in values], np.int64)
        self.begin, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(values), np.uint8)

    def joined(self, which: np.ndarray) -> np.ndarray:
        sizes = self.sizes[which]
        until = np.cumsum(sizes)
        return self.data[np.repeat(self.begin[which] - (until - sizes), sizes) + np.arange(until[-1] if len(until) else 0)]


class Pieces:
    """Ids of texts that begin with a space by a piece model that puts one there itself.

    No piece of such a model has a space after another character, and none a line break, so a text may be cut before a run of spaces and before a line break
    that follows none; a model for which this does not hold encodes texts whole. Equal units are found by hash and compared byte by byte.
    """

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = Table([bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)])
        self.cuts = not any(SPACE in x.lstrip(SPACE) or "\n" in x for x in names) and self.model.encode("\n") == [self.model.piece_to_id(SPACE), self.model.piece_to_id("<0x0A>")]
        self.space = self.model.piece_to_id(SPACE)
        self.known: dict[bytes, bytes] = {}

    def _of(self, units: list[bytes]) -> list[bytes]:
        wanted = [x for x in units if x not in self.known]
        own = {b" ": np.array([self.space], "<u4").tobytes()} if self.cuts else {}
        for at in range(0, len(wanted), 1000):
            some = wanted[at : at + 1000]
            made = self.model.encode([(x if x[:1] == b"\n" else x[1:]).decode() for x in some], num_threads=1)
            for unit, ids in zip(some, made):
                if unit not in own:
                    own[unit] = np.array(ids[1:] if unit[:1] == b"\n" else ids, "<u4").tobytes()  # the space before a line break is not the text's
        found = [own[x] if x in own else self.known[x] for x in units]
        if len(self.known) > REMEMBERED:
            self.known = {}
        self.known.update((k, v) for k, v in own.items() if len(k) <= LONGEST)
        return found

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that begin with a space, in order, and how many each has."""
        data, ends = raw(column)
        begins = np.zeros(len(data), bool)
        if self.cuts and len(data):
            space, line = data == 0x20, data == 0x0A
            begins[1:] = (space | line)[1:] & ~space[:-1]
        begins[ends[:-1]] = True
        begin = np.flatnonzero(begins)
        units = Bytes(data, begin, np.append(begin[1:], len(data)))
        _, first, which = np.unique(units.hashes(), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~units.equal(first[which]))
        which[odd], first = len(first) + np.arange(len(odd)), np.concatenate([first, odd])
        whole = data.tobytes()
        found = Table(self._of([whole[a : a + n] for a, n in zip(begin[first].tolist(), units.sizes[first].tolist())]))
        counts = np.concatenate([[0], np.cumsum(found.sizes[which] // 4)])
        return found.joined(which).view("<u4"), np.diff(counts[np.searchsorted(begin, ends)])


class Aligner:
    """Both tokenizers in a worker."""

    def __init__(self, vocabulary: str, pieces: str):
        self.a, self.b = encoder(vocabulary, plain=True), Pieces(pieces)
        letters, of_id = byte_level(), dict.fromkeys(range(self.a.model.get_vocab_size()), b"")
        for token, i in self.a.model.get_vocab().items():
            of_id[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a_bytes, self.b_bytes = Table(list(of_id.values())), self.b.bytes
        self.span, self.base = len(of_id) * len(self.b_bytes.sizes), len(self.b_bytes.sizes)
        self.decimal = Table([str(i).encode() for i in range(max(len(of_id), self.base))])

    def tokens(self, texts: pa.Array):
        """Ids and counts of texts that begin with a space, by A and B; texts that either does not give back have none."""
        data, ends = raw(texts)
        made = [[*coder.ids(texts), of] for coder, of in ((self.a, self.a_bytes), (self.b, self.b_bytes))]
        right = np.ones(len(texts), bool)
        for ids, counts, of in made:
            joined = of.joined(ids)
            if not np.array_equal(joined, data):
                until = np.concatenate([[0], np.cumsum(of.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
                right &= [np.array_equal(joined[i:j], data[k:m]) for i, j, k, m in zip(until[:-1], until[1:], ends[:-1], ends[1:])]
        return [(ids[np.repeat(right, counts)], np.where(right, counts, 0)) for ids, counts, _ in made]

    def align(self, texts: pa.Array) -> list[tuple[int, int, int, int, str, bytes, bytes]]:
        """Of texts that are neither null nor empty: n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs (a x base + b) and how often each is linked."""
        (a, of_a), (b, of_b) = self.tokens(pc.binary_join_element_wise(" ", texts, ""))
        n, none = len(texts), (0, 0, 0, 0, "", b"", b"")
        if not len(a):
            return [none] * n
        size_a, size_b = self.a_bytes.sizes[a], self.b_bytes.sizes[b]
        ends = np.concatenate([np.cumsum(size_a), np.cumsum(size_b)])
        starts = ends - np.concatenate([size_a, size_b])
        order = np.lexsort((starts,))
        breaks = np.ones(len(order), bool)
        breaks[1:] = starts[order[1:]] >= np.maximum.accumulate(ends[order])[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(breaks) - 1
        in_a, in_b = group[: len(a)], group[len(a) :]
        per_a, per_b = np.bincount(in_a), np.bincount(in_b)
        first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        text_of = np.repeat(np.arange(n), of_a)[first_a]
        links = per_a * per_b
        pair, times = self._pairs(a, b, first_a, first_b, per_a, per_b, text_of)
        at = np.searchsorted(pair, np.arange(n + 1) * self.span)
        pair = (pair % self.span).astype("<u4" if self.span <= 1 << 32 else "<u8")
        digests = self._digests(a, b, in_a, in_b, first_a, first_b, per_a, per_b, text_of, n)
        groups, sums = np.bincount(text_of, minlength=n), np.concatenate([[0], np.cumsum(links)])
        until = np.concatenate([[0], np.cumsum(groups)])
        n_links = sums[until[1:]] - sums[until[:-1]]
        return [(*numbers, digests[i], pair[at[i] : at[i + 1]].tobytes(), times[at[i] : at[i + 1]].tobytes()) if numbers[0] else none for i, numbers in enumerate(zip(of_a.tolist(), of_b.tolist(), groups.tolist(), n_links.tolist()))]

    def _pairs(self, a, b, first_a, first_b, per_a, per_b, text_of) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct text x span + pair, and how many links each stands for."""
        links = per_a * per_b
        few = np.flatnonzero(links <= SMALL_GROUP)
        counts = links[few]
        of = np.repeat(few, counts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        keys = text_of[of] * self.span + a[first_a[of] + nth // per_b[of]].astype(np.int64) * self.base + b[first_b[of] + nth % per_b[of]]
        keys, times = np.unique(keys, return_counts=True)
        found, counted = [keys], [times]
        for g in np.flatnonzero(links > SMALL_GROUP).tolist():
            own_a, n_a = np.unique(a[first_a[g] : first_a[g] + per_a[g]], return_counts=True)
            own_b, n_b = np.unique(b[first_b[g] : first_b[g] + per_b[g]], return_counts=True)
            found.append((text_of[g] * self.span + own_a.astype(np.int64)[:, None] * self.base + own_b[None, :]).ravel())
            counted.append((n_a[:, None] * n_b[None, :]).ravel())
        if len(found) > 1:
            keys, place = np.unique(np.concatenate(found), return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, place, np.concatenate(counted))
        return keys, times.astype("<i8")

    def _digests(self, a, b, in_a, in_b, first_a, first_b, per_a, per_b, text_of, n: int) -> list[str]:
        """SHA-256 of each text's groups, written as a1,a2|b1;a3|b2,b3."""
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        at_a, at_b = np.arange(len(a)) + first_b[in_a], np.arange(len(b)) + (first_a + per_a)[in_b]
        ids[at_a], ids[at_b] = a, b
        mark[at_a[first_a + per_a - 1]] = ord("|")
        last = at_b[first_b + per_b - 1]
        mark[last] = ord(";")
        sizes = self.decimal.sizes[ids] + 1
        until = np.cumsum(sizes)
        text = np.empty(until[-1], np.uint8)
        digits = np.ones(len(text), bool)
        digits[until - 1] = False
        text[digits], text[until - 1] = self.decimal.joined(ids), mark
        groups = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=n))])
        ends = np.concatenate([[0], until[last]])[groups].tolist()
        whole = memoryview(text)
        return [hashlib.sha256(whole[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends[:-1], ends[1:])]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(*paths: str) -> Aligner:
    """One for each worker process and pair of vocabularies."""
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


ROWS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def alignments(docs: DataFrame, vocabulary: str, pieces: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A written row for each row of docs(doc_id, text): chunk, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, chunk, held = aligner(vocabulary, pieces), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for low, high in slices(batch.column(1), AT_ONCE):
                text = batch.column(1)[low:high]
                some = pc.fill_null(pc.greater(pc.binary_length(text), 0), False)
                found = iter(both.align(text.filter(some)))
                rows = [next(found) if x else (0, 0, 0, 0, "", b"", b"") for x in some.to_pylist()]
                columns = [[chunk] * len(rows), batch.column(0)[low:high], *zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, ROWS)], schema=ROWS)
                held += int(raw(text)[1][-1])
                if held >= chunk_bytes:
                    chunk, held = chunk + 1, 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(rows.mapInArrow(made, "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"))


def together(blobs: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind)


def asked_by_chunk(rows: DataFrame, kind: str) -> DataFrame:
    """chunk, pair, n: each pair of a chunk, with how many of its documents hold it (in parts, where tasks share a chunk)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(chunk: int) -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate([x for x, _ in held[chunk]]), return_inverse=True)
            n = np.bincount(n, np.concatenate([y for _, y in held.pop(chunk)])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), chunk)), pa.array(pair), pa.array(n)], names=["chunk", "pair", "n"])

        for batch in batches:
            of = batch.column(0).to_numpy()
            for chunk in np.unique(of).tolist():
                pair, n = np.unique(together(batch.column(1).filter(pa.array(of == chunk)), kind).astype(np.int64), return_counts=True)
                if len(pair):
                    held.setdefault(chunk, []).append((pair, n))
            for chunk in [x for x, y in held.items() if x != of[-1] or sum(len(z) for z, _ in y) > PAIRS_AT_ONCE]:
                yield out(chunk)
        for chunk in list(held):
            yield out(chunk)

    return rows.select("chunk", "pairs").mapInArrow(ask, "chunk long, pair long, n long")


def link_counts(asked: DataFrame, base: int) -> DataFrame:
    """pair, a_id, b_id, docs (documents that hold the pair linked), best (no other pair of this A id has more)."""
    counts = cut(asked.groupBy("pair").agg(F.sum("n").alias("docs")))
    ids = counts.select("*", F.expr(f"pair div {base}L").alias("a_id"), (F.col("pair") % base).alias("b_id"))
    most = ids.groupBy("a_id").agg(F.max("docs").alias("most"))  # a row for each id of A's vocabulary at most
    return ids.join(F.broadcast(most), "a_id").select("pair", "a_id", "b_id", "docs", (F.col("docs") == F.col("most")).alias("best"))


OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align(docs: DataFrame, vocabulary: str, pieces: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    both = aligner(vocabulary, pieces)
    kind, base = "<u4" if both.span <= 1 << 32 else "<u8", both.base
    rows = alignments(docs, vocabulary, pieces, chunk_bytes)
    asked = cut(asked_by_chunk(rows, kind))
    answers = asked.select("chunk", "pair").join(link_counts(asked, base).select("pair", "docs", "best"), "pair").select("chunk", "pair", "docs", "best")

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        pair, docs, best = (right.column(c).to_numpy() for c in ("pair", "docs", "best"))
        order = np.argsort(pair)
        own, times = together(left.column("pairs"), kind).astype(np.int64), together(left.column("times"), "<i8")
        place = order[np.searchsorted(pair, own, sorter=order)] if len(own) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(left.column("times")).to_numpy() // 8)])
        sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[place])])[ends]) for x in (best.astype(np.int64), docs.astype(np.int64))]
        left = left.append_column("n_best", pa.array(sums[0].astype(np.int64))).append_column("count_sum", pa.array(sums[1].astype(np.int64)))
        return left.select(OUT)

    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(fold, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
