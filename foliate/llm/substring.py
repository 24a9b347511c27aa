"""Substring deduplication: seed and extend over winnowed anchors.

Every run of `least` words contains a winnowed anchor, at the same place wherever the run occurs: of its shingles of least/2 words
the one with the smallest hash. Seeds are anchors that occur twice or more, found by joining the documents' distinct anchors. Each
occurrence of a seed is then extended both ways, by as many words as a run of `least` words with that anchor can reach; each
such run is looked up by a 128-bit hash of its words (two 64-bit hashes with seeds of their own), and its first occurrence owns it. What overlaps
joins up to maximal repeats.

Documents come in batches of bounded size, and a batch asks about each anchor and run once, however often it has it, so the
rows of a passage that a large part of all documents share stay few in each shard. The texts are dealt out once; the later steps
use the same exchange. A batch makes one row for each shard that it has keys for, so there are never more rows than distinct keys; there is
a shard for each SHARD_BATCHES batches.

Edge cases: null, empty and blank texts have no words. Shorter texts than `least` words have no run. Of rows that share an id, the one with the
smaller text (by its bytes, null last) counts as earlier; a null id counts as smaller than any other. Rows with a null id are dealt by their text, and
those of an earlier batch count as earlier; rows that share another id lie in one batch, and so does a text longer than a batch with what falls to it. Extra columns are not read. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import BATCH_BYTES, by_shard, in_batches, table_of, text_bytes
from foliate.llm.wordhash import Words, slices

ASK = "shard int, batch int, keys binary, docs binary, places binary"
ANSWER = "batch int, kind int, shard int, data binary"
RUN = np.dtype([("a", "<u8"), ("b", "<u8")])
SHARD_BATCHES = 1
#: In the order of documents a null id stands before all others.
NULL_ID = -(1 << 63)


def in_order(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Ids and texts of a batch, by id, then by text."""
    table = table.append_column("order", pc.fill_null(table.column("doc_id"), NULL_ID)).sort_by([("order", "ascending"), ("text", "ascending")])
    ids, text = (table.column(k).combine_chunks() for k in ("doc_id", "text"))
    return tuple(x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, text))


def anchor_of(w: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all runs of `least` words in one text, the place of each one's anchor, and all anchors' hashes."""
    n = least // 2
    grams, starts = w.grams(n), np.flatnonzero(w.fits(least))
    if not len(starts):
        return starts, starts, grams
    lowest = np.lib.stride_tricks.sliding_window_view(grams, least - n + 1).argmin(axis=1)
    return starts, starts + lowest[starts], grams


def packed(batch: int, shard_of: np.ndarray, keys: np.ndarray, docs: np.ndarray | None = None, places: np.ndarray | None = None) -> pa.Table:
    """One row for each shard that has keys, in the keys' order."""
    rows = [(i, batch, *[x[own].tobytes() if x is not None else b"" for x in (keys, docs, places)]) for i, own in by_shard(shard_of)]
    return table_of(rows, ["shard", "batch", "keys", "docs", "places"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])


ANSWER_NAMES, ANSWER_KINDS = ["batch", "kind", "shard", "data"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def blobs(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in table.column(name)]


def ask_anchors(table: pa.Table, shards: int, least: int) -> pa.Table:
    """The distinct anchors of a batch; places: 1 for those that it has at two places or more."""
    found = []
    _, text = in_order(table)
    for at, to in slices(text):
        starts, places, grams = anchor_of(Words(text[at:to]), least)
        found.append(grams[np.unique(places)])
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    return packed(table.column("batch")[0].as_py(), (keys % np.uint64(shards)).astype(np.int64), keys, None, (counts > 1).astype(np.uint8))


def answer_anchors(table: pa.Table) -> pa.Table:
    """To each batch, those of its anchors that occur twice or more anywhere."""
    keys, many = blobs(table, "keys", "<u8"), blobs(table, "places", np.uint8)
    distinct, counts = np.unique(np.concatenate(keys), return_counts=True)
    seeds = np.union1d(distinct[counts > 1], np.concatenate([k[m > 0] for k, m in zip(keys, many)]))
    batches, shard = table.column("batch").to_pylist(), table.column("shard")[0].as_py()
    rows = [(b, 1, shard, np.intersect1d(k, seeds, assume_unique=True).tobytes()) for b, k in zip(batches, keys)]
    return table_of([x for x in rows if x[3]], ANSWER_NAMES, ANSWER_KINDS)


class Runs:
    """The runs of a batch around its seeds, in the order of documents and places."""

    def __init__(self, ids: pa.Array, text: pa.Array, answers: pa.Table, least: int):
        kinds = answers.column("kind").to_pylist()
        seeds = [np.frombuffer(x.as_py(), "<u8") for x, k in zip(answers.column("data"), kinds) if k == 1]
        seeds = np.sort(np.concatenate(seeds)) if seeds else np.zeros(0, np.uint64)
        keys, docs, places, self.words, self.counts = [], [], [], [], []
        numbers, base = pc.fill_null(ids, NULL_ID).to_numpy(), 0
        for at, to in slices(text):
            w = Words(text[at:to])
            starts, anchors, grams = anchor_of(w, least)
            near = np.searchsorted(seeds, grams)
            near[near == len(seeds)] = 0
            seeded = seeds[near] == grams if len(seeds) else np.zeros(len(grams), bool)
            starts = starts[seeded[anchors]]
            run = np.empty(len(starts), RUN)
            run["a"], run["b"] = w.grams(least, 1)[starts], w.grams(least, 2)[starts]
            of = np.searchsorted(w.first, starts, "right") - 1
            keys.append(run)
            docs.append(numbers[at + of])
            places.append((starts - w.first[of]).astype(np.int64))
            self.words.append(base + starts)
            self.counts.append(w.counts)
            base += len(w.hashes)
        self.total = base
        self.keys, self.docs, self.places, self.words = (np.concatenate(x) for x in (keys, docs, places, self.words))
        self.counts = np.concatenate(self.counts)
        order = np.lexsort((np.arange(len(self.keys)), self.keys["b"], self.keys["a"]))
        own = self.keys[order]
        fresh = np.ones(len(own), bool)
        fresh[1:] = own[1:] != own[:-1]
        self.first = np.zeros(len(own), bool)  # the batch's first occurrence of a run
        self.first[order[fresh]] = True

    def shard_of(self, shards: int) -> np.ndarray:
        return (self.keys["a"][self.first] % np.uint64(shards)).astype(np.int64)


def ask_runs(left: pa.Table, answers: pa.Table, shards: int, least: int) -> pa.Table:
    """The batch's first occurrence of each run around a seed."""
    if not left.num_rows:
        return packed(0, np.zeros(0, np.int64), np.zeros(0, RUN))
    r = Runs(*in_order(left), answers, least)
    return packed(left.column("batch")[0].as_py(), r.shard_of(shards), r.keys[r.first], r.docs[r.first], r.places[r.first])


def answer_runs(table: pa.Table) -> pa.Table:
    """To each batch a bit for each run that it asked about, in its order: does it start earlier in another batch?"""
    keys, docs = blobs(table, "keys", RUN), blobs(table, "docs", "<i8")
    all_keys = np.concatenate(keys)
    batch = np.repeat(table.column("batch").to_numpy(), [len(k) for k in keys])  # only rows without an id are in more than one
    order = np.lexsort((batch, np.concatenate(docs), all_keys["b"], all_keys["a"]))
    own = all_keys[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    later = np.ones(len(own), bool)
    later[order[fresh]] = False
    ends = np.cumsum([len(k) for k in keys])
    shard = table.column("shard")[0].as_py()
    rows = [(b, 2, shard, np.packbits(x).tobytes()) for b, x in zip(table.column("batch").to_pylist(), np.split(later, ends[:-1]))]
    return table_of(rows, ANSWER_NAMES, ANSWER_KINDS)


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,n:int>>"


def strip(left: pa.Table, answers: pa.Table, shards: int, least: int, texts: bool) -> pa.Table:
    """Take out what is covered by runs that start earlier; repeats are the maximal stretches taken out."""
    names = [x.split()[0] for x in OUT.split(", ")] + ["kept_text"] * texts
    span = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string()][: len(names)]
    if not left.num_rows:
        return table_of([], names, kinds)
    ids, text = in_order(left)
    r = Runs(ids, text, answers, least)
    gone = ~r.first
    places, asked = dict(by_shard(r.shard_of(shards))), np.flatnonzero(r.first)
    for kind, shard, data in zip(*(answers.column(k).to_pylist() for k in ("kind", "shard", "data"))):
        if kind == 2:
            own = asked[places[shard]]
            gone[own] = np.unpackbits(np.frombuffer(data, np.uint8), count=len(own)).astype(bool)
    edge = np.zeros(r.total + 1, np.int64)
    np.add.at(edge, r.words[gone], 1)
    np.add.at(edge, r.words[gone] + least, -1)
    covered = np.cumsum(edge)[:-1] > 0
    rows, at = [], 0
    for key, value, n in zip(ids.to_pylist(), text.cast(pa.binary()), r.counts.tolist()):
        own = covered[at : at + n]
        at += n
        words, removed, spans = (value.as_py() or b"").split(), int(np.count_nonzero(own)), []
        if removed:
            words = compress(words, (~own).tolist())
            turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            spans = [{"start": int(x), "n": int(y - x)} for x, y in zip(turns[::2], turns[1::2])]
        kept = b" ".join(words)
        rows.append((key, n, removed, hashlib.sha256(kept).hexdigest(), spans, *[kept.decode()] * texts))
    return table_of(rows, names, kinds)


def substring_dedup(docs: DataFrame, least: int = 20, texts: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Every row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256, repeats, and kept_text if texts are asked for."""
    dealt, batches = in_batches(docs, text_bytes(docs), F.col("doc_id").cast("long").alias("doc_id"), "text", batch_bytes=batch_bytes)
    shards = -(-batches // SHARD_BATCHES)
    anchors = dealt.groupBy("batch").applyInArrow(lambda t: ask_anchors(t, shards, least), ASK)
    seeds = anchors.groupBy("shard").applyInArrow(answer_anchors, ANSWER)
    runs = dealt.groupBy("batch").cogroup(seeds.groupBy("batch")).applyInArrow(lambda t, a: ask_runs(t, a, shards, least), ASK)
    later = runs.groupBy("shard").applyInArrow(answer_runs, ANSWER)
    answers = seeds.unionByName(later)
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda t, a: strip(t, a, shards, least, texts), OUT + ", kept_text string" * texts)
