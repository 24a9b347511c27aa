"""Quality by an interpolated modified Kneser-Ney model of letters, trained on trusted documents.

The model: n-grams of 6 symbols (letters in lower case, one symbol for all digits, one for each run of blanks), so that most reach
into the word before and the tables grow with the trusted text. Symbols are whole code points, three to a 64-bit number.

The work is a chain of sharded count joins. Each batch of documents sends its distinct n-grams once, with their counts in its trusted part, to
shards by a hash of the n-gram; shards add them up. The sums are dealt out again by the two symbols before the last one: all counts, continuation
counts and contexts of orders 3 to 6 that an n-gram needs are then in one place, and only pairs and single symbols are joined as tables. The
probabilities go back to the shards and from there, by number, to the batches, which add them up for each document. What is sent is sorted by the
n-gram and compressed. A shard sees an n-gram once for
each batch however often it occurs; the second dealing has each n-gram once, so a context holds at most its share of the distinct n-grams.

A part of the trusted documents stays out of the counts; the quantile of its perplexities in each language is the limit for that language.

Edge cases: a text that is null, empty or blank has no perplexity and is kept, there being nothing against it. Languages with too few
trusted documents, and a null language, have the quantile over all of them. Without trusted documents all is kept. Rows are scored one by one, so
repeated rows and rows that share an id each come back once. A perplexity at the limit itself is kept. Very long texts are counted whole, in
slices. A null id is never trusted. Extra columns are not read. No rows give no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import by_shard, cut, in_batches, table_of, text_bytes
from foliate.llm.wordhash import mix, slices

#: An n-gram is two longs of three symbols: `key` has the last symbol lowest, `far` the farthest one lowest.
ORDER, BITS = 6, 21
SYMBOL, PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: Orders whose counts lie together once n-grams are dealt by the two symbols before the last.
JOINT = range(3, ORDER + 1)
#: The share of trusted documents kept out of the counts (one in so many), the quantile of their perplexities, and the fewest for a language.
CALIBRATE, QUANTILE, LEAST = 10, 0.998, 100
#: Bytes of text in a batch.
BATCH_BYTES = 8 << 20
_PAD, _DIGIT, _BLANK = 2, 48, 32
_fold: np.ndarray | None = None


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with padding before each, and how many symbols each text has."""
    global _fold
    if _fold is None:
        _fold = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and unicodedata.category(c := chr(i)) not in ("Cn", "Co"):
                _fold[i] = _BLANK if c.isspace() else _DIGIT if c.isdigit() else ord(c.lower()) if len(c.lower()) == 1 else i
        _fold = np.maximum(_fold, 3)
    sizes = np.array([len(x or "") for x in texts])
    codes = _fold[np.frombuffer("".join(x or "" for x in texts).encode("utf-32-le", "replace"), np.uint32)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[sizes > 0]
    keep[starts] = codes[starts] != _BLANK
    kept = np.concatenate([[0], np.cumsum(keep)])
    counts = kept[ends] - kept[ends - sizes]
    out = np.full(len(texts) * (ORDER - 1) + int(kept[-1]), _PAD, np.uint32)
    out[np.repeat(np.arange(1, len(texts) + 1) * (ORDER - 1), counts) + np.arange(int(kept[-1]))] = codes[keep]
    return out, counts


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram (key, far) that ends at each symbol, text after text, and how many each text has."""
    s, counts = symbols(texts)
    own, s = s != _PAD, s.astype(np.uint64)
    key, far = np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64)
    for back in range(3):
        key[back:] |= s[: len(s) - back] << np.uint64(BITS * back)
        far[back + 3 :] |= s[: max(0, len(s) - back - 3)] << np.uint64(BITS * (2 - back))
    return key[own], far[own], counts


def hashed(key: np.ndarray, far: np.ndarray) -> np.ndarray:
    return mix(key + mix(far + np.uint64(1)))


def distinct(key: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct n-grams, in the order of (hash, key, far), and for each n-gram its number among them."""
    h = hashed(key, far)
    order = np.argsort(h)

    def turns() -> np.ndarray:
        k, f = key[order], far[order]
        return (k[1:] != k[:-1]) | (f[1:] != f[:-1])

    fresh = turns()
    if np.any(fresh & (h[order[1:]] == h[order[:-1]])):  # different n-grams with one hash
        order = np.lexsort((far, key, h))
        fresh = turns()
    fresh = np.concatenate([np.ones(min(1, len(order)), bool), fresh])
    del h
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


def pack(docs: DataFrame) -> DataFrame:
    """batch, blob: docs(batch, ...) by batch, compressed; texts would else be most of what is shuffled."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for rows in batches:
            batch = rows.column(0).to_numpy()
            order = np.argsort(batch, kind="stable")
            numbers, first = np.unique(batch[order], return_index=True)
            for number, own in zip(numbers.tolist(), np.split(order, first[1:]) if len(order) else []):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema(list(rows.schema)[1:]), options=options) as out:
                    out.write_batch(rows.select(rows.schema.names[1:]).take(pa.array(own)))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "blob"])

    return docs.mapInArrow(packed, "batch int, blob binary")


def unpacked(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Slices of a batch's documents."""
    for chunk in table.column("blob").chunks:
        for blob in chunk:
            for rows in pa.ipc.open_stream(blob.as_buffer()):
                for at, to in slices(rows.column("text")):
                    yield rows.slice(at, to - at)


ASK, ASK_KINDS = "shard int, batch int, keys binary, fars binary, counts binary", [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
#: What a shard writes: for each context's part its n-grams (batch null) with their numbers, and for each batch the numbers of what it asks.
SHARD, SHARD_KINDS = "shard int, part int, batch int, numbers binary, keys binary, fars binary, counts binary", [pa.int32()] * 3 + [pa.binary()] * 4
#: What a part of the contexts writes: its n-grams in one row, how many have a count of 1 to 4 in each order, and the pairs' counts.
PART, PART_KINDS = "part int, data array<binary>, few array<long>, pair long, c long", [pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.int64()]


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def squeezed(x: np.ndarray, rising: bool = False) -> bytes:
    """An array as its size and its compressed bytes, all first ones first; of rising values only the differences."""
    if rising:
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def expanded(data: bytes, kind, rising: bool = False) -> np.ndarray:
    n, kind = int.from_bytes(data[:8], "little"), np.dtype(kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * kind.itemsize, asbytes=True), np.uint8)
    x = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def blobs(table: pa.Table, name: str, kind, rising: bool = False) -> list[np.ndarray]:
    return [expanded(x.as_py(), kind, rising) for x in table.column(name)]


def joined(table: pa.Table, name: str, kind, rising: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *blobs(table, name, kind, rising)])


def ask(table: pa.Table, counted: pa.Table, shards: int) -> pa.Table:
    """The distinct n-grams of a batch, with their counts in its counted documents."""
    if not table.num_rows:
        return table_of([], names(ASK), ASK_KINDS)
    trusted, found = counted.column("doc_id").to_numpy(), [[np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0)]]
    for rows in unpacked(table):
        key, far, sizes = grams(rows.column("text").to_pylist())
        first, number = distinct(key, far)
        ids = rows.column("doc_id")
        own = np.isin(pc.fill_null(ids, 0).to_numpy(), trusted) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
        found.append([key[first], far[first], np.bincount(number, np.repeat(own, sizes), len(first))])
    key, far, n = (np.concatenate(x) for x in zip(*found))
    first, number = distinct(key, far)
    n, key, far = np.bincount(number, n, len(first)).astype(np.int32), key[first], far[first]
    batch = table.column("batch")[0].as_py()
    rows = [(i, batch, squeezed(key[own], True), squeezed(far[own]), squeezed(n[own])) for i, own in asked_of(key, far, shards)]
    return table_of(rows, names(ASK), ASK_KINDS)


def asked_of(key: np.ndarray, far: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """The shards of distinct n-grams, given in the order of their hashes, with the places of those that each has, by key, then by hash."""
    shard, order = (hashed(key, far) % np.uint64(shards)).astype(np.int64), np.argsort(key, kind="stable")
    return [(i, order[own]) for i, own in by_shard(shard[order])]


def merge(table: pa.Table, shards: int) -> pa.Table:
    """The shard's n-grams with their counts over all batches, numbered, by the contexts' parts; and each batch's numbers."""
    key, far, n = joined(table, "keys", np.uint64, True), joined(table, "fars", np.uint64), joined(table, "counts", np.int32)
    first, number = distinct(key, far)
    order = np.argsort(key[first], kind="stable")  # numbered as each batch has them: by key, then by hash
    place = np.empty(len(first), np.int32)
    place[order] = np.arange(len(first), dtype=np.int32)
    first, number = first[order], place[number]
    n, key, far = np.bincount(number, n, len(first)).astype(np.int64), key[first], far[first]
    shard, part = table.column("shard")[0].as_py(), (mix(key >> np.uint64(BITS)) % np.uint64(shards)).astype(np.int64)
    rows = [(shard, i, None, squeezed(own.astype(np.int32), True), squeezed(key[own], True), squeezed(far[own]), squeezed(n[own])) for i, own in by_shard(part)]
    ends = np.cumsum([len(x) for x in blobs(table, "counts", np.int32)])
    for batch, own in zip(table.column("batch").to_pylist(), np.split(number, ends[:-1])):
        rows.append((shard, None, batch, squeezed(own, True), None, None, None))
    return table_of(rows, names(SHARD), SHARD_KINDS)


def counts_of(key: np.ndarray, far: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For n-grams sorted by (key, far), in each joint order: the count of each one's suffix, and whether it is the suffix's first.

    The highest order counts occurrences, the others how many different symbols stand before the suffix.
    """
    out, longer = {}, None
    for order in reversed(JOINT):
        rest = far >> np.uint64(BITS * (ORDER - order))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (rest[1:] != rest[:-1])
        if longer is None:
            own = n
        else:
            group = np.cumsum(fresh) - 1
            own = np.bincount(group, longer[1] & (longer[0] > 0)).astype(np.int64)[group]
        out[order] = longer = (own, fresh)
    return out


def gather(table: pa.Table) -> pa.Table:
    """All n-grams of a part of the contexts, sorted; how many suffixes of each order have a count of 1 to 4; and its pairs."""
    numbers = blobs(table, "numbers", np.int32, True)
    shard, number = np.repeat(table.column("shard").to_numpy().astype(np.int32), list(map(len, numbers))), np.concatenate(numbers)
    key, far, n = joined(table, "keys", np.uint64, True), joined(table, "fars", np.uint64), joined(table, "counts", np.int64)
    order, part = np.lexsort((far, key)), table.column("part")[0].as_py()
    shard, number, key, far, n = (x[order] for x in (shard, number, key, far, n))
    counts = counts_of(key, far, n)
    few = [int(np.count_nonzero(fresh & (c == i))) for c, fresh in counts.values() for i in (1, 2, 3, 4)]
    c, fresh = counts[JOINT[0]]
    pairs, which = np.unique(key[fresh] & np.uint64(PAIR), return_inverse=True)
    of_pair = np.bincount(which, c[fresh] > 0).astype(np.int64)
    rows = [(part, [squeezed(x) for x in (shard, number, key, far, n)], few, None, None)]
    return table_of(rows + [(part, None, None, p, x) for p, x in zip(pairs.astype(np.int64).tolist(), of_pair.tolist())], names(PART), PART_KINDS)


def discounts_of(few: list[int]) -> tuple[float, float, float]:
    """From how many n-grams have a count of 1, 2, 3 and 4."""
    y = few[0] / max(1, few[0] + 2 * few[1])
    return tuple(min(max(i - (i + 1) * y * few[i] / few[i - 1], 0.1) if few[i - 1] else 0.5, i) for i in (1, 2, 3))


def discount(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def few_of(counts: DataFrame) -> list[int]:
    r = counts.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first()
    return list(r)


def of_pairs(parts: DataFrame) -> DataFrame:
    """part, pair, p of the pairs of symbols in parts(part, pair, c): orders 2 and 1 of the model."""
    counted = cut(parts.groupBy("pair").agg(F.sum("c").alias("c")))
    seen = counted.filter("c > 0").select(F.shiftright("pair", BITS).alias("before"), F.col("pair").bitwiseAND(F.lit(SYMBOL)).alias("symbol"), "c")
    singles = cut(seen.groupBy("symbol").agg(F.count(F.lit(1)).alias("c")))
    d1, d2 = discounts_of(few_of(singles)), discounts_of(few_of(seen))
    base = singles.agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("total"), F.sum(discount(F.col("c"), d1)).alias("freed")).first()
    total = base.total or 1
    floor = (base.freed or 1.0) / total / (base.kinds + 1)
    single = singles.select("symbol", (F.greatest(F.col("c") - discount(F.col("c"), d1), F.lit(0.0)) / total).alias("own"))
    contexts = seen.groupBy("before").agg(F.sum("c").alias("total"), F.sum(discount(F.col("c"), d2)).alias("freed"))
    asked = counted.select("pair", "c", F.shiftright("pair", BITS).alias("before"), F.col("pair").bitwiseAND(F.lit(SYMBOL)).alias("symbol"))
    both = asked.join(single, "symbol", "left").join(contexts, "before", "left").withColumn("p1", F.coalesce("own", F.lit(0.0)) + floor)
    own = F.when(F.col("c") > 0, F.greatest(F.col("c") - discount(F.col("c"), d2), F.lit(0.0))).otherwise(0.0)
    p = F.when(F.col("total").isNull(), F.col("p1")).otherwise((own + F.col("freed") * F.col("p1")) / F.col("total"))
    return parts.select("part", "pair").join(both.select("pair", p.alias("p")), "pair")


def probabilities(table: pa.Table, pairs: pa.Table, discounts: dict[int, tuple[float, float, float]]) -> pa.Table:
    """The log probability of each n-gram of a part, for each shard with the n-grams' numbers."""
    kinds = (np.int32, np.int32, np.uint64, np.uint64, np.int64)
    found = next(x for x in table.column("data").to_pylist() if x)
    shard, number, key, far, n = (expanded(x, t) for x, t in zip(found, kinds))
    known = pairs.sort_by("pair")
    p = known.column("p").to_numpy()[np.searchsorted(known.column("pair").to_numpy(), (key & np.uint64(PAIR)).astype(np.int64))]
    counts, before = counts_of(key, far, n), key >> np.uint64(BITS)
    order = np.lexsort((far, before))
    for joint in JOINT:
        c, fresh = counts[joint]
        d = np.array([0.0, *discounts[joint]])[np.minimum(c, 3)]
        rest, b = far[order] >> np.uint64(BITS * (ORDER - joint)), before[order]
        turn = np.ones(len(key), bool)
        turn[1:] = (b[1:] != b[:-1]) | (rest[1:] != rest[:-1])
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(turn) - 1
        total, freed = np.bincount(group, c * fresh)[group], np.bincount(group, d * fresh)[group]
        p = np.where(total > 0, (np.maximum(c - d, 0) + freed * p) / np.maximum(total, 1), p)
    logp = np.log(p).astype(np.float32)
    rows = [(i, squeezed(number[own]), squeezed(logp[own])) for i, own in by_shard(shard)]
    return table_of(rows, ["shard", "numbers", "logp"], [pa.int32(), pa.binary(), pa.binary()])


def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """To each batch the log probabilities of what it asked a shard, in its order."""
    number, logp = joined(known, "numbers", np.int32), joined(known, "logp", np.float32)
    of = np.empty(len(number), np.float32)
    of[number] = logp
    rows = [(b, s, squeezed(of[own])) for b, s, own in zip(asked.column("batch").to_pylist(), asked.column("shard").to_pylist(), blobs(asked, "numbers", np.int32, True))]
    return table_of(rows, ["batch", "shard", "logp"], [pa.int32(), pa.int32(), pa.binary()])


def score(table: pa.Table, answers: pa.Table, shards: int, kept: list[str]) -> pa.Table:
    """Rows of a batch without their texts, with the number of symbols and the perplexity of each, null without symbols."""
    heads, sizes, found, places = [], [], [[np.zeros(0, np.uint64)] * 2], []
    for rows in unpacked(table):
        key, far, counts = grams(rows.column("text").to_pylist())
        first, number = distinct(key, far)
        heads.append(rows.select(kept))
        sizes.append(counts)
        found.append([key[first], far[first]])
        places.append(number)
    key, far = (np.concatenate(x) for x in zip(*found))
    first, number = distinct(key, far)
    logp, of_shard = np.empty(len(first)), dict(asked_of(key[first], far[first], shards))
    for shard, data in zip(answers.column("shard").to_pylist(), blobs(answers, "logp", np.float32)):
        logp[of_shard[shard]] = data
    out, at = [], 0
    for (own, _), place, counts in zip(found[1:], places, sizes):
        values = np.concatenate([[0.0], np.cumsum(logp[number[at : at + len(own)]][place])])
        at += len(own)
        ends = np.cumsum(counts)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = (values[ends] - values[ends - counts]) / counts
        out += [float(np.exp(-x)) if c else None for x, c in zip(mean, counts)]
    made = pa.Table.from_batches(heads)
    return made.append_column("n_symbols", pa.array(np.concatenate(sizes), pa.int64())).append_column("perplexity", pa.array(out, pa.float64()))


def perplexities(docs: DataFrame, counted: DataFrame, *also: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Every row of docs(doc_id, text, ...): doc_id, the columns asked for, n_symbols, perplexity. counted(doc_id): whose n-grams are counted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also)
    dealt, batches = in_batches(rows, text_bytes(rows), "doc_id", "text", *also, batch_bytes=batch_bytes)
    dealt, shards = pack(dealt).groupBy("batch"), batches
    trusted = counted.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "doc_id")
    asked = dealt.cogroup(trusted.groupBy("batch")).applyInArrow(lambda t, c: ask(t, c, shards), ASK)
    asked = cut(asked.groupBy("shard").applyInArrow(lambda t: merge(t, shards), SHARD))
    parts = cut(asked.filter("part is not null").groupBy("part").applyInArrow(gather, PART))
    few = parts.filter("few is not null").agg(*[F.sum(F.get("few", F.lit(i))) for i in range(4 * len(JOINT))]).first()
    discounts = {order: discounts_of([x or 0 for x in few[4 * i : 4 * i + 4]]) for i, order in enumerate(reversed(JOINT))}
    pairs = cut(of_pairs(parts.filter("pair is not null").select("part", "pair", "c")))
    whole = parts.filter("data is not null").select("part", "data").groupBy("part")
    known = cut(whole.cogroup(pairs.groupBy("part")).applyInArrow(lambda t, p: probabilities(t, p, discounts), "shard int, numbers binary, logp binary"))
    answers = asked.filter("batch is not null").select("shard", "batch", "numbers").groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "batch int, shard int, logp binary")
    kept = ["doc_id", *also]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return dealt.cogroup(answers.groupBy("batch")).applyInArrow(lambda t, a: score(t, a, shards, kept), schema + ", n_symbols long, perplexity double")


def classify(docs: DataFrame, trusted: DataFrame, *also: str) -> DataFrame:
    """Every row of docs(doc_id, text, lang): doc_id, lang, n_symbols, perplexity, threshold, kept, and the columns asked for. trusted(doc_id): who is trusted."""
    out_of = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATE)) == 0
    trusted = cut(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct())
    rows = cut(perplexities(docs, trusted.filter(~out_of), "lang", *also))
    calibrated = rows.join(trusted.filter(out_of), "doc_id", "left_semi").filter("perplexity is not null")
    limits = cut(calibrated.groupBy("lang").agg(F.percentile_approx("perplexity", QUANTILE, 10000).alias("own"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST))
    general = calibrated.agg(F.percentile_approx("perplexity", QUANTILE, 10000).alias("q")).first().q
    rows = rows.join(limits.select("lang", "own"), "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(general).cast("double")))
    return rows.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", (F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept"), *also)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Labelled good and not toxic."""
    return labels.filter("quality = 1 and toxic = 0").select("doc_id").distinct()
