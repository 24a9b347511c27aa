"""Language identification by string kernels: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest ridge.

k(x, y) counts the n-grams of 1 to 3 letters (with word bounds) that both texts have, divided by the root of k(x, x) k(y, y). N-grams are code points
of any script, hashed to 20 bits. A bounded, balanced sample of labelled documents, each whole, gives landmarks and training rows; a text's kernel
values against all landmarks come from one product of its presence row with the landmarks' matrix, for many texts at once.

Edge cases: a text that is null or has no letter is "und" with score 0. Without any labelled row all texts are "und". Ties go to the
first language in order. Repeated rows, and rows that share an id, are predicted each by its own text, and learned from each; a null id is not held out. A long text is one row of the matrix like any
other, from all its n-grams. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bounds of the sample that the model is fitted on: rows in all, and rows of one language at least.
SAMPLE_ROWS, LEAST_ROWS = 2000, 20
#: Landmarks in all, bits of an n-gram's hash, ridge, and the sharpness of scores.
LANDMARKS, HASH_BITS, RIDGE, SHARPNESS = 128, 20, 1e-2, 4.0
ORDERS = (1, 2, 3)
_lower: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """Code points in lower case, 0 for each run of what is no letter, with 0 at both ends; size 1 if there is no letter."""
    global _lower
    if _lower is None:
        _lower = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalpha():
                _lower[i] = ord(c.lower()) if len(c.lower()) == 1 else i
    codes = _lower[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)])
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


#: Odd multipliers for an n-gram's letters by place, for its order, and for the whole.
_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams of a text's letters, with repeats."""
    wide, out = codes.astype(np.uint64), []
    for n in ORDERS:
        h = np.full(max(0, len(wide) - n + 1), n * int(_TIMES[3]) % (1 << 64), np.uint64)
        for i in range(n):
            h += wide[i : len(wide) - n + 1 + i] * _TIMES[i]
        h = (h ^ (h >> np.uint64(32))) * _TIMES[4]
        out.append((h >> np.uint64(64 - HASH_BITS)).astype(np.int32))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    feature: np.ndarray  # of each n-gram's hash its row among the landmarks' n-grams, or -1
    landmarks: np.ndarray  # n-grams x landmarks
    norms: np.ndarray
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def kernel(self, texts: list[np.ndarray], distinct) -> np.ndarray:
        """Of texts given by their n-grams' hashes: a row of kernel values with the landmarks for each."""
        rows = np.zeros((len(texts), self.landmarks.shape[0]), np.float32)
        own = np.ones(len(texts), np.float32)
        for i, made in enumerate(texts):
            own[i] = distinct(made)
            features = self.feature[made]
            rows[i, features[features >= 0]] = 1
        return (rows @ self.landmarks) / np.sqrt(own[:, None] * self.norms[None, :])

    def predict(self, texts: list[np.ndarray], distinct) -> np.ndarray:
        """Probabilities, a row for each text."""
        f = self.kernel(texts, distinct) @ self.weights + self.bias
        e = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def counter(size: int):
    """How many different codes below size: each place keeps the last index written, and only that one counts. No sorting."""
    last = np.zeros(size, np.int32)

    def distinct(codes: np.ndarray) -> int:
        order = np.arange(len(codes), dtype=np.int32)
        last[codes] = order
        return int(np.count_nonzero(last[codes] == order))

    return distinct


def fit(labelled: DataFrame) -> Model | None:
    """From labelled(doc_id, text, lang). The sample has the rows with the smallest hashes (of id and text) of each language."""
    rows = labelled.filter("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    quota = max(LEAST_ROWS, SAMPLE_ROWS // len(counts))
    # first without texts: the mark of each language's last row of the quota. Each task keeps no more rows of a language than that
    marked = rows.withColumn("mark", F.xxhash64("doc_id", "text"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("mark"))
    last = marked.select("lang", "mark").withColumn("nth", first).filter(F.col("nth") <= quota).groupBy("lang").agg(F.max("mark").alias("last")).collect()
    bound = F.create_map(*[F.lit(x) for r in last for x in (r.lang, r["last"])])
    few = marked.filter(F.col("mark") <= F.element_at(bound, F.col("lang")))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("mark", "doc_id", "text"))
    sample = few.select("doc_id", "lang", "mark", "text").withColumn("nth", nth).filter(F.col("nth") <= quota).select("lang", "nth", "text")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [letters(x) for x in batch.column(2).to_pylist()]
            made = [np.unique(grams(x)).tobytes() if len(x) > 1 else None for x in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["lang", "nth", "grams"])

    # at most max(SAMPLE_ROWS, LEAST_ROWS x languages) rows of at most 2^HASH_BITS n-grams
    rows = sample.mapInArrow(presence, "lang string, nth int, grams binary").filter("grams is not null").collect()
    found = [(r.lang, np.frombuffer(r.grams, np.int32)) for r in sorted(rows, key=lambda r: (r.nth, r.lang))]
    if not found:
        return None
    names, size = sorted({x[0] for x in found}), 1 << HASH_BITS
    each = max(1, LANDMARKS // len(names))
    chosen = [x for name in names for x in landmarks_of([g for lang, g in found if lang == name], each)]
    every = np.unique(np.concatenate(chosen))
    model = Model(names, np.full(size, -1, np.int32), np.zeros((len(every), len(chosen)), np.float32), np.array([len(g) for g in chosen], np.float32), np.zeros(0), np.zeros(0))
    model.feature[every] = np.arange(len(every), dtype=np.int32)
    for j, g in enumerate(chosen):
        model.landmarks[model.feature[g], j] = 1
    among = (model.landmarks.T @ model.landmarks) / np.sqrt(model.norms[:, None] * model.norms[None, :])
    values, vectors = np.linalg.eigh(among.astype(np.float64))
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    z = np.concatenate([model.kernel([g for _, g in found[i : i + 128]], len) for i in range(0, len(found), 128)]).astype(np.float64) @ whiten
    y = np.array([[1.0 if x[0] == name else -1.0 for name in names] for x in found])
    centre, mean = z.mean(axis=0), y.mean(axis=0)
    ridge = np.linalg.solve((z - centre).T @ (z - centre) + RIDGE * len(z) * np.eye(z.shape[1]), (z - centre).T @ (y - mean))
    model.weights, model.bias = (whiten @ ridge).astype(np.float32), (mean - centre @ ridge).astype(np.float32)
    return model


def landmarks_of(texts: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The n texts with the most n-grams among the shorter half (all, where they are few), so that the landmarks' matrix stays small."""
    ranked = sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))
    half = max(n, len(ranked) // 2)
    return [texts[i] for i in ranked[:half][-n:]]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs(doc_id, text). The model is bounded by its parameters and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        distinct = counter(len(m.feature)) if m else None
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                codes = [letters(x) if x else np.zeros(1, np.uint32) for x in part.column(1).to_pylist()]
                names, scores = ["und"] * len(codes), [0.0] * len(codes)
                some = [i for i, x in enumerate(codes) if len(x) > 1] if m else []
                if some:
                    p = m.predict([grams(codes[i]) for i in some], distinct)
                    for i, row in zip(some, p):
                        names[i], scores[i] = m.languages[int(row.argmax())], float(row.max())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
