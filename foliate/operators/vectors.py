"""Embedding tables: a deterministic model, upserts, work lists and similarity."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimensions of the known models, and of any other.
DIMENSIONS = {"all-MiniLM-L6-v2": 384, "nomic-embed-text": 768, "openai-text-embedding-3-small": 1536}
DEFAULT_DIMENSION = 768


def unit_vector(text: str, model: str, size: int) -> np.ndarray:
    """Normal numbers from a seed that model and text give, at length 1."""
    seed = int.from_bytes(hashlib.sha256(f"{model}:{text}".encode()).digest()[:4], "big")
    v = np.random.default_rng(seed).standard_normal(size)
    return v / (np.linalg.norm(v) or 1.0)


def embed(text: Column, model: str, size: int | None = None) -> Column:
    """The slot for a model: one Arrow-batched call per batch of texts."""
    size = size or DIMENSIONS.get(model, DEFAULT_DIMENSION)

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        made = np.empty((len(texts), size), np.float32)
        for i, t in enumerate(texts.to_pylist()):
            made[i] = unit_vector(t or "", model, size)
        return pa.ListArray.from_arrays(np.arange(0, made.size + 1, size, dtype=np.int32), made.ravel())

    return run(text)


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of new in place of old rows of the same key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def work_list(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of the model. A null id never hides the rest, as it would in NOT IN."""
    return chunks.join(embeddings.filter(F.col("model_name") == model).select("chunk_id").distinct(), "chunk_id", "left_anti")
