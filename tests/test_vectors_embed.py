"""Vectors of texts leave Python as one block of numbers for a batch."""

import numpy as np
from pyspark.sql import functions as F

from foliate.operators import vectors


def test_embedded_texts_equal_their_unit_vectors(spark):
    rows = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "one")], "i int, content string").coalesce(1)
    made = rows.select("i", vectors.embed(F.col("content"), "m", 5).alias("v"))
    got = {r.i: r.v for r in made.collect()}
    assert all(np.array_equal(np.array(got[i], np.float32), vectors.unit_vector(t, "m", 5).astype(np.float32)) for i, t in ((1, "one"), (2, ""), (3, ""), (4, "one")))
    assert "pd" not in vars(vectors)  # no row becomes an object of its own
