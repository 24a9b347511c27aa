import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A frame of documents from texts; ids count from 0 unless pairs are given. It has extra columns with clashing names."""

    def make(texts, lang="en"):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        frame = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], DOCS)
        for name in ("hash", "kept", "batch", "norm", "key"):
            frame = frame.selectExpr("*", f"1 AS {name}")
        return frame

    return make


def passage(n, seed=0):
    """n different words."""
    return " ".join(f"w{seed}x{i}" for i in range(n))


@pytest.fixture
def words():
    return passage


@pytest.fixture
def thue_morse():
    """Two different words of 2^k letters a and b, which any polynomial of bytes modulo 2^64 takes for one."""

    def make(k):
        word, other = "a", str.maketrans("ab", "ba")
        for _ in range(k):
            word += word.translate(other)
        return word, word.translate(other)

    return make
