import hashlib
import math

import numpy as np
import pytest

from foliate.llm import codes, pivots
from foliate.llm.codes import Book, compress
from foliate.llm.pivots import top_products

SCHEMA = "vec_id long, embedding array<float>, label int, code string, row int, v string, score int"


@pytest.fixture
def frame(spark):
    """Vectors with extra columns whose names clash."""

    def make(rows):
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label, "c", 1, "v", 2) for i, v, label in rows], SCHEMA)

    return make


def whole(rows):
    out = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    return out


def random_rows(n, length=16, seed=0, scale=1.0):
    draw = np.random.default_rng(seed)
    return [(i, (scale * draw.normal(size=length)).tolist(), int(draw.integers(4)) or None) for i in range(n)]


SPOILT = [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, 2), (903, [float("inf")] + [0.0] * 15, None), (904, [], 1), (905, [1.0, 2.0], 1)]


def brute_codes(rows, parts=16, entries=64, rounds=2):
    rows = whole(rows)
    width = len(rows[0][1]) // parts
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[tuple(r[1][p * width : (p + 1) * width]) for r in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        made = [[[] for _ in b] for b in books]
        for _, v, _ in rows:
            for p in range(parts):
                x = v[p * width : (p + 1) * width]
                made[p][nearest(p, x)[1]].append(x)
        books = [[tuple(sum(c) // len(xs) for c in zip(*xs)) if xs else old for old, xs in zip(b, m)] for b, m in zip(books, made)]
    out = []
    for i, v, label in rows:
        found = [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        out.append([i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label])
    total = {}
    for *_, error, label in out:
        total[label] = total.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted([(i, code, error, total[label], digest) for i, code, error, label in out], key=repr)


def codes_of(df, **more):
    return sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in compress(df, **more).collect()], key=repr)


def test_orchard_s_search_is_exact_and_takes_fewer_distances():
    draw = np.random.default_rng(1)
    for spread in (2, 40, 400):  # small numbers bring ties and equal entries
        entries = draw.integers(-spread, spread, (64, 4))
        x = draw.integers(-spread, spread, (5000, 4))
        gaps = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        best, gap, taken = Book(entries).nearest(x)
        assert (best == gaps.argmin(axis=1)).all() and (gap == gaps.min(axis=1)).all()
        assert taken < 0.7 * len(x) * len(entries)
    best, gap, taken = Book(entries[:1]).nearest(x)
    assert not best.any() and taken == len(x)


def test_codes_equal_brute_force(frame):
    rows = random_rows(300)
    assert codes_of(frame(rows + SPOILT).repartition(5)) == brute_codes(rows)


def test_codes_with_ties_repeats_and_few_rows(frame):
    same = [(7, [0.5] * 16, None)] * 3 + [(None, [0.25] * 16, None), (None, [0.5] * 16, 1), (-(1 << 63), [0.0] * 16, 1)]
    assert codes_of(frame(same)) == brute_codes(same)
    rows = random_rows(200, 32, 5, 0.01)  # few different components
    assert codes_of(frame(rows), entries=16, rounds=3) == brute_codes(rows, entries=16, rounds=3)
    assert codes_of(frame([])) == [] and codes_of(frame(SPOILT[:4])) == []


def test_codes_of_a_length_that_parts_do_not_divide(frame):
    with pytest.raises(ValueError, match="cut into 16 equal parts"):
        compress(frame([(1, [1.0] * 10, 1)]))


def brute_top(rows, every, k):
    rows, out = list(enumerate(whole(rows))), []
    for at, (q, v, _) in rows:
        if q is not None and q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for n, (i, w, _) in rows if n != at)[:k]
            out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(found, 1)]
    return sorted(out, key=repr)


def top_of(df, every=50, k=5):
    return sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in top_products(df, df.vec_id % every == 0, k).collect()], key=repr)


@pytest.mark.parametrize("block", [7, 2048])
def test_top_products_equal_brute_force(frame, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "CELL_ROWS", 100)
    monkeypatch.setattr(pivots, "CELL_QUERIES", 20)
    rows = random_rows(600, 16, 2) + [(600 + i, [0.01 * i] * 16, 1) for i in range(20)]
    assert top_of(frame(rows + SPOILT).repartition(3), 10) == brute_top(rows, 10, 5)


def test_top_products_with_ties_and_equal_rows(frame, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    monkeypatch.setattr(pivots, "CELL_ROWS", 32)
    same = [(i, [0.5] * 16, None) for i in range(150)]
    rows = same + [(50, [0.5] * 16, 1), (None, [0.5] * 16, 1), ((1 << 63) - 1, [2.0] * 16, 1), (-(1 << 63), [-2.0] * 16, 1), (None, [2.0] * 16, 1)]
    assert top_of(frame(rows)) == brute_top(rows, 50, 5)
    assert top_of(frame([(0, [1.0, 2.0], 1), (1, [3.0, 4.0], 1)])) == [(0, 1, 1, 256 * 256 * 11)]
    assert top_of(frame([(0, [1.0], 1)])) == [] and top_of(frame([])) == []


def test_products_beyond_53_bits_are_exact(frame):
    rows = [(i, [30000.0 + i / 256] * 64, 1) for i in range(60)]
    assert top_of(frame(rows)) == brute_top(rows, 50, 5)


def test_bounds_stop_the_search_among_clusters():
    draw = np.random.default_rng(4)
    centres = draw.integers(-200, 200, (16, 16))
    v = (centres[np.repeat(np.arange(16), 200)] + draw.integers(-6, 6, (3200, 16))).astype(np.int32)
    far = pivots.distances(v, pivots.far_apart(v.astype(np.int64), 32))
    block = pivots.Block(np.arange(3200), np.arange(3200), np.zeros(3200, bool), v, far)
    queries, best = block.take(np.arange(0, 3200, 50)), pivots.Best(64, 5)
    taken = pivots.search(queries, block, best)
    assert taken < 0.25 * 64 * 3200


def test_a_component_beyond_the_bound_ends_the_job(frame):
    with pytest.raises(Exception, match="too large"):
        codes_of(frame([(1, [1e9] * 16, 1)]))
