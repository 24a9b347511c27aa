import hashlib
import random
import re

from foliate.llm import exact_dedup, minhash, substring

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in BLANK.split(text or "") if w]


def brute_substring(texts, least=20):
    seen, out = set(), {}
    for i, text in enumerate(texts):
        w = split(text)
        gone = [False] * len(w)
        for at in range(len(w) - least + 1):
            run = tuple(w[at : at + least])
            if run in seen:
                gone[at : at + least] = [True] * least
            seen.add(run)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def run_substring(frame, **more):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(frame, **more).collect()}


def test_substring_equals_brute_force(docs, words):
    rng = random.Random(3)
    parts = [words(rng.randrange(15, 40), s) for s in range(12)]
    texts = ["\n ".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    texts += [None, "", " \t\n", "one", words(19), words(20), words(20), "a " * 200, "é ß " * 30, words(3000, 99), words(3000, 99) + " tail"]
    want = brute_substring(texts)
    assert run_substring(docs(texts)) == want
    assert run_substring(docs(texts), batch_bytes=2000) == want  # many batches and shards


def test_substring_spans_and_text(docs, words):
    rows = {r.doc_id: r for r in substring.substring_dedup(docs([words(25), "x y " + words(25) + " z"]), texts=True).collect()}
    assert rows[0].repeats == [] and rows[1].kept_text == "x y z"
    assert [(s.start, s.n) for s in rows[1].repeats] == [(2, 25)]


def test_substring_empty_table_and_repeated_rows(docs, words):
    assert run_substring(docs([]).filter("false")) == {}
    rows = substring.substring_dedup(docs([(5, words(30)), (5, words(30))])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(5, 0), (5, 30)]


def test_long_words_of_two_letters_are_told_apart(docs, words, thue_morse):
    for k in (10, 12, 14):
        a, b = thue_morse(k)
        texts = [f"{words(10)} {a} {words(9, 1)}", f"{words(10)} {b} {words(9, 1)}", f"x {a}", f"x {b}"]
        assert [r.n_removed for r in substring.substring_dedup(docs(texts)).collect()] == [0] * 4
        assert [r.component_id for r in minhash.near_duplicates(docs(texts[2:]), n=2).sort("doc_id").collect()] == [0, 1]


def test_substring_orders_rows_of_one_id_by_text_and_takes_null_ids(docs, words):
    rows = [(5, f"b {words(30)}"), (5, f"a {words(30)}"), (None, words(25)), (7, None), (7, "")]
    found = {(r.doc_id, r.n_words, r.n_removed) for r in substring.substring_dedup(docs(rows)).collect()}
    assert found == {(None, 25, 0), (5, 31, 25), (5, 31, 30), (7, 0, 0)}


def test_substring_in_many_batches_equals_one(docs, words):
    texts = [f"{words(30, i % 7)} {words(40, 100 + i)} {words(25, i % 3)}" for i in range(60)]
    one = sorted(map(tuple, substring.substring_dedup(docs(texts)).collect()))
    assert sorted(map(tuple, substring.substring_dedup(docs(texts), batch_bytes=2000).collect())) == one


def test_exact_keeps_the_longest_then_the_smallest(docs):
    texts = ["ab", "a b", "a\tb ", "x", None, "", " ", "x", "ü b", "üb"]
    rows = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(texts)).collect()}
    assert {i: r.keep_id for i, r in rows.items()} == {0: 2, 1: 2, 2: 2, 3: 3, 7: 3, 4: 6, 5: 6, 6: 6, 8: 8, 9: 8}
    assert rows[0].group_size == 3 and [i for i, r in rows.items() if r.kept] == [2, 3, 6, 8] or {i for i, r in rows.items() if r.kept} == {2, 3, 6, 8}
    assert rows[1].text_sha256 == hashlib.sha256(b"ab").hexdigest()


def test_exact_splits_groups_whose_bytes_differ(docs, monkeypatch, spark):
    """With a hash that always collides, the comparison of bytes alone has to tell the texts apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "content_hash", lambda norm: F.unhex(F.md5(F.lit("same"))))
    rows = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs(["a", "b", "a ", "c", None])).collect()}
    assert rows == {0: (2, 2), 2: (2, 2), 1: (1, 1), 3: (3, 1), 4: (4, 1)}


def test_exact_keeps_one_row_of_a_group_whose_ids_repeat(docs, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (2, "a  b"), (2, "x"), (None, "x"), (None, "y"), (3, "z" * 100_000), (3, "z" * 100_000)]
    want = [(1, 2, 4, False, 3), (1, 2, 4, False, 3), (1, 2, 4, False, 2), (2, 2, 4, True, 4), (2, 2, 2, True, 1), (None, 2, 2, False, 1), (None, None, 1, True, 1), (3, 3, 2, False, 100_000), (3, 3, 2, True, 100_000)]
    frame = docs(rows)
    for _ in range(2):
        got = exact_dedup.exact_dedup(frame.drop("hash", "kept"), "n_chars").collect()
        assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.kept, r.n_chars) for r in got))) == sorted(map(str, want))
        monkeypatch.setattr(exact_dedup, "content_hash", lambda norm: F.unhex(F.md5(F.lit("same"))))  # all collide


def test_exact_empty_table(docs):
    assert exact_dedup.exact_dedup(docs(["a"]).filter("false")).collect() == []


def brute_near(texts, n, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = split((t or "").translate(low))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_near_equals_brute_force(docs, words):
    """A large group of near copies, many of them beyond the limit of each other, so that buckets stay open after the pivots."""
    rng = random.Random(5)
    base = words(60).split()
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(60)] = f"new{rng.randrange(40)}"
        texts.append(" ".join(w))
    texts += [None, "", " ", "One", "one", "Two words", "two WORDS", "É a", "é a", "a a a a a", "a a", *texts[:5], words(5000, 7), words(4900, 7)]
    for n in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(texts), n).collect()}
        assert got == brute_near(texts, n)


def test_near_rows_that_share_an_id_or_have_none(docs, words):
    rows = [(5, words(40)), (5, words(40, 1)), (5, words(40)), (9, words(40) + " more"), (None, words(40)), (None, words(30, 2)), (7, words(40, 1)), (8, ""), (8, None), (None, None)]
    got = minhash.near_duplicates(docs(rows), 2, 80, "n_chars").collect()
    assert sorted(map(str, ((r.doc_id, r.component_id, r.n_shingles) for r in got))) == sorted(map(str, [(5, 5, 39), (5, 5, 39), (5, 5, 39), (9, 5, 40), (None, 5, 39), (None, None, 29), (7, 5, 39), (8, 8, 0), (8, 8, 0), (None, None, 0)]))
    assert sum(r.stays for r in got if r.n_shingles >= 39) == 2 and all(r.stays for r in got if r.n_shingles < 39)
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t in rows)


def test_near_kept_and_empty(docs):
    rows = minhash.near_duplicates(docs(["a b c", "a b c", "", None]), 2).collect()
    assert {r.doc_id: r.kept for r in rows} == {0: True, 1: False, 2: True, 3: True}
    assert minhash.near_duplicates(docs(["a"]).filter("false"), 2).collect() == []


def test_min_max_values_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    times, plus = minhash._functions()
    values = [((x[None, :] * times + plus) >> np.uint64(32)) for x in (a, b)]
    same = np.concatenate([values[0].min(1) == values[1].min(1), values[0].max(1) == values[1].max(1)])
    assert abs(same.mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12


def test_substring_deals_rows_without_id_by_their_text(docs, words, spark):
    from foliate.llm.common import in_batches

    rows = docs([(None, f"{i} {words(30, i % 50)}") for i in range(10_000)])
    dealt, n = in_batches(rows, 64_000, "doc_id", "text", batch_bytes=1000)
    sizes = sorted(r["count"] for r in dealt.groupBy("batch").count().collect())
    assert n == 64 and len(sizes) == 64 and sizes[-1] < 400
    few = docs([(None, f"{i} {words(30, i % 3)}") for i in range(60)] + [(1, f"x {words(30, 0)} y"), (2, words(50, 9))])
    found = substring.substring_dedup(few, batch_bytes=300).collect()
    assert sorted((r.n_words, r.n_removed) for r in found if r.doc_id is None) == [(31, 0)] * 3 + [(31, 30)] * 57
    assert {(r.doc_id, r.n_removed) for r in found if r.doc_id} == {(1, 30), (2, 0)}


def test_exact_takes_the_smallest_long_and_breaks_ties_by_columns(docs):
    low = -(1 << 63)
    rows = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(docs([(low, "a"), (3, "a"), (low, "b"), ((1 << 63) - 1, "b")])).collect()}
    assert rows == {(low, low, True), (3, low, False), ((1 << 63) - 1, low, False)}
    frame = docs([(1, "same")]).unionByName(docs([(1, "same")], "de")).drop("hash", "kept")
    kept = {tuple(r.lang for r in exact_dedup.exact_dedup(x, "lang").filter("kept").collect()) for x in (frame, frame.orderBy("lang"), frame.orderBy(frame.lang.desc()), frame.repartition(2, "lang"))}
    assert len(kept) == 1


def test_exact_of_a_very_long_text(docs):
    long = "ab " * 2_000_000
    rows = {r.doc_id: r for r in exact_dedup.exact_dedup(docs([long, long + " ", "ab"])).collect()}
    assert (rows[0].keep_id, rows[1].group_size, rows[2].keep_id) == (1, 2, 2) and rows[0].text_sha256 == hashlib.sha256(long.replace(" ", "").encode()).hexdigest()
