import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliate.llm import decontaminate, language, pii, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_decontaminate(texts, items):
    wins = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for at in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[at : at + 10]), set()).add(str(item))
    out = {}
    for i, text in enumerate(texts):
        w = WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for win, names in wins.items():
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit.update(range(at, at + len(win)))
                    found |= names
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontaminate_equals_brute_force(spark, docs, words):
    items = [(1, words(30, 1)), (2, words(12, 2)), (10, "only three words"), (11, "single"), (12, None), (13, ""), (14, words(30, 1)), (15, "A-B! c d"), (9, "é É x y z a b c d e f")]
    texts = [words(5, 9) + " " + words(30, 1).upper() + " " + words(5, 8), words(9, 2), words(10, 2), "Only, three--words and single ones; ONLY THREE", None, "", "a b c d a b c d", "é É x y z a b c d e", words(4000, 3) + " " + words(11, 2)]
    got = decontaminate.decontaminate(docs(texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == brute_decontaminate(texts, items)


def test_decontaminate_judges_rows_by_their_own_texts(spark, docs, words, monkeypatch):
    rows = [(1, words(30)), (1, "clean words here"), (None, words(12)), (2, None), (2, words(30)), (2, words(30)), (3, "x " * 50_000 + words(10))]
    items = spark.createDataFrame([(4, words(10)), (11, words(10)), (None, words(10)), (5, None), (6, "w0x3")], "item_id long, text string")
    want = [(1, 30, 10, 3), (1, 3, 0, 0), (None, 12, 10, 3), (2, 0, 0, 0), (2, 30, 10, 3), (2, 30, 10, 3), (3, 50_010, 10, 3)]
    for _ in range(2):
        got = decontaminate.decontaminate(docs(rows), items, "n_chars").collect()
        assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got))) == sorted(map(str, want))
        assert {r.items_sha256 for r in got if r.n_hit} == {hashlib.sha256(b"11,4,6").hexdigest()}
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)  # by shuffled joins


def test_decontaminate_without_items_or_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.decontaminate(docs(["a b"]), none).collect()] == [0]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(docs(["a"]).filter("false"), some).collect() == []


TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then the other thing was there with that",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann war das andere ding nicht da",
    "fr": "le renard brun rapide saute par dessus le chien paresseux et puis il était là avec cela",
}


def corpus(spark, n=40):
    rows = []
    for k, (lang, text) in enumerate(sorted(TEXTS.items())):
        w = text.split()
        rows += [(k * 1000 + i, " ".join(w[(i * 3 + j) % len(w)] for j in range(12)), lang) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_on_held_out_rows(spark):
    frame = corpus(spark)
    rows = language.language_id(frame).join(frame.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 10 and all(r.lang == r.lang_pred for r in held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_does_not_look_at_labels_of_what_it_predicts(spark):
    frame = corpus(spark)
    model = language.fit(frame)
    other = frame.selectExpr("doc_id + 1 AS doc_id", "text", "'xx' AS lang", "1 AS score")
    a = {r.doc_id + 1: r.lang_pred for r in language.identify(frame, model).collect()}
    assert a == {r.doc_id: r.lang_pred for r in language.identify(other, model).collect()}


def test_language_equals_brute_force(spark, monkeypatch):
    """With every training row a landmark, against kernels from sets of strings and ridge regression by the formulas."""
    monkeypatch.setattr(language, "LANDMARKS", 10_000)
    frame = corpus(spark, 12)
    rows = frame.collect()
    train, new = rows[::2], rows[1::2]

    def presence(text):
        t = "|" + re.sub(r"[\W\d_]+", "|", text.lower()) + "|"
        t = re.sub(r"\|+", "|", t)
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    kernel = lambda a, b: np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in b] for x in a])
    own = [presence(r.text) for r in train]
    values, vectors = np.linalg.eigh(kernel(own, own))
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    names = sorted({r.lang for r in train})
    z, y = kernel(own, own) @ whiten, np.array([[1.0 if r.lang == n else -1.0 for n in names] for r in train])
    w = np.linalg.solve((z - z.mean(0)).T @ (z - z.mean(0)) + language.RIDGE * len(z) * np.eye(len(z)), (z - z.mean(0)).T @ (y - y.mean(0)))
    f = (kernel([presence(r.text) for r in new], own) @ whiten - z.mean(0)) @ w + y.mean(0)
    e = np.exp(language.SHARPNESS * (f - f.max(1, keepdims=True)))
    want = {r.doc_id: (names[p.argmax()], p.max()) for r, p in zip(new, e / e.sum(1, keepdims=True))}
    model = language.fit(spark.createDataFrame(train, frame.schema))
    for r in language.identify(spark.createDataFrame(new, frame.schema), model).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 0.02


def test_language_of_many_scripts(spark):
    """Twelve languages, two of one script where the script is shared; more letters in all than any one alphabet has."""
    draw = random.Random(2)
    starts = {"aa": 0x61, "ab": 0x61, "el": 0x3B1, "ru": 0x430, "rv": 0x430, "hy": 0x561, "he": 0x5D0, "hi": 0x915, "th": 0xE01, "ka": 0x10D0, "ko": 0xAC00, "zh": 0x4E00}
    spread = {"ko": 600, "zh": 600}
    words = {k: ["".join(chr(at + draw.randrange(spread.get(k, 22))) for _ in range(draw.randrange(2, 7))) for _ in range(60)] for k, at in starts.items()}
    rows = [(i, " ".join(draw.choices(words[k], k=25)), k) for i, k in enumerate(sorted(words) * 30)]
    rows += [(10_000, " ".join(draw.choices(words["zh"], k=60_000)), "zh"), (10_000, " ".join(draw.choices(words["ru"], k=9)), "ru")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.language_id(frame).join(frame.select("doc_id", "lang"), "doc_id").filter("held_out and doc_id < 10000").collect()
    assert len(got) > 60 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert {r.lang_pred for r in language.language_id(frame).filter("doc_id = 10000").collect()} == {"zh", "ru"}


def test_language_edges(spark):
    model = language.fit(corpus(spark))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the dog " * 20000), (5, "日本語")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] == "en" and got[5] in TEXTS
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.language_id(corpus(spark).filter("false")).collect() == []


def test_quality_rejects_what_is_unlike_the_trusted(spark):
    frame = corpus(spark, 400)
    junk = spark.createDataFrame([(90001, "zq### xk%%% qqz@@@ vvx&&& " * 6, "en"), (90002, None, "en"), (90003, " ", None), (90004, "the dog " * 30000, "en")], frame.schema)
    got = {r.doc_id: r for r in quality.classify(frame.unionByName(junk), frame.select("doc_id")).collect()}
    assert not got[90001].kept and got[90001].perplexity > 20
    assert got[90002].kept and got[90002].perplexity is None and got[90003].kept and got[90004].n_symbols == 240000
    assert sum(not r.kept for i, r in got.items() if i < 90000) <= 12


def brute_quality(texts, trusted):
    """Perplexities by the formulas of interpolated modified Kneser-Ney, over dictionaries."""
    pad, order = "\x02", quality.ORDER

    def symbols(text):
        return pad * (order - 1) + re.sub(r"\s+", " ", text or "").lstrip(" ").lower().translate({ord(d): "0" for d in "123456789"})

    def grams(text):
        s = symbols(text)
        return [s[i - order + 1 : i + 1] for i in range(order - 1, len(s))]

    counts = {order: Counter(g for i in trusted for g in grams(texts[i]))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts, totals, freed = {}, {}, {}
    for n, c in counts.items():
        few = [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
        y = few[0] / max(1, few[0] + 2 * few[1])
        cuts[n] = [min(max(i - (i + 1) * y * few[i] / few[i - 1], 0.1) if few[i - 1] else 0.5, i) for i in (1, 2, 3)]
        totals[n], freed[n] = Counter(), Counter()
        for g, x in c.items():
            totals[n][g[:-1]] += x
            freed[n][g[:-1]] += cuts[n][min(x, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        n, x = len(g), counts[len(g)].get(g, 0)
        if not totals[n][g[:-1]]:
            return p(g[1:])
        return (max(x - cuts[n][min(x, 3) - 1], 0) * (x > 0) + freed[n][g[:-1]] * p(g[1:])) / totals[n][g[:-1]]

    logs = [[math.log(p(g)) for g in grams(t)] for t in texts]
    return [math.exp(-sum(x) / len(x)) if x else None for x in logs]


def test_quality_equals_brute_force(docs, monkeypatch):
    draw = random.Random(3)
    texts = ["".join(draw.choices("abcdE \n5é日\U0001d400", [9, 7, 5, 3, 2, 6, 1, 1, 1, 1, 1], k=draw.randrange(120))) for _ in range(50)] + [None, "", " \n ", "a", "xyz " * 50]
    trusted = range(0, 50, 2)
    frame = docs(texts)
    for size in (16 << 20, 700):
        got = {r.doc_id: r.perplexity for r in quality.perplexities(frame, frame.select("doc_id").filter("doc_id < 50 and doc_id % 2 = 0"), batch_bytes=size).collect()}
        for i, want in enumerate(brute_quality(texts, trusted)):
            assert got[i] == (None if want is None else pytest.approx(want, rel=1e-5)), i


def test_quality_when_hashes_of_n_grams_meet(docs, monkeypatch):
    monkeypatch.setattr(quality, "mix", lambda x: x % np.uint64(7))
    key = np.array([5, 6, 5, 13, 5, 12], np.uint64)
    far = np.array([1, 1, 1, 1, 2, 1], np.uint64)
    first, number = quality.distinct(key, far)
    assert len(first) == 5 and number[0] == number[2] and all(key[first[number]] == key) and all(far[first[number]] == far)


def test_quality_scores_each_row_by_itself(spark):
    frame = spark.createDataFrame([(1, "one text here", "en"), (1, "one text here", "de"), (1, "another", None), (None, "no id", "en"), (2, "one text here", "en")], "doc_id long, text string, lang string")
    got = quality.classify(frame, frame.select("doc_id")).collect()
    assert sorted((r.doc_id or 0, r.lang or "", r.n_symbols) for r in got) == [(0, "en", 5), (1, "", 7), (1, "de", 13), (1, "en", 13), (2, "en", 13)]
    assert len({r.perplexity for r in got if r.n_symbols == 13}) == 1
    clash = frame.selectExpr("*", "1 AS batch", "2 AS shard", "3 AS part", "4 AS kept", "5 AS perplexity")
    assert len(quality.classify(clash, frame.select("doc_id")).collect()) == 5
    assert quality.classify(frame.filter("false"), frame.select("doc_id")).collect() == []


def test_quality_looks_further_back_than_three_letters(spark, docs):
    """bcde is followed by x after q and by y after z; a model whose contexts have three letters takes all four texts for equals."""
    texts = docs(["qbcdex", "zbcdey", "qbcdey", "zbcdex", *["qbcdex", "zbcdey"] * 50])
    got = {r.doc_id: r.perplexity for r in quality.perplexities(texts, texts.select("doc_id").filter("doc_id > 3")).collect()}
    assert max(got[0], got[1]) * 1.5 < min(got[2], got[3])


def test_quality_tables_grow_with_the_trusted_text():
    """Three times the text has at least half as many n-grams again; of four symbols of so small an alphabet nearly all are met soon."""
    draw = random.Random(7)
    texts = ["".join(draw.choices("abcd ", k=100)) for _ in range(60)]
    few, all_of_it = (len(quality.distinct(*quality.grams(x)[:2])[0]) for x in (texts[:20], texts))
    assert all_of_it >= 1.5 * few


def test_quality_without_trusted_or_rows(spark):
    frame = corpus(spark, 3)
    assert all(r.kept for r in quality.classify(frame, frame.select("doc_id").filter("false")).collect())


PRIVATE = 'Mail Anna.B7@mail.example.org, anna.b7@MAIL.example.org or +1 (017) 555-7713 (+1-017-555-7713). Mrs. Anna Meyer met Herr Schmidt; Schmidt left. 4111 1111 1111 1111, 97.51.17.173. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 123-45-6789'


def test_pii_surrogates(docs):
    rows = {r.doc_id: r for r in pii.replace_pii(docs([PRIVATE, None, "", "plain 3.14 text 2024", PRIVATE]), "k").collect()}
    text = rows[0].text
    for private in ("anna", "Meyer", "Schmidt", "555-7713", "4111", "97.51", "04dbebab", "123-45"):
        assert private.lower() not in text.lower()
    assert rows[1].text is None and rows[2].text == "" and rows[3].text == "plain 3.14 text 2024" and rows[4].text == text
    mails = re.findall(r"\S+@\S+\.example\.com", text)
    assert len(mails) == 2 and mails[0].strip(",.").lower() == mails[1].strip(",.").lower()
    first, second = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) \(\+1-(\d{3}-\d{3}-\d{4})\)", text).group(1, 2, 3), re.search(r"\(\+1-(\d{3}-\d{3}-\d{4})\)", text)[1]
    assert "-".join(first) == second
    assert re.search(r"Mrs\. (%s) \w+ met Herr (\w+); \2 left" % "|".join(pii.GIVEN["latin"]["f"]), text)
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", text)[0].replace(" ", "")
    assert sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, card))) % 10 == 0
    assert re.search(r'token = "[0-9a-f]{40}"', text)


def test_pii_keeps_entities_apart(spark, docs):
    texts = [f"call 97.51.{i % 250}.{i // 250} or u{i}@a.example.org" for i in range(600)]
    found = pii.mentions(docs(texts)).select("kind", "canon").distinct()
    made = pii.surrogates(found, "k").collect()
    assert len(made) == 1200 == len({(r.kind, r.made) for r in made})
    assert not {r.made for r in made} & {r.canon for r in made}
    assert pii.surrogates(found, "k").exceptAll(pii.surrogates(found, "k")).isEmpty()
    assert pii.surrogates(found, "other").join(pii.surrogates(found, "k"), ["kind", "canon", "made"]).count() < 5


def test_pii_draws_again_when_surrogates_meet(spark, docs, monkeypatch):
    """With so few names that all entities draw the same at first."""
    monkeypatch.setattr(pii, "ONSETS", {k: v[:1] for k, v in pii.ONSETS.items()})
    monkeypatch.setattr(pii, "MIDDLES", {k: v[:2] for k, v in pii.MIDDLES.items()})
    names = ["Abel", "Baker", "Clark", "Davis", "Evans", "Frank"]
    made = pii.surrogates(pii.mentions(docs([f"Mr. {n} came" for n in names])).select("kind", "canon").distinct(), "k").collect()
    assert len({r.made for r in made}) == 6


def test_pii_one_person_under_many_forms(docs):
    texts = ["Mr. John Smith met Dr. John Smith. Mr. Smith left.", "Mrs. Anna Meyer and Dr. Anna Meyer; Alice Brown called. Brown's pen, Alice Brown-Reed.", "Herr Zorn; Zorn went. Mr. Bob Zorn, Ms. Eve Zorn", "Dr. Quill Orme. Quill Orme slept, and Orme\u00a0slept"]
    a, b, c, d = (r.text for r in pii.replace_pii(docs(texts), "k").sort("doc_id").collect())
    male, female = "|".join(pii.GIVEN["latin"]["m"]), "|".join(pii.GIVEN["latin"]["f"])
    assert re.fullmatch(rf"Mr\. ((?:{male}) (\w+)) met Dr\. \1\. Mr\. \2 left\.", a), a
    assert re.fullmatch(rf"Mrs\. ((?:{female}) \w+) and Dr\. \1; ((?:{female}) (\w+)) called\. \3's pen, (?:{female}) \w+\.", b), b
    assert re.fullmatch(rf"Herr (\w+); \1 went\. Mr\. (?:{male}) (\w+), Ms\. (?:{female}) (\w+)", c) and len(set(re.findall(r"\w+", c))) == 9, c
    assert re.fullmatch(r"Dr\. (\w+ (\w+))\. \1 slept, and \2\u00a0slept", d), d


def test_pii_long_texts_and_small_spaces(docs):
    long = ["x@" + "a." * 20_000 + "com", "x" * (1 << 20) + "@a.com", "1" * (1 << 20), "a." * (1 << 19), "Mr. " + "Ab" * (1 << 19), "(1" * (1 << 19), "+1 " * (1 << 18), "AB12 " * (1 << 18), "0a" * (1 << 19), "Mr. " * (1 << 18), "1.1." * (1 << 18)]
    got = pii.replace_pii(docs(long), "k").collect()
    assert len(got) == len(long) and {r.doc_id: len(r.text) for r in got}[1] == len(long[1])
    mails = [f"a@b.{x}{y}{z}" for x in "abcdefghijklmnopqr" for y in "abcdefghijklmnopqr" for z in "abcdefghijklmnop"]
    found = " ".join(r.text for r in pii.replace_pii(docs([" ".join(mails[i::50]) for i in range(50)]), "k").collect()).split()
    assert len(mails) == 5184 == len(found) == len(set(found)) and not set(found) & set(mails) and all(x.endswith(".example.com") for x in found)


def test_pii_ends_when_a_format_leaves_no_room(docs, monkeypatch):
    monkeypatch.setattr(pii, "ATTEMPTS", 3)
    monkeypatch.setattr(pii, "surrogate", lambda kind, canon, h, attempt=0: pii.F.substring(h, 1, 1))
    with pytest.raises(ValueError, match="'ssn': "):
        pii.replace_pii(docs(["%03d-12-3456" % i for i in range(40)]), "k")


def test_pii_equals_what_was_planted(docs):
    """Against a plain version: texts are made of known words and mentions of known entities, so what each must become follows from one map."""
    draw = random.Random(5)
    forms = {
        "email": lambda i: [f"user{i}@mail.example.org", f"USER{i}@mail.example.org"],
        "phone": lambda i: [f"+1 (2{i:02d}) 555-01{i:02d}", f"+1-2{i:02d}-555-01{i:02d}"],
        "ssn": lambda i: [f"1{i:02d}-45-67{i:02d}"],
        "ip": lambda i: [f"10.20.{i}.7"],
        "card": lambda i: [f"4111 1111 1111 11{i:02d}", f"4111-1111-1111-11{i:02d}", f"41111111111111{i:02d}"],
        "iban": lambda i: [f"DE{i:02d} 3704 0044 0532 0130 00", f"DE{i:02d}370400440532013000"],
        "secret": lambda i: [f"{i:02d}c8aa" * 6],
        "name": lambda i: [f"Mr. Tom Fam{chr(97 + i // 26)}{chr(97 + i % 26)}"],
    }
    rows, want = [], []
    for _ in range(120):
        parts = []
        for _ in range(draw.randrange(12)):
            kind, i = draw.choice(sorted(forms)), draw.randrange(30)
            parts += [(None, draw.choice(["plain", "words, and", "so on;", "3.14 of", "(x)"])), ((kind, i), draw.choice(forms[kind](i)))]
        rows.append(" ".join(t for _, t in parts))
        want.append(parts)
    got = {r.doc_id: r for r in pii.replace_pii(docs(rows), "k").collect()}
    squeeze = {"phone": r"\D", "card": r"\D", "iban": " ", "name": r"^Mr\. "}
    made = {}
    for i, parts in enumerate(want):
        # the text as a pattern: plain words as they are, a mention as anything of its own shape
        shape = " ".join(re.escape(t) if not e else r"([\w.+-]+@[\w.-]+)" if e[0] == "email" else r"(Mr\. \w+ \w+)" if e[0] == "name" else "(" + re.sub(r"[A-Za-z0-9]", r"[A-Za-z0-9]", re.sub(r"([+().])", r"\\\1", t)) + ")" if e[0] != "ip" else r"(\d+\.\d+\.\d+\.\d+)" for e, t in parts)
        found = re.fullmatch(shape, got[i].text)
        assert found, (rows[i], got[i].text)
        for (entity, was), new in zip([x for x in parts if x[0]], found.groups()):
            plain = re.sub(squeeze.get(entity[0], "$^"), "", new).lower()
            assert made.setdefault(entity, plain) == plain and new != was
        assert got[i].n_entities == len({t for e, t in parts if e}) and got[i].kinds == sorted({e[0] for e, _ in parts if e})
    assert len(set((k, v) for (k, _), v in made.items())) == len(made) > 150


def test_pii_rows_that_share_an_id_and_clashing_columns(docs):
    rows = [(1, "Mr. Abel Quist"), (1, "no one"), (None, "a@b.org"), (1, "Mr. Abel Quist"), (2, "")]
    frame = docs(rows).selectExpr("*", "1 AS raw", "2 AS kind", "3 AS news", "4 AS names")
    got = sorted((r.doc_id or 0, r.n_entities, r.text) for r in pii.replace_pii(frame, "k").collect())
    assert [x[:2] for x in got] == [(0, 1), (1, 0), (1, 1), (1, 1), (2, 0)] and got[1][2] == "no one" and got[2] == got[3]


def test_pii_empty_table(docs):
    assert pii.replace_pii(docs(["a"]).filter("false"), "k").collect() == []


def test_language_keeps_every_language_whose_rows_share_an_id(spark):
    """Six languages of one id each, which is not held out, English with many; and rows without an id."""
    draw = np.random.default_rng(11)
    alphabets = {lang: ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), draw.integers(2, 8))) for _ in range(60)] for lang in ("de", "en", "es", "fr", "it", "nl", "pt")}
    one = {lang: next(i for i in range(1000 * k, 1000 * k + 50) if zlib.crc32(str(i).encode()) % 4 != 2) for k, lang in enumerate(sorted(alphabets), 1)}
    rows = [(i if lang == "en" else None if i % 7 == 0 else one[lang], " ".join(draw.choice(words, 12)), lang) for lang, words in alphabets.items() for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame.filter(~language.held_out()))
    assert model.languages == sorted(alphabets)
    got = language.language_id(frame)
    assert got.filter("doc_id is null and held_out").count() == 0 and got.filter("held_out is null").count() == 0
    pairs = language.identify(frame.withColumn("doc_id", F.monotonically_increasing_id()), model).join(frame.withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "lang"), "doc_id")
    assert pairs.filter("lang = lang_pred").count() > 0.95 * len(rows)
    only = spark.createDataFrame([(None, "abc def", "x"), (None, "ghi jkl", "y")] * 30, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.language_id(only).collect()} == {"x", "y"}
