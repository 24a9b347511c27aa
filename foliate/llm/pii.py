"""Surrogates for personal data: keyed, of the same type, gender, script and format. Built-in functions only.

Mentions are found by one pattern. A mention's canonical form (digits of a number, lower case of an address, name without its title)
is the entity: all its mentions, in whatever format, get the same surrogate, written in each mention's own format. A person's gender comes from the
titles that the corpus gives that name, else from the given name; a family name with a title is the one person of that text who has it, if there is
one. Surrogates come from a keyed hash of type, canonical form and attempt. Those that two entities would share, or that are themselves found in
the corpus, are drawn again for all but one of the entities, from larger spaces, until every entity has one of its own; persons never share a
family name. Where the format leaves no more room (all of a type's numbers taken), the job ends with an error that says so.

Edge cases: null and empty texts stay as they are. A text without a mention is returned unchanged. Repeated rows are changed alike; rows that share
an id are changed by their own texts, null ids as well. Ties between attempts go to the smallest hash. Long texts are matched from end to end, each
stretch once: no pattern repeats a group without bound, so none can exhaust the stack. Addresses have the lengths that mail allows (64 characters
before the @, 127 labels of 63). Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import cut, row_key

#: Titles by gender, and syllables of surrogate names by script.
TITLES = {"m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "госпожа", "κυρία"], "n": ["Dr", "Prof"]}
GIVEN = {
    "latin": {"m": "Adam Anton Bruno Carl David Emil Felix Hugo Jonas Leon Lukas Marc Oscar Paul Simon Victor".split(), "f": "Alice Anna Clara Diana Elena Emma Eva Julia Laura Lena Maria Nora Olivia Paula Sara Vera".split()},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Иван Лев Олег".split(), "f": "Алла Анна Вера Дарья Елена Ирина Нина Ольга".split()},
    "greek": {"m": "Άρης Γιώργος Ηλίας Νίκος Πέτρος Σταύρος Φώτης Χρήστος".split(), "f": "Άννα Δάφνη Ελένη Ζωή Ιωάννα Μαρία Νίκη Σοφία".split()},
}
ONSETS = {"latin": "B Br C D F G H K L M N P R S T V".split(), "cyrillic": "Б В Г Д З К Л М Н П Р С Т Ф Х Ш".split(), "greek": "Β Γ Δ Ζ Θ Κ Λ Μ Ν Π Ρ Σ Τ Φ Χ Ψ".split()}
MIDDLES = {"latin": "al an ar el en er il in ol on or ul un ent ist and".split(), "cyrillic": "ал ан ар ел ен ер ил ин ол он ор ул ун ов ев ив".split(), "greek": "αλ αν αρ ελ εν ερ ιλ ιν ολ ον ορ υλ υν ατ ετ ακ".split()}

#: Given names by gender, besides those above, that tell a person without a title.
KNOWN = {"m": "James John Robert Michael William Thomas Peter Hans Jean Pierre Juan Carlos José".split(), "f": "Mary Patricia Jennifer Elizabeth Susan Anne Marie Carmen Lucía Ana Ingrid Petra".split()}

_TITLE = "|".join(sorted((t for own in TITLES.values() for t in own), key=len, reverse=True))
_GIVEN = {g: sorted({x for own in GIVEN.values() for x in own[g]} | set(KNOWN[g])) for g in ("m", "f")}
_ANY_GIVEN = "|".join(sorted((x for own in _GIVEN.values() for x in own), key=len, reverse=True))
_WORD = r"\p{Lu}(?:\p{L}{1,63}+|(?=['’-]\p{Lu}))(?:['’-]\p{Lu}\p{L}{0,63}+){0,3}"
#: White space within a name: a space, or one that does not break.
_GAP = "[ \u00a0]"
_NAME = rf"(?:{_TITLE})\.?{_GAP}{_WORD}(?:{_GAP}{_WORD})?|(?=\p{{Lu}})(?:{_ANY_GIVEN}){_GAP}{_WORD}"
#: The form of each type; the first type that a mention has is its type.
FORMS = {
    "email": r"[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){0,125}\.\p{L}{2,63}",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])",
    "card": r"\d{13,19}(?!\d)|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": r"(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "name": _NAME,
}
PATTERN = r"(?<![\p{L}\p{N}._%+-])(?:" + "|".join(FORMS.values()) + ")"


#: Between any two characters.
BETWEEN = r"(?s)(?<=.)(?=.)"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def kind_of(raw: Column) -> Column:
    out = F.lit("name")
    for kind, form in reversed([x for x in FORMS.items() if x[0] != "name"]):
        out = F.when(raw.rlike(f"^(?:{form})$"), kind).otherwise(out)
    return out


def bare_name(raw: Column) -> Column:
    return F.regexp_replace(raw, rf"^(?:{_TITLE})\.?{_GAP}", "")


def canonical(kind: Column, raw: Column) -> Column:
    """Of a name: in lower case, without its title."""
    name = F.lower(F.regexp_replace(bare_name(raw), f"{_GAP}+", " "))
    return F.when(kind.isin("phone", "card", "ssn"), _digits(raw)).when(kind.isin("email", "secret"), F.lower(raw)).when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))).when(kind == "name", name).otherwise(raw)


def titled(raw: Column, gender: str) -> Column:
    return raw.rlike(rf"^(?:{'|'.join(TITLES[gender])})\b")


def last_word(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def persons(found: DataFrame) -> DataFrame:
    """Names among found(key, raw, kind, canon), with the canonical form of the person: name|gender|script.

    Who has both titles in the corpus is two persons. A single name with a title is the one person of its text with that family name.
    """
    own = found.filter("kind = 'name'").select("key", "raw", "kind", "canon", titled(F.col("raw"), "m").alias("m"), titled(F.col("raw"), "f").alias("f"))
    of_name = cut(own.groupBy("canon").agg(F.max("m").alias("any_m"), F.max("f").alias("any_f")))
    first = F.substring_index("canon", " ", 1)
    given = F.when(~F.col("canon").contains(" "), "n")
    for g in ("m", "f"):
        given = given.when(first.isin([x.lower() for x in _GIVEN[g]]), g)
    title = F.when(F.col("m"), "m").when(F.col("f"), "f")
    both = F.col("any_m") & F.col("any_f")
    gender = F.when(both, F.coalesce(title, F.lit("n"))).when(F.col("any_m"), "m").when(F.col("any_f"), "f").otherwise(given.otherwise("n"))
    script = F.when(F.col("canon").rlike(r"^\p{IsCyrillic}"), "cyrillic").when(F.col("canon").rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    named = cut(own.join(of_name, "canon").select("key", "raw", "kind", "canon", title.alias("title"), gender.alias("gender"), F.concat_ws("|", "canon", gender, script).alias("person")))
    whole = named.filter(F.col("canon").contains(" ")).select("key", last_word(F.col("canon")).alias("canon"), F.col("person").alias("whole"), F.col("gender").alias("g"))
    one = cut(whole.groupBy("key", "canon").agg(F.min("whole").alias("whole"), F.max("whole").alias("other"), F.min("g").alias("g")).filter("whole = other"))
    fits = F.col("title").isNull() | (F.col("g") == "n") | (F.col("g") == F.col("title"))
    joined = named.join(one, ["key", "canon"], "left")
    return joined.select("key", "raw", "kind", F.when(~F.col("canon").contains(" ") & fits, F.col("whole")).alias("whole"), "person").select("key", "raw", "kind", F.coalesce("whole", "person").alias("canon"))


def _byte(h: Column, i: Column) -> Column:
    """The i-th byte of a hex string of 64 bytes, from 0, again from the start after the last."""
    return F.conv(F.substring(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(h: Column, at: int, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in values]), _byte(h, F.lit(at)) % len(values))


def _like(s: Column, h: Column, hexadecimal: bool = False) -> Column:
    """Digits for digits, small letters for letters, the rest as it is."""

    def one(c: Column, i: Column) -> Column:
        if hexadecimal:
            return F.substring(F.lit("0123456789abcdef"), _byte(h, i) % 16 + 1, F.lit(1))
        digit, letter = F.substring(F.lit("0123456789"), _byte(h, i) % 10 + 1, F.lit(1)), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _byte(h, i) % 26 + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(s, BETWEEN), one), "")


def _luhn(digits: Column) -> Column:
    """Of all digits but the last: the sum by which a check digit is found."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits) - 1), F.lit(0), add)


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn(digits) % 10) % 10).cast("string")


def surrogate(kind: Column, canon: Column, h: Column, attempt: int = 0) -> Column:
    """The canonical form of the surrogate, from 64 bytes of hash in hex. Later attempts draw from larger spaces."""
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    more = _like(F.lit("a" * min(40, max(0, attempt - 1))), F.reverse(h))
    email = F.concat(_like(local, h), more, F.lit("@"), F.replace(_like(F.regexp_replace(domain, r"\.[^.]*$", ""), F.reverse(h)), F.lit("."), F.lit("-")), F.lit(".example.com"))
    ip = F.concat_ws(".", (240 + _byte(h, F.lit(0)) % 15 if attempt < 4 else 1 + _byte(h, F.lit(0)) % 254).cast("string"), *[_byte(h, F.lit(i)).cast("string") for i in (1, 2, 3)])
    digits = _like(canon, h)
    last = F.substring(canon, F.length(canon), F.lit(1))
    checked = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), _check_digit(digits))
    card = F.when(last == _check_digit(canon), checked).otherwise(digits)
    phone = F.concat(F.substring(canon, F.lit(1), F.length(canon) - 10), _like(F.substring(canon, F.greatest(F.lit(1), F.length(canon) - 9), F.lit(10)), h)) if attempt < 4 else digits
    iban = F.concat(F.substring(canon, 1, 2), F.upper(_like(F.substring(canon, F.lit(3), F.length(canon)), h)))
    parts = F.split(canon, r"\|")
    name = None
    for script in ONSETS:
        family = F.concat(_pick(h, 0, ONSETS[script]), *[_pick(h, i, MIDDLES[script]) for i in range(5, 8 + attempt // 2)])
        given = F.when(F.get(parts, F.lit(1)) == "m", _pick(h, 4, GIVEN[script]["m"])).when(F.get(parts, F.lit(1)) == "f", _pick(h, 4, GIVEN[script]["f"])).otherwise(_pick(h, 4, GIVEN[script]["m"] + GIVEN[script]["f"]))
        whole = F.when(F.get(parts, F.lit(0)).contains(" "), F.concat_ws(" ", given, family)).otherwise(family)
        name = whole if name is None else F.when(F.get(parts, F.lit(2)) == script, whole).otherwise(name)
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
    return out.when(kind == "iban", iban).when(kind == "secret", _like(canon, h, True)).when(kind == "name", name).otherwise(digits)


def render(kind: Column, raw: Column, made: Column) -> Column:
    """A surrogate in the format of a mention."""

    def digit(c: Column, i: Column) -> Column:
        nth = F.length(_digits(F.substring(raw, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9]"), F.substring(made, nth, F.lit(1))).otherwise(c)

    poured = F.array_join(F.transform(F.split(raw, BETWEEN), digit), "")
    grouped = F.when(raw.contains(" "), F.trim(F.regexp_replace(made, "(.{4})", "$1 "))).otherwise(made)
    upper = F.when(raw == F.upper(raw), F.upper(made)).otherwise(made)
    bare = bare_name(raw)
    named = F.concat(F.substring(raw, F.lit(1), F.length(raw) - F.length(bare)), F.when(bare.rlike(_GAP), made).otherwise(last_word(made)))
    return F.when(kind.isin("phone", "card", "ssn"), poured).when(kind == "iban", grouped).when(kind == "secret", upper).when(kind == "name", named).otherwise(made)


def mentions(docs: DataFrame) -> DataFrame:
    """key (of the row), raw, kind, canon of the distinct mentions of each document."""
    raw = docs.filter("text is not null").select(row_key().alias("key"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))).alias("raw"))
    found = cut(raw.withColumn("kind", kind_of(F.col("raw"))).withColumn("canon", canonical(F.col("kind"), F.col("raw"))).distinct())
    return found.filter("kind <> 'name'").unionByName(persons(found))


#: Draws for one entity, after which the job ends: by then every type's space has been used to its full width many times.
ATTEMPTS = 60


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, made for distinct entities(kind, canon): no two of a kind share one (persons: a family name), and none is found in the corpus."""
    unique = lambda kind, form: F.lower(F.when(kind == "name", last_word(form)).otherwise(form))
    left, given = entities, []
    taken = cut(entities.select("kind", unique(F.col("kind"), F.substring_index("canon", "|", 1)).alias("low")).distinct())
    for attempt in range(ATTEMPTS):
        h = F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "canon", F.lit(attempt)), 512)
        drawn = left.withColumn("h", h).withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("h"), attempt)).withColumn("low", unique(F.col("kind"), F.col("made")))
        for own in (taken, *given):
            drawn = drawn.join(own.select("kind", "low"), ["kind", "low"], "left_anti")
        won = drawn.groupBy("kind", "low").agg(F.min(F.struct("h", "canon", "made")).alias("x"))
        given.append(cut(won.select("kind", "low", "x.canon", "x.made")))
        left = cut(left.join(given[-1].select("kind", "canon"), ["kind", "canon"], "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, given).select("kind", "canon", "made")
    counts = {r.kind: r.n for r in left.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each type
    raise ValueError(f"no surrogates left for {counts}: their formats leave no room for as many distinct ones")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def with_names(text: Column, names: Column) -> Column:
    """text with each of the names (a map) that stands in it as one or two whole words replaced, all at once."""

    def put(w: Column) -> Column:
        def pair(i: Column) -> Column:
            """The surrogate of the two words from a place, if they are a name."""
            return F.when((i >= 0) & F.get(w, i + 1).isin(" ", "\u00a0"), F.element_at(names, F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 2))))

        def one(word: Column, i: Column) -> Column:
            within = pair(i - 1).isNotNull() | pair(i - 2).isNotNull()
            return F.coalesce(F.when(within, ""), pair(i), F.element_at(names, word), word)

        return F.array_join(F.transform(w, one), "")

    return let(F.regexp_extract_all(text, F.lit(r"\p{L}++(?:['’-]\p{Lu}\p{L}*+){0,3}|[^\p{L}]+"), F.lit(0)), put)


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """Every row of docs(doc_id, text): doc_id, text with surrogates, n_entities (distinct mentions), kinds.

    A name that was met with its title, or by its given name, is also replaced where it stands in the same text without one.
    """
    found = cut(mentions(docs))
    made = surrogates(cut(found.select("kind", "canon").distinct()), key)
    placed = cut(found.join(made, ["kind", "canon"]).withColumn("new", render(F.col("kind"), F.col("raw"), F.col("made"))))
    of_doc = placed.groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("news"), F.count(F.lit(1)).alias("n_entities"), F.array_sort(F.collect_set("kind")).alias("kinds")
    )
    bare = F.regexp_replace(bare_name(F.col("raw")), f"{_GAP}+", " ")
    people = placed.filter("kind = 'name'").select("key", bare.alias("bare"), "made")
    whole = F.col("bare").contains(" ")
    short = people.select("key", last_word(F.col("bare")).alias("bare"), last_word(F.col("made")).alias("put"), whole.alias("whole"))
    # a family name alone is whom a title gives it to, else the one who has it in full
    short = short.groupBy("key", "bare").agg(F.min(F.struct("whole", "put")).alias("x")).select("key", "bare", "x.put")
    full = people.filter(whole).groupBy("key", "bare").agg(F.min("made").alias("put"))
    names = full.unionByName(short).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bare", "put"))).alias("names"))
    joined = docs.select("doc_id", "text", row_key().alias("key")).join(of_doc.join(names, "key", "left"), "key", "left")
    gaps, marks = F.split("text", PATTERN), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    named = lambda gap: F.when(F.col("names").isNotNull(), with_names(gap, F.col("names"))).otherwise(gap)
    built = F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), marks.alias("mark")), lambda x: F.concat(named(x["gap"]), F.coalesce(F.element_at("news", x["mark"]), F.lit("")))), "")
    text = F.when(F.col("n_entities").isNull(), F.col("text")).otherwise(built)
    return joined.select("doc_id", text.alias("text"), F.coalesce("n_entities", F.lit(0).cast("long")).alias("n_entities"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
