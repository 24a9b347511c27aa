"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """The words of a text, by white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(words(F.coalesce(text, F.lit("")))), F.lit(0))


def estimated_tokens(text: Column) -> Column:
    """A fixed estimate: 1.3 for each word, cut to a whole number."""
    return F.floor(n_words(text) * F.lit(13) / F.lit(10)).cast("int")


def snippet(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def ordered(items: Column, *fields: str) -> Column:
    """Structs that were collected in any order, in their own order, as one field or whole."""
    out = F.array_sort(items)
    return F.transform(out, lambda x: x[fields[0]]) if fields else out


def joined(items: Column, field: str, by: str) -> Column:
    return F.array_join(ordered(items, field), by)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def keyed(text: Column) -> Column:
    """The form in which names, types and predicates are compared."""
    return F.lower(F.trim(text))
