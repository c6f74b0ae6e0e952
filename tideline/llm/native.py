"""Column expressions for words and runs of words, with built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what parts words of letters and digits; all but ASCII digits, a-z and non-ASCII characters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z. Null: none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def scanned(items: Column, total, join, zero: Column, inner, size: int = 256) -> Column:
    """A running fold over an array in time linear in its length: an array that grows by one element is copied each time, so the
    items go in pieces. total gives a piece's own total, join adds it to that of all pieces before, beginning with zero, and
    inner(piece, total before it) gives an array; these are put together."""

    def use(pieces: Column) -> Column:
        totals = F.aggregate(F.transform(pieces, total), F.array(zero), lambda acc, t: F.array_append(acc, join(F.element_at(acc, -1), t)))
        return F.flatten(F.zip_with(pieces, F.slice(totals, 1, F.size(pieces)), inner))

    pieces = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda c: F.slice(all_, c * size + 1, size))
    return bound(items, lambda all_: F.when(F.size(all_) > 0, bound(pieces(all_), use)))


def distinct_sorted(items: Column) -> Column:
    """array_sort without repeats; array_distinct compares all pairs of structs."""
    return bound(F.array_sort(items), lambda s: F.filter(s, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(s, i - 1))))


def leading(a: Column, b: Column) -> Column:
    """How many of the first elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int")


def small(index: DataFrame, rows: int) -> bool:
    """Whether a written table has at most so many rows, so that it may be broadcast."""
    return index.limit(rows + 1).count() <= rows


def id_and_text(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_column).cast("bigint").alias(id_column), F.col("text").cast("string").alias("text"))
