"""Scalar functions that features, labels and displays are made of."""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scales of the cosine vector and of the radial profile.
TEMPO_DIV, MODE_DIV_COSINE, MODE_DIV_RADIAL = 10_000, 4, 5
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def dot(a: list[Column], b: list[Column]) -> Column:
    """Sum of products as plain arithmetic, which stays inside generated code."""
    return reduce(lambda x, y: x + y, (p * q for p, q in zip(a, b, strict=True)))


def cosine(a: list[Column], b: list[Column], norm_a: Column, norm_b: Column) -> Column:
    """0 where a norm is 0; nine decimals, so that thresholds and ordinals don't hang on the last bit."""
    return F.round(F.coalesce(F.try_divide(dot(a, b), norm_a * norm_b), F.lit(0.0)), 9)


def list_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles."""
    sums = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(sums(a, b), F.sqrt(sums(a, a)) * F.sqrt(sums(b, b))), F.lit(0.0))


def bubble_radius(value: Column) -> Column:
    """Square-root scale from [1, 300] to [10, 80], unclamped."""
    return 10 + 70 * (F.sqrt(value.cast("double")) - 1) / (sqrt(300) - 1)


def edge_weight(score: Column) -> Column:
    return F.log10(score * 100)


def quoted_list(items: Column) -> Column:
    """A list of strings as text: ['a', "it's"]."""
    quote = lambda x: F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(F.transform(items, quote), ", "), F.lit("]"))


def owner_name(owner: Column) -> Column:
    """The display name in an owner document ["name", "uri"]; Unknown without one."""
    return F.coalesce(F.get_json_object(owner, "$[0]"), F.lit("Unknown"))


def is_email(address: Column) -> Column:
    return F.coalesce(F.trim(address).rlike(EMAIL), F.lit(False))


def bubble_value(key: Column) -> Column:
    """15 to 80, the same for the same key."""
    return (F.pmod(key * 7919, F.lit(66)) + 15).cast("int")


def playlist_label(owner: Column, name: Column, description: Column) -> Column:
    return F.concat(owner, F.lit(" Playlist - "), name, F.lit(":\n "), F.substring(description, 1, 50))
