"""Vector scalars for pairs that already sit in one row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; unequal dimensions raise, a zero vector scores 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    scale = norm(a) * norm(b)
    return (
        F.when(F.size(a) != F.size(b), F.raise_error(F.lit("embedding dimension mismatch")).cast("double"))
        .when(scale == 0, F.lit(0.0))
        .otherwise(dot(a, b) / scale)
    )


def length_embedding(text: Column) -> Column:
    """A tiny deterministic embedder for fixtures: [len % 7, len % 3, 1]."""
    n = F.length(text)
    return F.array((n % 7).cast("double"), (n % 3).cast("double"), F.lit(1.0))


def digest_embedding(text: Column) -> Column:
    """A stand-in vector of width 64: the hexadecimal digits of the text's digest, centred."""
    place = lambda c: F.ascii(c) - F.when(c > "9", 86).otherwise(47)
    return F.transform(F.split(F.sha2(text, 256), ""), lambda c: place(c).cast("double") - 8.5)
