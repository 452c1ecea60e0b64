"""Vectors as array columns; sums run in double, in index order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import let, words


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(vector), lambda x: x * x)))


def l1_normalize(vector: Column) -> Column:
    norm = F.greatest(_sum(F.transform(as_double(vector), F.abs)), F.lit(fixed.L1_FLOOR))
    return let(norm, lambda n: F.transform(as_double(vector), lambda x: x / n))


def mean_vector(vectors: Column, dims: int) -> Column:
    """Mean of an array of vectors in one row; NULL when there is none."""
    return let(
        vectors,
        lambda rows: F.when(
            F.size(rows) > 0,
            F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: _sum(F.transform(rows, lambda r: F.get(r, j))) / F.size(rows)),
        ),
    )


def cosine(a: Column, b: Column) -> Column:
    """NULL when either vector is zero."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """Counts of lower-case words by md5 bucket, scaled to unit length (zero text stays zero).

    A lexical stand-in for a sentence model, the same in any engine that has md5.
    """
    buckets = F.transform(
        words(F.lower(text)),
        lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int"),
    )
    zero = F.array_repeat(F.lit(0.0), dims)

    def counted(hits: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda d: F.size(F.filter(hits, lambda h: h == d)).cast("double"),
        )

    def scaled(counts: Column) -> Column:
        return let(l2_norm(counts), lambda n: F.when(n == 0, zero).otherwise(F.transform(counts, lambda x: x / n)))

    return let(let(buckets, counted), scaled)
