"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; null for a zero vector."""
    lengths = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return 1 - F.try_divide(dot(a, b), lengths)


def hashed_embedding(words: Column, size: int = 64) -> Column:
    """Deterministic default embedder: signed counts of hashed words; another embedder may take its place."""
    place = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(F.lower(w)), F.lit(size)).alias("k"), (F.pmod(F.xxhash64(F.lower(w), F.lit(1)), F.lit(2)) * 2 - 1).alias("sign")))
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.aggregate(place, F.lit(0.0), lambda s, x: s + F.when(x["k"] == i, x["sign"].cast("double")).otherwise(0.0)).cast("float"),
    )
