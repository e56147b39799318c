"""Vector expressions: norms, dot products and cosine similarity on array columns.

Built from higher-order functions (``zip_with`` + ``aggregate``), so they run in
the JVM with no Python round trip. Arithmetic is done in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """dot(a,b)/(|a||b|); null when either vector has zero length."""
    bn = b_norm if b_norm is not None else norm(b)
    denom = norm(a) * bn
    return F.when(denom > 0, dot(a, b) / denom)


def similarity_score(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """Reported score: round(1 - cosine distance, 4) = round(cosine similarity, 4)."""
    return F.round(cosine_similarity(a, b, b_norm), 4)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
