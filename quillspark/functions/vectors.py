"""Vector expressions for single rows; bulk scoring is in operators.similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """NULL for null or all-zero vectors and for unequal lengths."""
    return F.when(F.size(_c(a)) == F.size(_c(b)), F.try_divide(dot(a, b), norm(a) * norm(b)))


def is_zero(a: Column | str) -> Column:
    return F.forall(_c(a), lambda v: v == 0)


def parse_vector(text: Column | str) -> Column:
    """'[a,b,...]' to array<float>."""
    return F.from_json(_c(text), "array<float>")
