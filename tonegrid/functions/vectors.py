"""Vector algebra over ARRAY columns (EMB1, EMB4, EMB6, SCL13, AGG15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(a: Column) -> Column:
    """EMB1; a zero vector gives NULLs."""
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def probe(a: Column, coefficients: Column, intercept: Column) -> Column:
    """EMB4: linear read-out clipped to [-1, 1]."""
    return F.least(F.greatest(dot(a, coefficients) + intercept, F.lit(-1.0)), F.lit(1.0))


def pearson(a: Column, b: Column) -> Column:
    """SCL13: correlation of two arrays, norms floored at 1e-12."""
    centre = lambda v: F.transform(v, lambda x: x.cast("double") - total(v) / F.size(v))
    ca, cb = centre(a), centre(b)
    return dot(ca, cb) / (F.greatest(norm(ca), F.lit(1e-12)) * F.greatest(norm(cb), F.lit(1e-12)))


def normalised_entropy(a: Column, bins: int = 12) -> Column:
    """AGG15: entropy of a non-negative array over log2(bins)."""
    s = total(a)
    return -F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.when(x > 0, x / s * F.log2(x / s)).otherwise(0.0)) / F.log2(F.lit(float(bins)))


def flatten_columns(vector: str, prefix: str, size: int) -> list[Column]:
    """EMB6: one zero-padded column per element (three digits, four from 1 000 elements on)."""
    width = 4 if size > 999 else 3
    return [F.col(vector)[i].alias(f"{prefix}_{i:0{width}d}") for i in range(size)]
