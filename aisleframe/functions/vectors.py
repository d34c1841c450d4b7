"""Vector column expressions over ARRAY columns, accumulated in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )


def unit(v: Column) -> Column:
    """L2-normalised vector; a zero vector stays zero."""
    n = norm(v)
    wide = v.cast("array<double>")
    return F.when(n > 0, F.transform(wide, lambda x: x / n)).otherwise(wide)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def softmax_weight(score: Column, best: Column, temperature: float) -> Column:
    """Unnormalised softmax term, stabilised by the group's best score."""
    return F.exp((score - best) / F.lit(temperature))
