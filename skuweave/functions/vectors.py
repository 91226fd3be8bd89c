"""Vector rules as Column functions over array columns; scores from 0 to 100.

These are exact and run in the JVM, but arrays are interpreted element by element: for scoring many pairs of embeddings use
operators.knn, which multiplies blocks in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalized(h: Column) -> Column:
    """Sums to 1; uniform when the sum is 0, NaN or infinite."""
    h = h.cast("array<double>")
    total = _sum(h)
    bad = (total == 0) | F.isnan(total) | (F.abs(total) == float("inf"))
    return F.transform(h, lambda x: F.when(bad, 1 / F.size(h)).otherwise(x / total))


def color_similarity(a: Column, b: Column) -> Column:
    met = _sum(F.zip_with(normalized(a), normalized(b), lambda x, y: F.least(x, y)))
    return F.least(F.greatest(met * 100, F.lit(0.0)), F.lit(100.0))


def shape_similarity(a: Column, b: Column) -> Column:
    far = F.sqrt(_sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))))
    return F.exp(-far / 2) * 100


def texture_similarity(a: Column, b: Column) -> Column:
    chi = 0.5 * _sum(F.zip_with(normalized(a), normalized(b), lambda x, y: (x - y) * (x - y) / (x + y + 1e-10)))
    return F.exp(-chi / 0.5) * 100


def combined_similarity(color: Column, shape: Column, texture: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    if min(weights) < 0 or abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must be 0 at least and add up to 1")
    return color * weights[0] + shape * weights[1] + texture * weights[2]


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null when either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, F.least(F.greatest(dot(a, b) / scale, F.lit(-1.0)), F.lit(1.0)))


def scaled(cos: Column, scale: str = "shifted") -> Column:
    """shifted: (cos + 1) / 2 * 100, 0 for zero vectors; cosine: cos * 100."""
    if scale not in ("shifted", "cosine"):
        raise ValueError(f"unknown scale {scale}")
    return F.coalesce((cos + 1) / 2 * 100 if scale == "shifted" else cos * 100, F.lit(0.0))


def embedding_similarity(a: Column, b: Column, scale: str = "shifted") -> Column:
    return scaled(cosine(a, b), scale)


def feature_error(v: Column, dim: int | None = None) -> Column:
    """A code for what is wrong with a vector, or null."""
    return (
        F.when(v.isNull(), "MISSING_FEATURES")
        .when(F.size(v) == 0, "EMPTY_FEATURES")
        .when((F.size(v) != dim) if dim else F.lit(False), "FEATURE_DIMENSION_MISMATCH")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "NAN_FEATURES")
        .when(F.exists(v, lambda x: F.abs(x) == float("inf")), "INF_FEATURES")
    )


def feature_warning(v: Column) -> Column:
    return F.when((F.size(v) > 0) & F.forall(v, lambda x: x == 0), "ALL_ZERO")
