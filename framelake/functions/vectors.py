"""Column functions on embeddings (arrays of numbers) and on scores made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a, b) -> Column:
    """Sum of products from left to right, in double."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(a)
    return F.transform(doubles(a), lambda x: F.when(n > 0, x / n).otherwise(x))


def cosine(a, b) -> Column:
    """0 where either norm is 1e-12 or less."""
    n, m = norm(a), norm(b)
    return F.when((n > 1e-12) & (m > 1e-12), dot(a, b) / (n * m)).otherwise(0.0)


def hybrid_score(dense: Column, sparse: Column, alpha: float | Column = 0.9) -> Column:
    """alpha weighs the sparse side."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return (1 - a) * dense + a * sparse


def cluster_thresholds(n: Column) -> tuple[Column, Column]:
    """Similarities below which a vector opens a cluster of level one, level two, at n vectors."""
    scale = F.log10(F.greatest(n, F.lit(10)) / 10.0)
    return F.greatest(F.lit(0.52), 0.72 - 0.04 * scale), F.greatest(F.lit(0.68), 0.85 - 0.04 * scale)


def probe_counts(n_l1: Column, n_l2: Column) -> tuple[Column, Column]:
    """Clusters of level one, and of level two in each, that a query looks into."""
    mean = n_l2 / F.greatest(n_l1, F.lit(1))
    first = F.greatest(F.lit(1), F.least(n_l1, F.ceil(F.sqrt(n_l1))))
    return first.cast("int"), F.greatest(F.lit(1), F.least(F.floor(mean), F.ceil(F.sqrt(mean)))).cast("int")


def sigmoid(x: Column, a: float = 1.0, b: float = 0.0, clip: float = 50.0) -> Column:
    """Platt's form: 1 / (1 + exp(-(a x + b))), the exponent held to +-clip."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), a * x + b))))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """Learning rate factor: linear to 1 over warmup steps, then half a cosine to 0."""
    return F.when(step < warmup, step / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.pi() * (step - warmup) / max(1, total - warmup)))))


def sts_normalised(score: Column) -> Column:
    """Above 1: of 5; then to -1..1."""
    return F.when(score > 1, score / 5).otherwise(score) * 2 - 1


def pooled(tokens: Column, mask: Column, how: str = "mean") -> Column:
    """Masked mean or max over an array of token vectors."""
    rows = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] != 0)
    rows = F.transform(rows, lambda x: x["t"])
    first = F.get(rows, F.lit(0))
    if how == "max":
        return F.aggregate(rows, first, lambda s, x: F.zip_with(s, x, lambda a, b: F.greatest(a, b)))
    total = F.aggregate(rows, F.transform(first, lambda x: x * 0.0), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(rows))
