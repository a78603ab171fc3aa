"""Scalar and windowed score functions."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def negative_score(frontier: Column, born: Column, low: Column, high: Column, unit: Column, horn: Column, conj_dist: Column) -> Column:
    spread = F.when(born.isNull() | (high <= low), 0.0).otherwise((born - low) / (high - low))
    near = F.when(conj_dist.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 5.0 - conj_dist))
    yes = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    return yes(frontier, 12.0) + 5.0 * spread + yes(unit, 3.0) + yes(horn, 1.0) + near


def fallback_raw(formula: Column, conj_dist: Column, horn: Column, support: Column | None = None) -> Column:
    """Score of a clause when no ranker answers, before scaling."""
    base = F.when(conj_dist >= 0, 2.0 / (1.0 + conj_dist)).otherwise(0.2)
    yes = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    score = base + yes(~F.contains(formula, F.lit("|")), 0.5) + yes(F.contains(formula, F.lit("=")), 0.3) + yes(horn, 0.2)
    return score + F.when(support.isNotNull(), 0.3 * (1.0 - support)).otherwise(0.0) if support is not None else score


def normalized(score: Column, by: list[str], how: str, temperature: float = 1.0) -> Column:
    """softmax, minmax (flat: 0.5) or zscore over the rows of ``by``."""
    w = Window.partitionBy(*by)
    if how == "softmax":
        e = F.exp((score - F.max(score).over(w)) / max(temperature, 1e-6))
        return e / F.sum(e).over(w)
    if how == "minmax":
        low, high = F.min(score).over(w), F.max(score).over(w)
        return F.when(high - low < 1e-9, 0.5).otherwise((score - low) / (high - low))
    if how == "zscore":
        sd = F.coalesce(F.nullif(F.stddev_samp(score).over(w), F.lit(0.0)), F.lit(1.0))
        return (score - F.avg(score).over(w)) / sd
    return score


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def projected(vector: Column, size: Column, seed: int = 0) -> Column:
    """A vector by a fixed matrix of ``size`` rows, whose entries follow from the seed and their place."""
    entry = lambda i, j: F.sin(seed + 12.9898 * (i + 1) + 78.233 * (j + 1))
    scale = F.sqrt(F.size(vector).cast("double"))
    row = lambda j: F.aggregate(F.transform(vector, lambda x, i: x.cast("double") * entry(i, j)), F.lit(0.0), lambda t, x: t + x) / scale
    return F.transform(F.sequence(F.lit(0), size - 1), row)


def dot_of_any(a: Column, b: Column, seed: int = 0) -> Column:
    """The dot product; where one vector is longer, it is projected to the other's length first."""
    least = F.least(F.size(a), F.size(b))
    fit = lambda v: F.when(F.size(v) > least, projected(v, least, seed)).otherwise(F.transform(v, lambda x: x.cast("double")))
    return dot(fit(a), fit(b))


def pmi(conditional: Column, unconditional: Column, weight: float = 0.7) -> Column:
    return conditional - weight * unconditional


def budget(n: Column) -> tuple[Column, Column]:
    """Tier and number of clauses kept, by the number of candidates."""
    tier = F.when(n <= 80, "S").when(n <= 400, "A").when(n <= 2000, "B").when(n <= 10000, "C").otherwise("D")
    kept = F.when(n <= 80, n).when(n <= 400, 200).when(n <= 2000, 128).when(n <= 10000, 64).otherwise(48)
    return tier, kept


def hook(equation: Column, touches: Column, first: Column, shared: Column) -> Column:
    return F.when(equation, 1.0).when(touches & first, 0.85).otherwise(F.least(F.lit(0.6), F.lit(0.15) * shared))


def priority(equation: Column, touches: Column, first: Column, shared: Column, unit: Column, weight: Column) -> Column:
    value = F.when(equation, 3000).otherwise(0) + F.when(touches & first, 1000).otherwise(0)
    value = value + 5 * (hook(equation, touches, first, shared) * 100).cast("int") + F.when(unit, 50).otherwise(0)
    return value - (F.lit(0.3) * weight).cast("int")
