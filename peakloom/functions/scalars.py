"""Column functions of the signal domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mass of a proton, spacing of isotopes.
PROTON = 1.00727646687
ISOTOPE = 1.0033548350700006


def ppm_range(mz: Column, ppm: float) -> tuple[Column, Column]:
    """Lowest and highest value within a relative tolerance."""
    return mz * (1 - ppm * 1e-6), mz * (1 + ppm * 1e-6)


def isotope_mz(mono: Column, charge: Column, n: int) -> Column:
    """Array of the first ``n`` isotope positions."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: mono + k * ISOTOPE / charge)


def candidate_hash(idx: Column, rank: Column) -> Column:
    """Index and rank in one number."""
    return idx.cast("long") + F.shiftleft(rank.cast("long"), 32)


def ion_hash(precursor: Column, number: Column, kind: Column, charge: Column, loss: Column) -> Column:
    """Precursor and the parts of a fragment's name in one number."""
    parts = ((number, 32), (kind, 40), (charge, 48), (loss, 56))
    return reduce(lambda s, p: s + F.shiftleft(p[0].cast("long"), p[1]), parts, precursor.cast("long"))


def ppm_error(observed: Column, expected: Column) -> Column:
    """Relative deviation in parts per million."""
    return (observed - expected) / expected * 1e6


def min_max_scale(x: Column, lo: Column, hi: Column, first: Column, last: Column) -> Column:
    """Linear map of [lo, hi] to [first, last]."""
    return (x - lo) / (hi - lo) * (last - first) + first


def logistic(x: Column, mu: Column | float, sigma: Column | float) -> Column:
    """Logistic step."""
    return 1 / (1 + F.exp(-(x - mu) / sigma))


def logistic_rectangle(x: Column, mu1: float, mu2: float, sigma1: float, sigma2: float) -> Column:
    """Difference of two logistic steps."""
    return logistic(x, mu1, sigma1) - logistic(x, mu2, sigma2)


def count_of(text: Column, part: str) -> Column:
    """Number of times that ``part`` occurs."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def safe_pearson(x: str, y: str) -> Column:
    """Aggregate: correlation, 0 where either side does not vary."""
    n, sx, sy = F.count(F.col(x) * F.col(y)), F.sum(x), F.sum(y)
    cov = F.sum(F.col(x) * F.col(y)) - sx * sy / n
    var = (F.sum(F.col(x) * F.col(x)) - sx * sx / n) * (F.sum(F.col(y) * F.col(y)) - sy * sy / n)
    return F.when(var > 1e-12, cov / F.sqrt(var)).otherwise(0.0)


def damped_pearson(x: str, y: str) -> Column:
    """Aggregate: correlation whose denominator is damped, so that it is 0 without variation."""
    n, sx, sy = F.count(F.col(x) * F.col(y)), F.sum(x), F.sum(y)
    cov = F.sum(F.col(x) * F.col(y)) - sx * sy / n
    var = F.greatest(F.sum(F.col(x) * F.col(x)) - sx * sx / n, F.lit(0.0)) * F.greatest(F.sum(F.col(y) * F.col(y)) - sy * sy / n, F.lit(0.0))
    return cov / (F.sqrt(var) + 1e-12)


def cosine(x: Column, y: Column, epsilon: float = 1e-4) -> Column:
    """Cosine of two arrays, damped for near-zero ones."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)) + epsilon)


def above_half(profile: Column, width: Column | float) -> Column:
    """Share of points above half of the maximum, times a width."""
    return F.size(F.filter(profile, lambda v: v > F.array_max(profile) / 2)) / F.size(profile) * width


def log_sum(values: Column) -> Column:
    """Sum of log(1 + v) over an array."""
    return F.aggregate(F.transform(values, lambda v: F.log1p(v)), F.lit(0.0), lambda s, v: s + v)


def translate_mods(mods: Column, mapping: dict[str, str]) -> Column:
    """Replace modification names, taken literally and one after the other."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), mapping.items(), mods)


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate: mean of ``value`` by ``weight``; null where all weights are zero."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def weighted_variance(value: str, weight: str) -> Column:
    """Aggregate: variance of ``value`` by ``weight``."""
    mean = weighted_mean(value, weight)
    return F.try_divide(F.sum(F.col(value) * F.col(value) * F.col(weight)), F.sum(weight)) - mean * mean


def normalise_profile(profile: Column, around: int = 1) -> Column:
    """Profile over the mean of its centre and ``around`` points on both sides; zeros if that is not positive."""
    centre = F.floor(F.size(profile) / 2).cast("int")
    window = F.slice(profile, centre - around + 1, F.lit(2 * around + 1))
    mean = F.aggregate(window, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(window)
    return F.when(mean > 0, F.transform(profile, lambda v: v / mean)).otherwise(F.transform(profile, lambda v: F.lit(0.0)))
