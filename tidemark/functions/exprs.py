"""Column builders for the numeric primitives of the decoder; all stay inside code generation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

EPS = 1e-15
LOG_EPS = math.log(EPS)
_LOG_SQRT_TAU = 0.5 * math.log(2 * math.pi)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def normal_logpdf(x, mean, std) -> Column:
    """Log density of a normal distribution."""
    z = (_c(x) - _c(mean)) / _c(std)
    return F.lit(-0.5) * z * z - F.log(_c(std)) - F.lit(_LOG_SQRT_TAU)


def normal_pdf(x, mean, std) -> Column:
    return F.exp(normal_logpdf(x, mean, std))


def product_logpdf(x: Sequence, mean: Sequence, std: Sequence) -> Column:
    """Log density of independent normals, one per dimension."""
    total = F.lit(0.0)
    for a, m, s in zip(x, mean, std, strict=True):
        total = total + normal_logpdf(a, m, s)
    return total


def safe_log(x, eps: float = EPS) -> Column:
    """Logarithm with magnitudes under ``eps`` raised to ``eps``."""
    x = _c(x)
    return F.log(F.when(F.abs(x) < eps, F.lit(eps)).otherwise(x))


def safe_divide(x, y, eps: float = EPS) -> Column:
    """Quotient, or ``eps`` where the denominator is under ``eps``."""
    return F.when(F.abs(_c(y)) < eps, F.lit(eps)).otherwise(_c(x) / _c(y))


def log_or_neginf(x) -> Column:
    """Logarithm with log 0 = -infinity (the form the hidden Markov model uses)."""
    return F.when(_c(x) <= 0, F.lit(float("-inf"))).otherwise(F.log(_c(x)))


def divide_or_zero(x, y) -> Column:
    """Quotient with x / 0 = 0."""
    return F.when(_c(y) == 0, F.lit(0.0)).otherwise(_c(x) / _c(y))


def xlogy(n, rate) -> Column:
    """n * log(rate) with 0 * log(0) = 0."""
    return F.when(_c(n) == 0, F.lit(0.0)).otherwise(_c(n) * F.log(_c(rate)))


def poisson_loglik(n, rate) -> Column:
    """Poisson log likelihood without the factorial, which no state depends on."""
    return xlogy(n, rate) - _c(rate)


def nan_to(x, value: float) -> Column:
    return F.when(_c(x).isNull() | F.isnan(_c(x)), F.lit(value)).otherwise(_c(x))


def is_finite(x) -> Column:
    return ~F.isnan(_c(x)) & (F.abs(_c(x)) != float("inf"))


def clip(x, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


def softmax(logits: Column) -> Column:
    """Softmax of an array."""
    return F.element_at(F.transform(F.array(F.array_max(logits)), lambda m: _normal(F.transform(logits, lambda x: F.exp(x - m)))), 1)


def _normal(weights: Column) -> Column:
    return F.element_at(F.transform(F.array(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)), lambda s: F.transform(weights, lambda x: x / s)), 1)


def centered_softmax(logits: Column) -> Column:
    """Softmax of n - 1 free logits and a last one fixed at 0."""
    return softmax(F.concat(logits, F.array(F.lit(0.0))))


def centered_softmax_inverse(p: Column) -> Column:
    """Log ratios to the last probability."""
    return F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: F.log(x / F.element_at(p, -1)))


def log_centered_softmax(logits: Column) -> Column:
    return F.transform(centered_softmax(logits), lambda x: F.log(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def logsumexp_of(maximum: Column, shifted_sum: Column) -> Column:
    """Log of a sum from its largest exponent and the sum of exp(x - largest); -infinity for an empty sum."""
    return F.when(maximum == float("-inf"), maximum).otherwise(maximum + F.log(shifted_sum))


def let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def normal_ppf(p) -> Column:
    """Inverse of the standard normal distribution function: a rational start and Newton steps on the function.

    The start t - (c0 + c1 t + c2 t^2) / (1 + d1 t + d2 t^2 + d3 t^3) is off by less than 4.5e-4.
    """
    p = _c(p)

    def of(p):
        t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
        start = let(t, lambda t: t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))
        x = F.when(p < 0.5, -start).otherwise(start)
        for _ in range(3):
            x = let(x, lambda x: x - (normal_cdf(x) - p) / (F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)))
        return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).when(p == 0.5, F.lit(0.0)).otherwise(x)

    return let(p, of)


def normal_cdf(x) -> Column:
    """Standard normal distribution function: its series around 0 (60 terms) inside 4.5, else a continued fraction."""
    def of(x):
        terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), lambda a, k: F.struct((a["t"] * x * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * x * x / (2 * k + 1)).alias("s")), lambda a: a["s"])
        density = F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
        z = F.abs(x)
        fraction = F.aggregate(F.sequence(F.lit(12), F.lit(1), F.lit(-1)), z + 6.0, lambda f, k: z + k / f)
        upper = density / fraction
        return F.when(z < 4.5, 0.5 + density * terms).when(x > 0, 1 - upper).otherwise(upper)

    return let(_c(x), of)
