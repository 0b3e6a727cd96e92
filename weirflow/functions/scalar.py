"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Limits beyond which exponent and logarithm are clipped.
LIMIT, TINY = 700.0, 2.0**-1000

# fixed coefficients of Acklam's rational approximation to the inverse normal distribution
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def ndtri(p: Column) -> Column:
    """Inverse of the normal distribution function, to about 1e-9 of the value; null outside (0, 1)."""
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    tail = lambda t: _poly(_C, t) / (_poly(_D, t) * t + 1)
    middle = _poly(_A, q * q) * q / (_poly(_B, q * q) * q * q + 1)
    return F.when((p > 0) & (p < 0.02425), tail(low)).when((p >= 0.02425) & (p <= 0.97575), middle).when((p > 0.97575) & (p < 1), -tail(high))


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite over a zero (taken as positive), NaN for zero over zero, null for a null."""
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.when(b == 0, a * F.lit(float("inf"))))


def slog(x: Column, least: float = TINY) -> Column:
    """Logarithm with its argument kept above the smallest safe value."""
    return F.log(F.greatest(x, F.lit(least)))


def sexp(x: Column) -> Column:
    """Exponential with its argument clipped to where the result is finite."""
    return F.exp(F.greatest(F.least(x, F.lit(LIMIT)), F.lit(-LIMIT)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + sexp(-x))


def inverse_sigmoid(x: Column) -> Column:
    return slog(x) - slog(1 - x)


def dsigmoid(x: Column) -> Column:
    s = sigmoid(x)
    return s * (1 - s)


def d2sigmoid(x: Column) -> Column:
    s = sigmoid(x)
    return s * (1 - s) * (1 - 2 * s)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def gaussian_logpdf(mu: Column, sigma: Column, x: Column) -> Column:
    z = (x - mu) / sigma
    return -0.5 * z * z - F.log(sigma) - 0.5 * math.log(2 * math.pi)


def gaussian_pdf(mu: Column, sigma: Column, x: Column) -> Column:
    return F.exp(gaussian_logpdf(mu, sigma, x))


def log_factorial(k: Column) -> Column:
    """ln k! of a whole number: summed up to 20, Stirling's series beyond."""
    x = (k + 1).cast("double")
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(k <= 20, F.log(F.factorial(k.cast("int")).cast("double"))).otherwise(series)


def poisson_logpdf(k: Column, rate: Column) -> Column:
    return k * F.log(rate) - rate - log_factorial(k)


def poisson_pdf(k: Column, rate: Column) -> Column:
    return F.exp(poisson_logpdf(k, rate))


def wrap(angle: Column) -> Column:
    """Angle in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def circdelta(a: Column, b: Column) -> Column:
    return wrap(a - b)


def survey_bearing(degrees: Column) -> Column:
    """Compass bearing as text, such as N45°E: from north or south towards east or west."""
    d = F.pmod(degrees, F.lit(360.0))
    part = lambda a, v, b: F.concat(F.lit(a), F.format_string("%.0f", v), F.lit("°" + b))
    return F.when(d <= 90, part("N", d, "E")).when(d <= 180, part("S", 180 - d, "E")).when(d <= 270, part("S", d - 180, "W")).otherwise(part("N", 360 - d, "W"))


def bits_to_nats(b: Column) -> Column:
    return b * math.log(2)


def nats_to_bits(n: Column) -> Column:
    return n / math.log(2)


def masked_log(x: Column) -> Column:
    """Logarithm, with 0 for 0."""
    return F.when(x != 0, F.log(x)).otherwise(F.lit(0.0))


def betapr(k: Column, n: Column) -> Column:
    """Mean of the posterior of a proportion under Jeffreys' prior."""
    return (k + 0.5) / (n + 1)


def round_significant(x: Column, digits: int) -> Column:
    """To so many significant figures."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def fraction_explained_deviance(model: Column, null: Column, saturated: Column) -> Column:
    return (model - null) / (saturated - null)
