"""The normal distribution and stable sums as column expressions; the same formulas as SQL text for the oracle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the upper tail, exp(-x^2 / 2) * P(x) / Q(x), highest power first.
TAIL_P = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
TAIL_Q = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
#: From here on a short continued fraction is exact.
TAIL_FAR = 5 * math.sqrt(2)

# Acklam's rational approximation of the normal quantile.
PPF_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
PPF_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
PPF_LOW = 0.02425


def upper_tail(z: Column) -> Column:
    """1 - cdf(z) of z >= 0, with a relative error below 5e-15 up to 2.5, 3e-8 beyond; never cancels.

    z is bound once by a lambda: written out, a long expression in its place would outgrow what Spark can compile."""

    def tail(z: Column) -> Column:
        far = z
        for k in (5, 4, 3, 2, 1):
            far = z + k / far
        e = F.exp(-z * z / 2)
        return F.when(z < TAIL_FAR, e * _horner(TAIL_P, z) / _horner(TAIL_Q, z)).otherwise(e / (far * math.sqrt(2 * math.pi)))

    return F.transform(F.array(z), tail)[0]


def cdf(x: Column) -> Column:
    tail = upper_tail(F.abs(x))
    return F.when(x < 0, tail).otherwise(1 - tail)


def between(low: Column, high: Column) -> Column:
    """cdf(high) - cdf(low), from the side of the mean where that does not cancel."""
    return F.when(low > 0, cdf(-low) - cdf(-high)).otherwise(cdf(high) - cdf(low))


def cdf_sql(x: str) -> str:
    """The same by another way, for the oracle: a power series near 0, Laplace's continued fraction far out."""
    z = f"abs({x})"
    series, fraction = "1.0::DOUBLE", f"{z}"
    for k in range(40, 0, -1):
        series = f"(1 + {z} * {z} / {2 * k + 1} * {series})"
        fraction = f"({z} + {k} / {fraction})"
    near = f"(0.5 - {pdf_sql(x)} * {z} * {series})"
    tail = f"(CASE WHEN {z} < 2.5 THEN {near} ELSE {pdf_sql(x)} / {fraction} END)"
    return f"(CASE WHEN {x} < 0 THEN {tail} ELSE 1 - {tail} END)"


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def pdf_sql(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) / {math.sqrt(2 * math.pi)}::DOUBLE)"


def _horner(coefficients: list[float], x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def ppf(p: Column) -> Column:
    """Relative error below 1.2e-9."""

    def tail(q: Column) -> Column:
        return _horner(PPF_C, q) / _horner([*PPF_D, 1.0], q)

    q = p - 0.5
    r = q * q
    middle = _horner(PPF_A, r) * q / _horner([*PPF_B, 1.0], r)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when(p < PPF_LOW, tail(low)).when(p > 1 - PPF_LOW, -tail(high)).otherwise(middle)


def ppf_sql(p: str) -> str:
    def poly(cs: list[float], x: str) -> str:
        out = f"({cs[0]})::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * {x} + ({c})::DOUBLE)"
        return out

    def tail(q: str) -> str:
        return f"({poly(PPF_C, q)} / {poly([*PPF_D, 1.0], q)})"

    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    middle = f"({poly(PPF_A, r)} * {q} / {poly([*PPF_B, 1.0], r)})"
    return f"(CASE WHEN {p} < {PPF_LOW} THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > {1 - PPF_LOW} THEN -{tail(f'sqrt(-2 * ln(1 - {p}))')} ELSE {middle} END)"


def logsumexp(values: Column) -> Column:
    """Over an array of doubles."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def fisher_interval(r: Column, n: Column, alpha: float) -> tuple[Column, Column]:
    """Confidence interval of a correlation from n samples."""
    z = F.log((1 + r) / (1 - r)) / 2
    half = ppf(F.lit((1 + alpha) / 2)) / F.sqrt(n - 3)
    return F.tanh(z - half), F.tanh(z + half)
