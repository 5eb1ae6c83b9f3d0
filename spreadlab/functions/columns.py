"""Column-level building blocks. Everything here stays inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published Acklam approximation to the
# inverse normal distribution function (relative error below 1.2e-9).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00)
PPF_LOW = 0.02425


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Round half up; adding 0.0 turns -0.0 into 0.0."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def signed_log(c: str | Column, ignore_zeros: bool = False) -> Column:
    """sign(x) * ln(1 + |x|); null stays null, zeros optionally become null."""
    x = col(c)
    out = F.signum(x) * F.log1p(F.abs(x))
    return F.when(x != 0, out) if ignore_zeros else out


def inverse_signed_log(c: str | Column) -> Column:
    z = col(c)
    return F.signum(z) * F.expm1(F.abs(z))


def no_nan(c: str | Column) -> Column:
    """NaN to null: Spark orders NaN above everything and aggregates spread it."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den with null instead of an error when den is zero."""
    d = col(den).cast("double")
    return F.when(d != 0, col(num).cast("double") / d)


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_ppf(p: str | Column) -> Column:
    """Inverse standard normal distribution function; null outside (0, 1)."""
    p = col(p)
    q = p - 0.5
    r = q * q
    mid = q * _poly(PPF_A, r) / _poly(PPF_B + (1.0,), r)
    tail = F.when(p < 0.5, p).otherwise(1.0 - p)
    t = F.sqrt(-2.0 * F.log(tail))
    low = _poly(PPF_C, t) / _poly(PPF_D + (1.0,), t)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < PPF_LOW, low)
        .when(p > 1 - PPF_LOW, -low)
        .otherwise(mid)
    )


def cyclic(c: str | Column, period: float, name: str) -> list[Column]:
    """Sine and cosine encoding of a periodic value."""
    angle = col(c) * (2.0 * 3.141592653589793 / period)
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def corrected_skew(n: Column, m2: Column, m3: Column) -> Column:
    """Bias-corrected skewness from central moment sums; null below 3 rows."""
    var = m2 / n
    g1 = (m3 / n) / F.pow(var, 1.5)
    return F.when((n >= 3) & (m2 > 0), g1 * F.sqrt(n * (n - 1)) / (n - 2)).when(
        n >= 3, F.lit(0.0)
    )


def corrected_kurtosis(n: Column, m2: Column, m4: Column) -> Column:
    """Bias-corrected excess kurtosis from central moment sums; null below 4 rows."""
    var = m2 / n
    g2 = (m4 / n) / (var * var) - 3.0
    out = ((n + 1) * g2 + 6.0) * (n - 1) / ((n - 2) * (n - 3))
    return F.when((n >= 4) & (m2 > 0), out).when(n >= 4, F.lit(0.0))


def skew_of(c: str | Column) -> Column:
    """Bias-corrected skewness as an aggregate (Spark's own is the population one)."""
    x = col(c)
    n = F.count(x).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(x) > 0),
                  F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)).when(n >= 3, F.lit(0.0))


def kurtosis_of(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis as an aggregate."""
    x = col(c)
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when((n >= 4) & (F.stddev_pop(x) > 0),
                  ((n + 1) * g2 + 6.0) * (n - 1) / ((n - 2) * (n - 3))).when(n >= 4, F.lit(0.0))


def uniform_hash(key: str | Column, stream: Column | int) -> Column:
    """Reproducible pseudo-uniform number in [0, 1) per (key, stream).

    The first 52 bits of a digest of both, so no two keys of any size share their numbers, a
    re-run task draws the same ones and any SQL engine can compute them too.
    """
    s = stream if isinstance(stream, Column) else F.lit(stream)
    digest = F.md5(F.concat_ws(":", col(key).cast("string"), s.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


POISSON_ZERO = 2.718281828459045 ** -1


def poisson_steps() -> list[float]:
    """Distribution function of Poisson(1) up to the last value that 52-bit numbers can reach."""
    steps, term = [POISSON_ZERO], POISSON_ZERO
    while term > 2.0**-53:
        term /= len(steps)
        steps.append(steps[-1] + term)
    return steps


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw from a uniform number by inverting the distribution function."""
    out = None
    for k, step in enumerate(poisson_steps()):
        out = F.when(u < F.lit(step), k) if out is None else out.when(u < F.lit(step), k)
    return out.otherwise(len(poisson_steps()))
