"""Scalar statistics without SciPy, for the few numbers that reach the driver, and column arithmetic."""

from __future__ import annotations

from math import exp, lgamma, log, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quantile 0.975 of the normal distribution.
Z975 = 1.959963984540054


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_cdf(t: float, df: float) -> float:
    """Distribution function of Student's t."""
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t, by bisection."""
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def tost(mean: float, sd: float, n: int, reference: float, delta: float = 0.15, alpha: float = 0.05) -> dict[str, float | bool]:
    """Two one-sided t tests of equivalence to ``reference`` within ``delta``, with the 1-2alpha interval of the mean."""
    se = sd / sqrt(n) if sd > 0 else 1e-12
    lower = 1 - t_cdf((mean - (reference - delta)) / se, n - 1)
    upper = t_cdf((mean - (reference + delta)) / se, n - 1)
    half = t_quantile(1 - alpha, n - 1) * se
    return {"p_lower": lower, "p_upper": upper, "p": max(lower, upper), "low": mean - half, "high": mean + half, "equivalent": max(lower, upper) < alpha}


def bayes_factor_null(t: Column | float, n: Column | float, scale: float = 0.1):
    """Evidence for no effect over an effect with a normal prior of width ``scale``."""
    if isinstance(t, Column):
        return F.sqrt((n + 1 / scale**2) / n) * F.exp(-t * t / (2 * (1 + n * scale**2)))
    return sqrt((n + 1 / scale**2) / n) * exp(-t * t / (2 * (1 + n * scale**2)))


def bayes_wording(bf: Column) -> Column:
    """A Bayes factor for the null in six steps."""
    return F.when(bf > 10, "strong for null").when(bf > 3, "moderate for null").when(bf > 1, "anecdotal for null").when(bf > 1 / 3, "anecdotal for effect").when(bf > 1 / 10, "moderate for effect").otherwise("strong for effect")


def wilson(successes: Column, total: Column, z: float = Z975) -> tuple[Column, Column]:
    """Wilson's interval of a share; (0, 1) for no cases."""
    p = successes / F.when(total > 0, total)
    centre = (p + z * z / (2 * total)) / (1 + z * z / total)
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)
    return F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0))


def cohens_d(mean_a: Column, sd_a: Column, mean_b: Column, sd_b: Column) -> Column:
    """Difference of two means in pooled population deviations; 0 where both deviations are."""
    pooled = F.sqrt((sd_a * sd_a + sd_b * sd_b) / 2)
    return F.when(pooled > 0, (mean_a - mean_b) / F.when(pooled > 0, pooled)).otherwise(0.0)


def normal_pdf(x: float) -> float:
    """Density of the standard normal distribution."""
    return exp(-x * x / 2) / sqrt(2 * pi)


def arrangements(counts: list[int]) -> int:
    """In how many ways labels with these counts can be arranged."""
    out, n = 1, 0
    for c in counts:
        for k in range(1, c + 1):
            n += 1
            out = out * n // k
    return out
