"""Distribution tails from the standard library: normal, chi-square, Student t and hypergeometric."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction beyond."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def chi2_isf(q: float, df: float) -> float:
    """x with P(X > x) = q, by bisection."""
    low, high = 0.0, 1.0
    while chi2_sf(high, df) > q and high < 1e6:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if chi2_sf(mid, df) > q:
            low = mid
        else:
            high = mid
    return high


def chi2_quantile(p: float, df: float) -> float:
    """x with P(X <= x) = p."""
    return chi2_isf(1 - p, df)


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def hypergeom_sf(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= k) for the marked among drawn ones."""
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    top = min(marked, drawn)
    low = max(k, drawn + marked - total, 0)
    return min(1.0, math.fsum(math.exp(choose(marked, i) + choose(total - marked, drawn - i) - choose(total, drawn)) for i in range(low, top + 1)))


def kolmogorov_sf(d: float, n: int, m: int) -> float:
    """The asymptotic two-sided p-value of a two-sample Kolmogorov-Smirnov distance."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * math.fsum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
