"""Exact two-sided tails of two-sample statistics: counts of lattice paths and of rank sums.

A sample of n and one of m without ties are one of the C(n + m, n) paths from (0, 0)
to (n, m), all equally likely under the null.  Kolmogorov and Smirnov's distance is
the farthest that a path gets from the diagonal, Mann and Whitney's U the area under it.
"""

from __future__ import annotations

import math

import numpy as np

from .tails import kolmogorov_sf, normal_two_sided

#: The larger sample up to which paths are counted; beyond, the limiting distribution is used.
PATHS = 10_000
#: The smaller sample up to which rank sums are counted where no values are tied; beyond, the normal approximation is used.
SUMS = 8


def ks_tail(d: float, n: int, m: int) -> float:
    """P(D >= d) for samples of n and m.

    The probability that a path leaves the band ``|i m - j n| < h`` is summed over where it first does, all terms being
    positive, so that small tails keep their digits.
    """
    if n < 1 or m < 1:
        return math.nan
    if max(n, m) > PATHS:
        return kolmogorov_sf(d, n, m)
    h = round(d * n * m)
    if h <= 0:
        return 1.0
    i = np.arange(n + 1, dtype=np.float64)
    inside = np.zeros(n + 1)
    inside[0], left = 1.0, 0.0
    for step in range(n + m):
        j = step - i
        right = inside * np.maximum(n - i, 0) / (n + m - step)
        inside = inside * np.clip(m - j, 0, m) / (n + m - step)
        inside[1:] += right[:-1]
        out = np.abs(i * m - (step + 1 - i) * n) >= h
        left += inside[out].sum()
        inside[out] = 0.0
    return min(1.0, left)


def u_counts(n: int, m: int) -> list[int]:
    """How many of the C(n + m, n) arrangements have U = 0, 1, ..., n m."""
    n, m = min(n, m), max(n, m)
    ways = np.zeros(n * m + 1, dtype=object)
    ways[0] = 1
    # the Gaussian binomial, factor by factor: times 1 - q^(m + j), divided by 1 - q^j; every step is a polynomial
    for j in range(1, n + 1):
        if m + j <= n * m:
            ways[m + j :] = ways[m + j :] - ways[: -(m + j)]
        for first in range(min(j, len(ways))):
            ways[first::j] = np.add.accumulate(ways[first::j])
    return ways.tolist()


def u_tail(u: float, n: int, m: int, z: float | None, tied: bool) -> float:
    """Two-sided p of U: exact for a small sample without ties, else by the normal score z."""
    if n < 1 or m < 1:
        return math.nan
    if min(n, m) > SUMS or max(n, m) > PATHS or tied:
        return 1.0 if z is None or math.isnan(z) else normal_two_sided(z)
    ways = u_counts(n, m)
    top = int(max(u, n * m - u))
    return min(1.0, 2 * sum(ways[top:]) / math.comb(n + m, n))
