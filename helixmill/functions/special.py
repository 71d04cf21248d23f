"""Tail probabilities of the usual test statistics, by series and continued fractions (NumPy only)."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt


def normal_sf(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def chi2_sf(x: float, df: float) -> float:
    """P(X > x) of a chi-squared variable."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / _away(an * d + b)
        c = _away(b + an / c)
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _away(x: float) -> float:
    return x if abs(x) > 1e-300 else 1e-300


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1 / _away(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _away(1 + an * d)
            c = _away(1 + an / c)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided P(|T| > |t|)."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """W and p by Royston's approximation (AS R94) for 3 to 5000 values."""
    import numpy as np

    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([_normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / sqrt(n)
    a = m / sqrt(mm)
    if n == 3:
        a = np.array([-sqrt(0.5), 0, sqrt(0.5)])
    else:
        last = a[-1] + u * (0.221157 + u * (-0.147981 + u * (-2.07119 + u * (4.434685 - 2.706056 * u))))
        if n > 5:
            before = a[-2] + u * (0.042981 + u * (-0.293762 + u * (-1.752461 + u * (5.682633 - 3.582633 * u))))
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a = m / sqrt(phi)
            a[-2], a[1] = before, -before
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / sqrt(phi)
        a[-1], a[0] = last, -last
    w = min(float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()), 1.0)
    if n == 3:
        from math import asin, pi

        return w, max(0.0, 6 / pi * (asin(sqrt(w)) - asin(sqrt(0.75))))
    y = log(max(1 - w, 1e-300))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 0.0
        y = -log(g - y)
        mu = 0.544 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        ln = log(n)
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
        sd = exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return w, normal_sf((y - mu) / sd)


def log_normal_sf(z: float) -> float:
    if z < 30:
        return log(normal_sf(z))
    return -z * z / 2 - log(z * sqrt(6.283185307179586)) + log(1 - 1 / z**2 + 3 / z**4)


def anderson_darling_p(a: float) -> float:
    """p of the size-adjusted Anderson-Darling statistic for a normal distribution with both moments estimated (D'Agostino and Stephens 1986)."""
    if a < 0.2:
        return 1 - exp(-13.436 + 101.14 * a - 223.73 * a * a)
    if a < 0.34:
        return 1 - exp(-8.318 + 42.796 * a - 59.938 * a * a)
    if a < 0.6:
        return exp(0.9177 - 4.279 * a - 1.38 * a * a)
    # beyond 10 the formula would rise again
    return exp(1.2937 - 5.709 * a + 0.0186 * a * a) if a < 10 else 3.7e-24


def _normal_ppf(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)
