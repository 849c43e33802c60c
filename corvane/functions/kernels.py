"""Normal and beta distributions as array arithmetic: every step works on all values that still need it, none goes value by value."""

from __future__ import annotations

import numpy as np

#: Terms of the error function's series below BORDER and of its continued fraction above; steps of the incomplete beta's fraction.
SERIES, FRACTION, BORDER, STEPS = 70, 60, 3.0, 500
TINY = 1e-300


def erf_pair(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """erf(x), and erfc(|x|) without loss for large x."""
    size = np.abs(x)
    erf, rest = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
    near = size < BORDER
    s = size[near]
    term = 2 / np.sqrt(np.pi) * np.exp(-s * s) * s
    total = term.copy()
    for n in range(1, SERIES):
        term *= 2 * s * s / (2 * n + 1)
        total += term
    erf[near], rest[near] = total, 1 - total
    far = size >= BORDER
    s = size[far]
    below = s.copy()
    for n in range(FRACTION, 0, -1):
        below = s + n / 2 / below
    rest[far] = np.exp(-s * s) / np.sqrt(np.pi) / below
    erf[far] = 1 - rest[far]
    return np.sign(x) * erf, rest


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """erf(b) - erf(a), from the tails where both lie on one side."""
    (left, left_rest), (right, right_rest) = erf_pair(a), erf_pair(b)
    return np.where((a > 0) & (b > 0), left_rest - right_rest, np.where((a < 0) & (b < 0), right_rest - left_rest, right - left))


def truncated_normal_cdf(x: np.ndarray, low: np.ndarray, high: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = lambda v: (v - mean) / std / np.sqrt(2)
    with np.errstate(invalid="ignore", divide="ignore"):
        return _between(z(low), z(x)) / _between(z(low), z(high))


def truncated_normal_density(x: np.ndarray, low: np.ndarray, high: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = lambda v: (v - mean) / std / np.sqrt(2)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 2 / np.sqrt(np.pi) * np.exp(-(z(x) ** 2)) / (std * np.sqrt(2)) / _between(z(low), z(high))


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0: moved up to 10 and more, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    moved, product = x.copy(), np.ones_like(x)
    for _ in range(10):
        small = moved < 10
        product = np.where(small, product * moved, product)
        moved = np.where(small, moved + 1, moved)
    r = 1 / moved
    r2 = r * r
    series = r * (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 * (1 / 1680 - r2 * (1 / 1188 - r2 * (691 / 360360 - r2 / 156))))))
    return (moved - 0.5) * np.log(moved) - moved + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def _log_front(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)


def _kept(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) > TINY, v, TINY)


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function (modified Lentz); values leave the loop as they settle."""
    out = np.empty_like(x)
    at = np.arange(len(x))
    c, d = np.ones_like(x), 1 / _kept(1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, STEPS):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _kept(1 + top * d)
            c = _kept(1 + top / c)
            value = value * d * c
        going = np.abs(d * c - 1) >= 1e-15
        if not going.all():
            out[at[~going]] = value[~going]
            at, x, a, b, c, d, value = (v[going] for v in (at, x, a, b, c, d, value))
            if not len(at):
                break
    out[at] = value
    return out


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function; NaN where x or a parameter is."""
    out = np.where(np.isnan(x) | np.isnan(a) | np.isnan(b), np.nan, (x >= 1).astype(float))
    inside = np.flatnonzero((x > 0) & (x < 1) & ~np.isnan(a) & ~np.isnan(b))
    x, a, b = x[inside], a[inside], b[inside]
    turned = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    part = np.exp(_log_front(x, a, b)) / p * _fraction(y, p, q)
    out[inside] = np.where(turned, 1 - part, part)
    return out


def beta_density(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.exp(_log_front(x, a, b)) / (x * (1 - x))


def solved(p: np.ndarray, low: np.ndarray, high: np.ndarray, parameters: tuple[np.ndarray, ...], cdf, density, steps: int = 120) -> np.ndarray:
    """x with cdf(x) = p between low and high: Newton's steps, halved instead where one would leave the bracket found so far."""
    out = np.empty_like(p)
    at = np.arange(len(p))
    left, right = low.copy(), high.copy()
    x = (left + right) / 2
    for _ in range(steps):
        off = cdf(x, *parameters) - p
        left, right = np.where(off < 0, x, left), np.where(off < 0, right, x)
        with np.errstate(divide="ignore", invalid="ignore"):
            moved = x - off / density(x, *parameters)
        moved = np.where((moved > left) & (moved < right), moved, (left + right) / 2)
        # A NaN distribution never settles; its bracket shrinks to an end all the same.
        done = (np.abs(moved - x) <= 4e-16 * np.maximum(np.abs(x), np.abs(right - left))) | (off == 0)
        out[at[done]] = np.where(off == 0, x, moved)[done]
        going = ~done
        at, p, left, right, x = at[going], p[going], left[going], right[going], moved[going]
        parameters = tuple(v[going] for v in parameters)
        if not len(at):
            break
    out[at] = x
    return out


def truncated_normal_quantile(p: np.ndarray, low: np.ndarray, high: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return solved(p, low, high, (low, high, mean, std), truncated_normal_cdf, truncated_normal_density)


def beta_quantile(p: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = solved(p, np.zeros_like(p), np.ones_like(p), (a, b), beta_cdf, beta_density)
    return low + unit * (high - low)
