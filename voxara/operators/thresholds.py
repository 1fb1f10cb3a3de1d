"""Histogram methods of automatic thresholding. Each takes the bins' starts and counts and gives the index of a bin.

A histogram has a bounded number of bins, so these run on the driver, or on the neighbourhoods of a block at once.
"""

from __future__ import annotations

import math

import numpy as np


def _smooth_until_two_modes(n: np.ndarray, rounds: int = 10_000) -> np.ndarray | None:
    """A running mean of three until the histogram has two modes; None where it never has."""
    y = n.astype(float)
    for _ in range(rounds):
        peaks = int(((y[1:-1] > y[:-2]) & (y[1:-1] > y[2:])).sum())
        if peaks == 2:
            return y
        if peaks < 2:
            return None
        y = np.convolve(np.r_[0.0, y, 0.0], np.ones(3) / 3, "valid")
    return None


def _modes(y: np.ndarray) -> np.ndarray:
    return np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] > y[2:])) + 1


def intermodes(n: np.ndarray) -> int:
    """Prewitt and Mendelsohn: halfway between the two modes of the smoothed histogram; 0 without two modes."""
    y = _smooth_until_two_modes(n)
    return 0 if y is None else int(_modes(y).sum() // 2)


def minimum(n: np.ndarray) -> int:
    """Prewitt and Mendelsohn: the lowest bin between the two modes of the smoothed histogram; 0 without two modes."""
    y = _smooth_until_two_modes(n)
    if y is None:
        return 0
    a, b = _modes(y)
    return int(a + np.argmin(y[a : b + 1]))


def huang(n: np.ndarray) -> int:
    """Huang and Wang: the least fuzziness (Shannon's function of memberships by distance to the class mean)."""
    used = np.flatnonzero(n)
    if len(used) < 2:
        return int(used[0]) if len(used) else 0
    first, last = used[0], used[-1]
    k = np.arange(len(n), dtype=float)
    width, best, at = float(last - first), math.inf, int(first)
    w, m = np.cumsum(n), np.cumsum(n * k)
    for t in range(first, last):
        low, high = m[t] / w[t], (m[-1] - m[t]) / (w[-1] - w[t])
        u = 1 / (1 + np.abs(k - np.where(k <= t, low, high)) / width)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where((u > 1e-6) & (u < 1 - 1e-6), -u * np.log(u) - (1 - u) * np.log(1 - u), 0.0)
        if (e := float((n * s).sum())) < best:
            best, at = e, t
    return at


def li(n: np.ndarray, tolerance: float = 0.5) -> int:
    """Li and Tam: the fixed point of minimum cross entropy, from the mean on."""
    k = np.arange(len(n), dtype=float)
    total = n.sum()
    if not total:
        return 0
    new = float((n * k).sum() / total)
    while True:
        old, t = new, int(new + 0.5)
        low, high = n[: t + 1].sum(), n[t + 1 :].sum()
        below = (n * k)[: t + 1].sum() / low if low else 0.0
        above = (n * k)[t + 1 :].sum() / high if high else 0.0
        if below <= 0 or above <= 0 or below == above:
            return t
        step = (below - above) / (math.log(below) - math.log(above))
        new = float(int(step - 1e-10)) if step < -1e-10 else float(int(step + 0.5))
        if abs(new - old) <= tolerance:
            return t


def min_error(n: np.ndarray) -> int:
    """Kittler and Illingworth, iteratively from the mean: where two fitted normal densities are equal."""
    k = np.arange(len(n), dtype=float)
    total = n.sum()
    if not total:
        return 0
    t, before = int((n * k).sum() / total), -2
    a, b, c = np.cumsum(n), np.cumsum(n * k), np.cumsum(n * k * k)
    for _ in range(len(n)):
        if t == before or not 0 <= t < len(n) - 1 or not a[t] or a[-1] == a[t]:
            break
        mu, nu = b[t] / a[t], (b[-1] - b[t]) / (a[-1] - a[t])
        p, q = a[t] / a[-1], (a[-1] - a[t]) / a[-1]
        s2, t2 = c[t] / a[t] - mu * mu, (c[-1] - c[t]) / (a[-1] - a[t]) - nu * nu
        if s2 <= 0 or t2 <= 0:
            break
        w0, w1 = 1 / s2 - 1 / t2, mu / s2 - nu / t2
        w2 = mu * mu / s2 - nu * nu / t2 + math.log10(s2 * q * q / (t2 * p * p))
        square = w1 * w1 - w0 * w2
        if square < 0 or w0 == 0:
            break
        before, t = t, int((w1 + math.sqrt(square)) / w0)
    return min(max(t, 0), len(n) - 1)


def moments(n: np.ndarray) -> int:
    """Tsai: the share of the lower of two values that keep the histogram's first three moments."""
    total = n.sum()
    if not total:
        return 0
    p, k = n / total, np.arange(len(n), dtype=float)
    m1, m2, m3 = ((p * k**i).sum() for i in (1, 2, 3))
    d = m2 - m1 * m1
    if d <= 0:
        return int(m1)
    c0, c1 = (m1 * m3 - m2 * m2) / d, (m1 * m2 - m3) / d
    root = math.sqrt(max(0.0, c1 * c1 - 4 * c0))
    z0, z1 = (-c1 - root) / 2, (-c1 + root) / 2
    share = (z1 - m1) / (z1 - z0) if z1 > z0 else 0.5
    over = np.flatnonzero(np.cumsum(p) > share)
    return int(over[0]) if len(over) else len(n) - 1


def percentile(n: np.ndarray, share: float = 0.5) -> int:
    """Doyle: the bin whose cumulated share is nearest to a given one."""
    return int(np.argmin(np.abs(np.cumsum(n) / (n.sum() or 1) - share)))


def _shares(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = n / (n.sum() or 1)
    low = np.cumsum(p)
    return p, low, 1 - low


def shanbhag(n: np.ndarray) -> int:
    """Shanbhag: the least difference between the information of both classes, with fuzzy memberships."""
    if not n.sum():
        return 0
    p, low, high = _shares(n)
    first = int(np.argmax(low > 1e-12))
    inner = np.flatnonzero(high > 1e-12)
    last = int(inner[-1]) if len(inner) else len(n) - 1
    best, at = math.inf, first
    for t in range(first, last + 1):
        a, b = 0.5 / low[t], 0.5 / high[t] if high[t] > 0 else 0.0
        below = -a * (p[1 : t + 1] * np.log(1 - a * low[:t])).sum()
        above = -b * (p[t + 1 :] * np.log(np.maximum(1 - b * high[t + 1 :], 1e-300))).sum()
        if abs(below - above) < best:
            best, at = abs(below - above), t
    return at


def yen(n: np.ndarray) -> int:
    """Yen, Chang and Chang: the largest correlation criterion."""
    p, low, _ = _shares(n)
    squares = np.cumsum(p * p)
    both, rest = squares * (squares[-1] - squares), low * (1 - low)
    with np.errstate(divide="ignore", invalid="ignore"):
        crit = -np.where(both > 0, np.log(both), 0.0) + 2 * np.where(rest > 0, np.log(rest), 0.0)
    return int(np.argmax(crit))


def renyi_entropy(n: np.ndarray) -> int:
    """Kapur, Sahoo and Wong with Renyi's entropies of order 1/2, 1 and 2, whose three thresholds are weighted by their order."""
    if not n.sum():
        return 0
    p, low, high = _shares(n)
    first = int(np.argmax(low > 1e-12))
    inner = np.flatnonzero(high > 1e-12)
    last = int(inner[-1]) if len(inner) else len(n) - 1

    def largest(order: float) -> int:
        best, at = -math.inf, 0
        for t in range(first, last + 1):
            a, b = p[: t + 1] / low[t], p[t + 1 :] / high[t] if high[t] > 0 else p[t + 1 :]
            if order == 1:
                e = -(a[a > 0] * np.log(a[a > 0])).sum() - (b[b > 0] * np.log(b[b > 0])).sum()
            else:
                product = (a**order).sum() * (b**order).sum()
                e = math.log(product) / (1 - order) if product > 0 else 0.0
            if e > best:
                best, at = e, t
        return at

    one, half, two = sorted((largest(0.5), largest(1.0), largest(2.0)))
    near, far = abs(one - half) <= 5, abs(half - two) <= 5
    weights = (1, 2, 1) if near == far else (0, 1, 3) if far else (3, 1, 0)
    omega = low[two] - low[one]
    return int(one * (low[one] + 0.25 * omega * weights[0]) + half * 0.25 * omega * weights[1] + two * (high[two] + 0.25 * omega * weights[2]))


METHODS = {
    "Huang": huang, "Intermodes": intermodes, "Li": li, "MinError": min_error, "Minimum": minimum, "Moments": moments, "Percentile": percentile,
    "RenyiEntropy": renyi_entropy, "Shanbhag": shanbhag, "Yen": yen,
}
