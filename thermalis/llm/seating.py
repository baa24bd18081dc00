"""Numbers of tables in Chinese restaurants: generalised Stirling numbers and keyed draws.

``S_d(c, t)`` weighs all seatings of c customers at t tables. Given the weight ``b`` of a
new table, the number of tables of one dish is drawn from ``P(t) ~ S_d(c, t) b^t``, exactly
up to ``TABLE`` customers and with a corrected saddle-point approximation of S_d beyond.

Draws are keyed: they depend on the key of what is drawn and on the step alone, so they
are the same wherever and in whatever order they are made.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from thermalis.llm.words import mix

#: Customers up to which Stirling numbers are tabulated.
TABLE = 1024
_EDGES = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, TABLE)


@lru_cache(maxsize=4)
def stirling_logs(d: float, most: int = TABLE) -> np.ndarray:
    """log S_d(c, t) for c and t up to ``most``."""
    s = np.full((most + 1, most + 2), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        s[c + 1, t] = np.logaddexp(s[c, t - 1], np.log(np.maximum(c - d * t, 1e-300)) + s[c, t])
    return s


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted to arguments of 8 and more."""
    x = np.asarray(x, float)
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """By the saddle point of the generating function: S_d(c, t) is c! / t! times the coefficient of z^c in ((1 - (1 - z)^d) / d)^t."""
    # x = -log(1 - z) solves d e^((1 - d) x) (1 - e^-x) / (1 - e^(-d x)) = c / t, and lies between these two
    low = np.log(c / t) / (1 - d)
    high = low - np.log(d) / (1 - d)
    for _ in range(24):
        x = (low + high) / 2
        above = d * np.exp((1 - d) * x) * np.expm1(-x) / np.expm1(-d * x) > c / t
        high, low = np.where(above, x, high), np.where(above, low, x)
    x = (low + high) / 2
    z, r, phi = -np.expm1(-x), c / t, -np.expm1(-d * x) / d
    spread = t * (r + z * z * (1 - d) * np.exp((2 - d) * x) / phi - r * r)
    return _log_gamma(c + 1.0) - _log_gamma(t + 1.0) + t * np.log(phi) - c * np.log(z) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-12))


@lru_cache(maxsize=4)
def _correction(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Log of what the saddle point misses at ``TABLE`` customers, by t: it hardly depends on c and vanishes for large t."""
    t = np.arange(1, TABLE - 1).astype(float)
    return t, stirling_logs(d)[TABLE, 1 : TABLE - 1] - _saddle(np.full(len(t), float(TABLE)), t, d)


def saddle_logs(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) for over ``TABLE`` customers, 1 <= t < c."""
    return _saddle(c, t, d) + np.interp(t, *_correction(d))


def uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """In (0, 1), by key and step."""
    with np.errstate(over="ignore"):
        x = mix(keys + mix(np.array([step + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def gamma(shape: np.ndarray, keys: np.ndarray, step: int) -> np.ndarray:
    """Gamma variates (Marsaglia and Tsang's method), by key and step."""
    step *= 1024
    small = shape < 1
    a = np.where(small, shape + 1, shape) - 1 / 3
    out, left, k = np.zeros(len(shape)), np.arange(len(shape)), 1
    while len(left):
        u, v, w = (uniform(keys[left], step + k + i) for i in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        y = np.maximum(1 + x / np.sqrt(9 * a[left]), 1e-12) ** 3
        on = np.log(w) < 0.5 * x * x + a[left] * (1 - y + np.log(y))
        on &= y > 1e-30
        out[left[on]] = (a[left] * y)[on]
        left, k = left[~on], k + 3
    out[small] *= uniform(keys[small], step) ** (1 / shape[small])
    return out


def draw_tables(c: np.ndarray, b: np.ndarray, keys: np.ndarray, step: int, d: float, chunk: int = 1 << 19) -> np.ndarray:
    """Tables of dishes with ``c`` customers when a new table weighs ``b``; 0 for none."""
    out = np.minimum(c, 1).astype(np.int64)
    many = np.flatnonzero(c > 1)
    if not len(many):
        return out
    many = many[np.argsort(c[many], kind="stable")]
    sizes, logs = c[many], stirling_logs(d)
    start = 0
    for top in _EDGES:
        stop = int(np.searchsorted(sizes, top, "right"))
        for x in range(start, stop, max(1, chunk // top)):
            at = many[x : min(stop, x + max(1, chunk // top))]
            weight = logs[c[at], 1 : top + 1] + np.log(b[at])[:, None] * np.arange(top)
            weight = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[at] = 1 + (weight < uniform(keys[at], step)[:, None] * weight[:, -1:]).sum(axis=1)
        start = stop
    for x in range(start, len(many), 2048):
        at = many[x : x + 2048]
        out[at] = _draw_large(c[at].astype(float), b[at], uniform(keys[at], step), d)
    return out


def _draw_large(c: np.ndarray, b: np.ndarray, u: np.ndarray, d: float, points: int = 64) -> np.ndarray:
    """On a grid over the bulk of the distribution; whole numbers between two points are alike."""
    low, high = np.ones(len(c)), c - 1
    weigh = lambda t: saddle_logs(c[:, None], t, d) + t * np.log(b)[:, None]
    for _ in range(2):  # first to find the bulk, then over it
        grid = np.exp(np.log(low)[:, None] + (np.log(high) - np.log(low))[:, None] * np.linspace(0, 1, points))
        f = weigh(grid)
        near = f > f.max(axis=1, keepdims=True) - 20
        first, last = near.argmax(axis=1), points - 1 - near[:, ::-1].argmax(axis=1)
        pick = np.arange(len(c))
        low, high = grid[pick, np.maximum(first - 1, 0)], grid[pick, np.minimum(last + 1, points - 1)]
    low, step = np.floor(low), np.ceil((np.ceil(high) - np.floor(low) + 1) / points)
    t = np.minimum(low[:, None] + step[:, None] * np.arange(points), (c - 1)[:, None])
    f = weigh(np.minimum(t + (step[:, None] - 1) / 2, (c - 1)[:, None]))
    weight = np.exp(f - f.max(axis=1, keepdims=True)) * (np.diff(t, axis=1, prepend=t[:, :1] - 1) > 0)
    weight = weight.cumsum(axis=1)
    at = np.minimum((weight < (u * weight[:, -1])[:, None]).sum(axis=1), points - 1)
    before = np.where(at > 0, weight[np.arange(len(c)), np.maximum(at - 1, 0)], 0.0)
    inside = (u * weight[:, -1] - before) / np.maximum(weight[np.arange(len(c)), at] - before, 1e-300)
    return np.minimum(t[np.arange(len(c)), at] + np.floor(np.clip(inside, 0, 1 - 1e-9) * step), c - 1).astype(np.int64)
