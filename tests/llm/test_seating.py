"""Table counts: Stirling numbers by enumeration, draws against exact distributions."""

import math

import numpy as np
import pytest

from thermalis.llm import seating


def test_stirling_numbers_count_seatings():
    d = 0.3
    logs = seating.stirling_logs(d)

    def seatings(c):
        if c == 1:
            return [(1,)], [1.0]
        states, weights = seatings(c - 1)
        out = []
        for s, w in zip(states, weights, strict=True):
            out.append((s + (1,), w))
            out += [(s[:k] + (s[k] + 1,) + s[k + 1 :], w * (s[k] - d)) for k in range(len(s))]
        return [s for s, _ in out], [w for _, w in out]

    states, weights = seatings(5)
    for t in range(1, 6):
        assert math.isclose(sum(w for s, w in zip(states, weights, strict=True) if len(s) == t), math.exp(logs[5, t]))


@pytest.mark.parametrize(("c", "b"), [(5, 0.3), (40, 2.0), (700, 0.1)])
def test_draws_follow_their_conditional(c, b):
    d, n = 0.6, 20_000
    t = seating.draw_tables(np.full(n, c), np.full(n, b), np.arange(n).astype(np.uint64), 4, d)
    weight = seating.stirling_logs(d)[c, 1 : c + 1] + np.arange(c) * np.log(b)
    weight = np.exp(weight - weight.max())
    assert np.abs(np.bincount(t, minlength=c + 1)[1 : c + 1] / n - weight / weight.sum()).max() < 0.015
    again = seating.draw_tables(np.full(n, c)[::-1], np.full(n, b), np.arange(n).astype(np.uint64)[::-1], 4, d)
    assert (again[::-1] == t).all()


@pytest.mark.parametrize("b", [1e-4, 0.1, 1.0, 10.0, 100.0])
def test_saddle_point_beyond_the_table(b):
    d, c = 0.8, 2500
    exact = seating.stirling_logs(d, c)[c, 1:c] + np.arange(1, c) * np.log(b)
    close = seating.saddle_logs(np.full(c - 1, float(c)), np.arange(1, c).astype(float), d) + np.arange(1, c) * np.log(b)
    exact, close = (np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in (exact, close))
    assert np.abs(exact - close).sum() / 2 < 0.02
    n = 2000
    t = seating.draw_tables(np.full(n, c), np.full(n, b), np.arange(n).astype(np.uint64), 1, d)
    mean = (exact * np.arange(1, c)).sum()
    sd = math.sqrt((exact * np.arange(1, c) ** 2).sum() - mean**2)
    assert abs(t.mean() - mean) < 5 * sd / math.sqrt(n) + 0.01 * mean


@pytest.mark.parametrize("shape", [0.3, 1.0, 12.5])
def test_gamma_variates(shape):
    g = seating.gamma(np.full(50_000, shape), np.arange(50_000).astype(np.uint64), 9)
    assert abs(g.mean() - shape) < 0.03 * shape + 0.01 and abs(g.var() - shape) < 0.06 * shape + 0.01
