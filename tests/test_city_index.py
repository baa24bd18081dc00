"""Index operators on hand-made rows, and properties."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalis.functions import calendar
from thermalis.operators import city_index as ix


def posts(spark, rows):
    base = spark.createDataFrame(rows, "row_index long, city string, continent string, country string, hemisphere string, d string, indicator string")
    return calendar.with_calendar(base.withColumn("date", F.to_date("d")).drop("d"))


def test_city_day_counts_and_first_known(spark):
    days = ix.city_day(posts(spark, [(3, "a", "X", None, "north", "2022-01-01", "1"), (1, "a", None, "P", "north", "2022-01-01", "0"), (2, "a", "Y", "Q", "north", "2022-01-01", "junk"), (4, "a", "X", "P", "north", "2022-01-02", None)]))
    got = {str(r.date): r for r in days.collect()}
    r = got["2022-01-01"]
    assert (r.heat_posts, r.observed_posts, r.continent, r.country, r.season) == (1, 3, "Y", "P", "Winter")
    assert got["2022-01-02"].heat_posts == 0


def test_external_and_zero_denominators(spark):
    p = posts(spark, [(1, "a", "X", "P", "north", "2022-01-01", "1"), (2, "a", "X", "P", "north", "2022-01-02", "1"), (3, "a", "X", "P", "north", "2022-01-03", "1")])
    totals = spark.createDataFrame([("a", "2022-01-01", 0), ("a", "2022-01-02", 1)], "city string, d string, total_posts long").withColumn("date", F.to_date("d"))
    got = {str(r.date): r for r in ix.city_day(p, totals=totals).collect()}
    assert got["2022-01-01"].daily_hpii_raw is None
    assert got["2022-01-02"].denominator_source == "external_city_day_totals" and got["2022-01-02"].denominator_is_proxy == 0
    assert got["2022-01-03"].denominator_source == "observed_input_rows_proxy"


def test_null_dates_are_an_error(spark):
    df = spark.createDataFrame([("north", None)], "hemisphere string, d string").withColumn("date", F.to_date("d"))
    with pytest.raises(Exception, match="no date"):
        calendar.with_calendar(df).collect()


def test_seasons_of_both_hemispheres(spark):
    rows = spark.createDataFrame([(m, h) for m in range(1, 13) for h in ("north", "south")], "m int, h string")
    got = {(r.m, r.h): r.s for r in rows.withColumn("s", calendar.season(F.col("m"), F.col("h"))).collect()}
    assert [got[m, "north"] for m in range(1, 13)] == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Fall"] * 3 + ["Winter"]
    assert [got[m, "south"] for m in range(1, 13)] == ["Summer"] * 2 + ["Fall"] * 3 + ["Winter"] * 3 + ["Spring"] * 3 + ["Summer"]


def test_synthetic_dates_wrap_and_parse(spark):
    rows = spark.createDataFrame([(i, "a", "Mar") for i in range(30)] + [(30, "a", "junk"), (31, "a", "2023-05")], "row_index long, city string, month string")
    got = {r.row_index: str(r.date) for r in calendar.with_dates(rows).collect()}
    assert got[0] == "2022-03-01" and got[28] == "2022-03-01" and got[27] == "2022-03-28" and got[30] == "2022-03-03" and got[31] == "2023-05-01"
    dated = rows.withColumn("date", F.when(F.col("row_index") == 1, "2020-02-03"))
    assert {r.date_is_synthetic for r in calendar.with_dates(dated).collect()} == {0}


def brute_breaks(x, k):
    x = sorted(x)
    best = None
    for cut in itertools.combinations(range(1, len(x)), k - 1):
        parts = [x[a:b] for a, b in zip((0, *cut), (*cut, len(x)), strict=True)]
        cost = sum(np.var(p) * len(p) for p in parts)
        if best is None or cost < best[0] - 1e-12:
            best = cost, [x[0], *(p[-1] for p in parts)]
    return best


def test_natural_breaks(spark):
    assert ix.natural_breaks([]) == [0.0, 1.0]
    assert ix.natural_breaks([2, 2, 2]) == [2.0] * 8
    assert ix.natural_breaks([1, 5]) == [1.0, 1.0, 5.0]
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.normal(size=9).tolist()
        assert np.allclose(ix.natural_breaks(x, 3), brute_breaks(x, 3)[1])
    levels = spark.createDataFrame([(float(v), None) for v in (1, 1.1, 5, 9, 9.1, 20, 30, 30.2)] + [(None, None)], "seasonal_hpii_percent double, hpvi_high_binary int")
    got = {r.seasonal_hpii_percent: r.hpii_level for r in ix.with_levels(levels).collect()}
    assert got[None] is None and got[1.0] == 1 and got[30.2] == 7 and all(got[a] <= got[b] for a, b in itertools.pairwise(sorted(x for x in got if x is not None)))
    equal = spark.createDataFrame([(3.0, 1), (None, 1)], "seasonal_hpii_percent double, hpvi_high_binary int")
    assert {r.hpii_level for r in ix.with_levels(equal).collect()} == {1}


def pair_polarisation(v, kind, alpha=1.6):
    v = np.array([0.0 if x is None or not np.isfinite(x) else x for x in v])
    s = (v - v.min()) / (v.max() - v.min()) if v.max() > v.min() else np.zeros(len(v))
    x, (lo, hi) = (s, (1 / 3, 2 / 3)) if kind == "hpii" else (v, (0.1, 0.3))
    a = (s + 1e-9) * np.where(x <= lo, 1, np.where(x <= hi, 2, 3))
    if len(a) <= 1:
        return 0.0
    p, d = a / a.sum(), np.abs(a[:, None] - a[None])
    return min(1.0, (p[:, None] ** (1 + alpha) * p[None] * d).sum() / ((p ** (1 + alpha)).sum() * max(d.max(), 1e-12)))


def test_polarisation_equals_pairs(spark):
    groups = {"a": [1.0, 2.0, 2.0, 9.0, None], "b": [4.0], "c": [3.0, 3.0], "d": [float("inf"), 0.1, 0.3, 0.31, 0.05]}
    rows = [(g, "Summer", f"{g}{i}", v, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "continent string, season string, city string, seasonal_hpii_percent double, hpvi double")
    for r in ix.polarisation(df).collect():
        assert abs(r.hppi_hpii - pair_polarisation(groups[r.continent], "hpii")) < 1e-9
        assert abs(r.hppi_hpvi - pair_polarisation(groups[r.continent], "hpvi")) < 1e-9
        assert 0 <= r.hppi_hpii <= 1


def test_variability_of_a_flat_series_and_rows_not_days(spark):
    rows = [(k, "a", "X", "P", "north", f"2022-01-{d:02d}", "0") for k, d in enumerate((1, 2, 20))]
    r = ix.variability(ix.city_day(posts(spark, rows))).first()
    assert (r.hpvi, r.hpvi_tier, r.hpvi_days_used) == (0.0, "low", 3)


def test_typology_without_summer(spark):
    rows = [(1, "a", "X", "P", "north", "2022-01-05", "1"), (2, "a", "X", "P", "north", "2022-04-05", "0")]
    days = ix.city_day(posts(spark, rows))
    r = ix.typology(ix.with_levels(ix.seasonal(days)), ix.monthly(days)).first()
    assert (r.peak_season, r.counter_seasonal_label, r.peak_total_coincide) == ("Winter", "Both", 1)


def plain_breaks(values, classes=7):
    """Boundaries by trying every start of every class."""
    x = np.sort(np.asarray(values, float))
    n, k = len(x), max(2, min(classes, len(x)))
    s1, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cost, start = np.full((k + 1, n + 1), np.inf), np.ones((k + 1, n + 1), int)
    cost[1, 1:], cost[1:, 1] = s2[1:] - s1[1:] ** 2 / np.arange(1, n + 1), 0.0
    for j in range(2, k + 1):
        for end in range(2, n + 1):
            for first in range(2, end + 1):
                c = s2[end] - s2[first - 1] - (s1[end] - s1[first - 1]) ** 2 / (end - first + 1) + cost[j - 1, first - 1]
                if c < cost[j, end]:
                    cost[j, end], start[j, end] = c, first
    return cost[k, n], k


def spread(x, breaks):
    """Squared deviation of the classes that breaks cut a sorted array into; a class ends with its break."""
    x, total, low = np.sort(np.asarray(x, float)), 0.0, -np.inf
    for b in breaks[1:]:
        part = x[(x > low) & (x <= b)]
        total, low = total + (((part - part.mean()) ** 2).sum() if len(part) else 0.0), b
    return total


def test_breaks_are_the_best_ones():
    rng = np.random.default_rng(5)
    for i in range(60):
        x = rng.integers(0, 12, rng.integers(3, 40)).astype(float) if i % 2 else rng.gamma(2, 3, rng.integers(3, 40))
        if x.min() == x.max():
            continue
        best, k = plain_breaks(x)
        got = ix.natural_breaks(x)
        assert got == sorted(got) and got[0] == x.min() and got[-1] == x.max() and len(got) == k + 1
        assert spread(x, got) <= best + 1e-7 * max(1.0, best)
    assert len(ix.natural_breaks(rng.normal(size=50_000))) == 8
