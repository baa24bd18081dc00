"""City-day, month and season indices, levels, polarisation and typologies.

``city_day`` is the only table built from posts; it is small beside them (cities x days),
so windows by city stay bounded however many posts a city has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermalis.functions.calendar import season


@dataclass(frozen=True)
class IndexConfig:
    positive_label: int = 1
    winsor_lower: float = 0.01
    winsor_upper: float = 0.99
    alpha: float = 1.6
    high_min_level: int = 5
    epsilon: float = 1e-8
    min_heat_posts: int = 1000
    min_active_days: int = 50
    min_seasonal_coverage: float = 0.15
    apply_eligibility_filters: bool = True
    classes: int = 7


PLACE = ["city", "continent", "country", "hemisphere"]


def first_known(c: str) -> Column:
    """The first non-null value in row order."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_index"))).alias(c)


def settled(c: str) -> Column:
    """A sum of doubles rounded so far that the order of its terms can't decide a comparison."""
    return F.round(c, 9)


def percent(df: DataFrame, *columns: str) -> DataFrame:
    """Each ``..._hpii...`` column times 100, named with ``percent`` after ``hpii`` (or ``hpvi``)."""
    return df.withColumns({c.replace("hpii", "hpii_percent", 1).replace("hpvi", "hpvi_percent", 1): F.col(c) * 100 for c in columns})


def share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def city_day(posts: DataFrame, totals: DataFrame | None = None, total_col: str | None = None, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """One row for each city and day: counts, denominator, its source, and the daily index.

    ``totals`` (city, date, total_posts) is joined from outside; ``total_col`` takes the
    first value of a column of the posts instead; else rows observed are the denominator.
    """
    heat = F.coalesce(F.expr("try_cast(indicator as double)"), F.lit(0.0)).cast("int") == cfg.positive_label
    flags = [F.max(c).alias(c) for c in ("date_is_synthetic", "hemisphere_is_inferred") if c in posts.columns]
    own = [first_known(total_col).alias("own_total")] if total_col else []
    meta = [first_known(c) for c in ("continent", "country", "hemisphere", "year", "month", "month_num", "season")]
    days = posts.groupBy("city", "date").agg(F.sum(heat.cast("int")).alias("heat_posts"), F.count("*").alias("observed_posts"), *meta, *flags, *own)
    proxy = F.lit("observed_input_rows_proxy")
    if totals is not None:
        days = days.join(totals.select("city", "date", "total_posts"), ["city", "date"], "left")
        source = F.when(F.col("total_posts").isNull(), proxy).otherwise("external_city_day_totals")
        days = days.withColumn("denominator_source", source).withColumn("total_posts", F.coalesce("total_posts", "observed_posts"))
    elif total_col:
        days = days.withColumn("total_posts", F.coalesce("own_total", "observed_posts")).drop("own_total")
        days = days.withColumn("denominator_source", F.when(F.col("total_posts") == F.col("observed_posts"), proxy).otherwise("input_total_posts_col"))
    else:
        days = days.withColumn("total_posts", F.col("observed_posts")).withColumn("denominator_source", proxy)
    days = days.withColumn("denominator_is_proxy", (F.col("denominator_source") == proxy).cast("int"))
    days = days.withColumn("daily_hpii_raw", share("heat_posts", "total_posts")).withColumn("daily_hpii_used", F.col("daily_hpii_raw"))
    return percent(days, "daily_hpii_raw", "daily_hpii_used")


def normalise_city_month(days: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """Residuals from the city-month's median, clipped to its own quantiles. Null keys are left out."""
    w = Window.partitionBy("city", "month")
    out = days.where("city is not null and month is not null")
    out = out.withColumn("residual", F.col("daily_hpii_raw") - F.percentile("daily_hpii_raw", F.lit(0.5)).over(w))
    lo, hi = (F.percentile("residual", F.lit(q)).over(w) for q in (cfg.winsor_lower, cfg.winsor_upper))
    out = out.withColumn("daily_hpii_norm", F.when(F.col("residual").isNotNull(), F.least(F.greatest("residual", lo), hi)))
    return percent(out.drop("residual").withColumn("daily_hpii_used", F.col("daily_hpii_norm")), "daily_hpii_norm", "daily_hpii_used")


def coverage(days: DataFrame) -> DataFrame:
    """Per city and season: calendar days in the city's span, days observed, and their ratio."""
    span = days.groupBy("city").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.min("hemisphere").alias("hemisphere")).where("city is not null and a is not null")
    every = span.select("city", "hemisphere", F.explode(F.sequence("a", "b")).alias("date"))
    expected = every.groupBy("city", season(F.month("date"), F.col("hemisphere")).alias("season")).agg(F.count("*").alias("expected_days"))
    observed = days.groupBy("city", "season").agg(F.count_distinct("date").alias("observed_unique_days"))
    out = expected.join(observed, ["city", "season"], "left").withColumn("observed_unique_days", F.coalesce("observed_unique_days", F.lit(0)).cast("long"))
    return out.withColumn("coverage_frac", share("observed_unique_days", "expected_days"))


def eligibility(days: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """Per city: posts, days, coverage and whether it passes all three bounds (all cities do with the filters switched off)."""
    summary = days.where("city is not null").groupBy("city").agg(F.sum("heat_posts").alias("total_heat_posts"), F.count_distinct("date").alias("active_days"), F.count_distinct("season").alias("season_n"))
    cover = coverage(days).groupBy("city").agg(F.min("coverage_frac").alias("coverage_min_frac"), F.avg("coverage_frac").alias("coverage_mean_frac"), F.sum("expected_days").alias("expected_days_total"), F.sum("observed_unique_days").alias("observed_days_total"))
    passes = (F.col("total_heat_posts") >= cfg.min_heat_posts) & (F.col("active_days") >= cfg.min_active_days) & (F.col("coverage_min_frac") >= cfg.min_seasonal_coverage)
    passes = F.coalesce(passes, F.lit(False)) if cfg.apply_eligibility_filters else F.lit(True)
    return summary.join(cover, "city", "left").withColumn("eligible_city", passes.cast("int"))


def eligible_days(days: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    return days.join(eligibility(days, cfg).where("eligible_city = 1"), "city", "left_semi") if cfg.apply_eligibility_filters else days


def known(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(" and ".join(f"{k} is not null" for k in keys))


def monthly(days: DataFrame) -> DataFrame:
    keys = [*PLACE, "year", "month", "month_num", "season"]
    out = known(days, keys).groupBy(*keys).agg(
        F.sum("heat_posts").alias("month_heat_posts"),
        F.sum("total_posts").alias("month_total_posts"),
        F.sum("daily_hpii_raw").alias("month_hpii_daily_sum"),
        F.avg("daily_hpii_raw").alias("month_hpii_daily_mean"),
        F.sum("daily_hpii_used").alias("month_hpii_norm_sum"),
        F.count_distinct("date").alias("month_active_days"),
    )
    return percent(out.withColumn("month_hpii", share("month_heat_posts", "month_total_posts")), "month_hpii")


def variability(days: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """Deviation over mean of the trailing seven-row average, per city and season."""
    smooth = F.avg("daily_hpii_used").over(Window.partitionBy("city").orderBy("date").rowsBetween(-6, 0))
    keys = [*PLACE, "season"]
    out = known(days.withColumn("daily_hpii_7d", smooth), keys).groupBy(*keys).agg(F.avg("daily_hpii_7d").alias("m"), F.stddev_pop("daily_hpii_7d").alias("s"), F.count("daily_hpii_7d").alias("hpvi_days_used"))
    out = out.withColumn("hpvi", F.when((F.abs("m") < 1e-15) & (F.abs("s") < 1e-15), F.lit(0.0)).otherwise(F.col("s") / (F.abs("m") + cfg.epsilon))).drop("m", "s")
    out = percent(out, "hpvi")
    tier = F.when(F.col("hpvi").isNull(), "unknown").when(F.col("hpvi") <= 0.1, "low").when(F.col("hpvi") <= 0.3, "moderate").otherwise("high")
    return out.withColumn("hpvi_tier", tier).withColumn("hpvi_high_binary", F.coalesce(F.col("hpvi") > 0.3, F.lit(False)).cast("int"))


def peak_months(by_month: DataFrame, keys: list[str]) -> DataFrame:
    """The month with the greatest index for each key; of equals the earliest."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("month_hpii"), "year", "month_num")
    return by_month.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def seasonal(days: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """City-season sums, peak month and variability (levels are added by ``with_levels``)."""
    keys = [*PLACE, "season"]
    flags = [F.max(c).alias(c) for c in ("date_is_synthetic", "denominator_is_proxy") if c in days.columns]
    out = known(days, keys).groupBy(*keys).agg(
        F.sum("heat_posts").alias("seasonal_heat_posts"),
        F.sum("total_posts").alias("seasonal_total_posts"),
        F.avg("daily_hpii_raw").alias("seasonal_hpii_daily_mean"),
        F.sum("daily_hpii_raw").alias("seasonal_hpii_daily_sum"),
        F.sum("daily_hpii_used").alias("seasonal_hpii_norm_sum"),
        F.count_distinct("date").alias("seasonal_active_days"),
        *flags,
    )
    out = percent(out.withColumn("seasonal_hpii", share("seasonal_heat_posts", "seasonal_total_posts")), "seasonal_hpii")
    peaks = peak_months(monthly(days), ["city", "season"]).select("city", "season", F.col("month").alias("peak_month_in_season"), F.col("month_hpii").alias("peak_month_hpii"), F.col("month_hpii_percent").alias("peak_month_hpii_percent"))
    return out.join(peaks, ["city", "season"], "left").join(variability(days, cfg), keys, "left")


def _next_class(s1: np.ndarray, s2: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least cost, first element of the last class) up to each element, given the costs with one class less.

    The best start never moves back as the end moves on, so the ends are halved again and again: each
    level looks only between the starts found beside it, all of a level's ends at once.
    """
    n = len(cost) - 1
    out, start = np.full(n + 1, np.inf), np.ones(n + 1, int)
    out[1] = 0.0
    step = 1 << max(0, (n - 1).bit_length())
    done = np.zeros(n + 2, bool)
    while step:
        ends = np.arange(step + 1, n + 1, 2 * step) if step > 1 or n > 1 else np.zeros(0, int)
        ends = ends[(ends >= 2) & ~done[ends]]
        if len(ends):
            left, right = ends - step, ends + step
            lo = np.where((left >= 2) & done[np.maximum(left, 0)], start[np.maximum(left, 0)], 2)
            inside = right <= n
            hi = np.where(inside & done[np.minimum(right, n)], start[np.minimum(right, n)], ends)
            lo, hi = np.maximum(lo, 2), np.minimum(hi, ends)
            size = np.maximum(hi - lo, 0) + 1
            at = np.cumsum(size) - size
            first = np.arange(size.sum()) - np.repeat(at, size) + np.repeat(lo, size)
            end = np.repeat(ends, size)
            total = s2[end] - s2[first - 1] - (s1[end] - s1[first - 1]) ** 2 / (end - first + 1) + cost[first - 1]
            best = np.minimum.reduceat(total, at)
            hit = np.flatnonzero(total == np.repeat(best, size))
            which = np.searchsorted(at, hit, side="right") - 1
            _, earliest = np.unique(which, return_index=True)
            out[ends], start[ends], done[ends] = best, first[hit[earliest]], True
        step //= 2
    return out, start


def natural_breaks(values: np.ndarray, classes: int = 7) -> list[float]:
    """Boundaries of the partition into classes of least squared deviation, first and last included.

    Of equal partitions the one whose last class starts earliest wins. With too few
    values there are fewer classes; without values the boundaries are 0 and 1.
    """
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not n:
        return [0.0, 1.0]
    if x[0] == x[-1]:
        return [float(x[0])] * (classes + 1)
    k = max(2, min(classes, n))
    s1, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cost = np.concatenate([[np.inf], s2[1:] - s1[1:] ** 2 / np.arange(1, n + 1)])
    starts = [np.ones(n + 1, int)]
    for _ in range(2, k + 1):
        cost, start = _next_class(s1, s2, cost)
        starts.append(start)
    breaks, end = [float(x[-1])], n
    for j in range(k, 1, -1):
        breaks.append(float(x[max(0, starts[j - 1][end] - 2)]))
        end = starts[j - 1][end] - 1
    return [float(x[0]), *reversed(breaks)] if len(breaks) == k else breaks


def breaks_table(df: DataFrame, column: str, classes: int = 7) -> DataFrame:
    """One row with the array ``breaks``. Takes one value for each city and season, in one task."""

    def fit(batches):
        import pandas as pd

        values = [b["v"].dropna().to_numpy() for b in batches]
        yield pd.DataFrame({"breaks": [natural_breaks(np.concatenate(values) if values else np.zeros(0), classes)]})

    return df.select(F.col(column).cast("double").alias("v")).repartition(1).mapInPandas(fit, "breaks array<double>")


def with_levels(seasons: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """Natural-breaks level, its Roman numeral, and the intensity-variability type."""
    out = seasons.join(F.broadcast(breaks_table(seasons, "seasonal_hpii_percent", cfg.classes)))
    v, b = F.col("seasonal_hpii_percent"), F.col("breaks")
    inner = F.filter(F.sequence(F.lit(1), F.size(b) - 1), lambda i: v <= F.get(b, i))
    level = F.when(F.array_min(b) == F.array_max(b), 1).when(v.isNull(), None).otherwise(F.coalesce(F.try_element_at(inner, F.lit(1)), F.size(b) - 1))
    out = out.withColumn("hpii_level", level.cast("int")).drop("breaks")
    out = out.withColumn("hpii_level_roman", F.try_element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "VI", "VII"))), F.col("hpii_level")))
    out = out.withColumn("high_hpii_binary", F.coalesce(F.col("hpii_level") >= cfg.high_min_level, F.lit(False)).cast("int"))
    hi, hv = F.col("high_hpii_binary") == 1, F.coalesce(F.col("hpvi_high_binary") == 1, F.lit(False))
    return out.withColumn("intensity_variability_typology", F.when(hi & hv, "Perception Hotspots").when(hi, "Stable High").when(~hv, "Stable Low").otherwise("Variability Low"))


def typology(seasons: DataFrame, by_month: DataFrame) -> DataFrame:
    """Per city: peak and dominant season, summer and winter values, high seasons and counter-seasonal label; one aggregation for all seasons.

    Of seasons with equal sums (to nine decimals) the first by name dominates.
    """
    names = {"season": "peak_season", "month": "peak_month", "month_hpii": "peak_month_hpii_global", "month_hpii_percent": "peak_month_hpii_percent_global"}
    peak = peak_months(by_month, ["city"]).select(*PLACE, *(F.col(a).alias(b) for a, b in names.items()))
    w = Window.partitionBy("city").orderBy(settled("seasonal_hpii_daily_sum").desc_nulls_last(), "season")
    names = {"season": "total_dominant_season", "seasonal_hpii_daily_sum": "total_dominant_hpii_sum", "seasonal_hpii": "total_dominant_hpii", "seasonal_hpii_percent": "total_dominant_hpii_percent"}
    top = seasons.withColumn("k", F.row_number().over(w)).where("k = 1").select("city", *(F.col(a).alias(b) for a, b in names.items()))
    wanted = {"total_hpii_sum": "seasonal_hpii_daily_sum", "peak_month_hpii": "peak_month_hpii", "peak_month_hpii_percent": "peak_month_hpii_percent"}
    cells = seasons.groupBy("city").agg(
        F.sum("high_hpii_binary").alias("n_high_hpii_seasons"),
        *(F.max(F.when(F.col("season") == s, F.col(c))).alias(f"{s.lower()}_{name}") for s in ("Summer", "Winter") for name, c in wanted.items()),
    )
    over = lambda c: F.coalesce(settled(f"winter_{c}"), F.lit(float("-inf"))) > F.coalesce(settled(f"summer_{c}"), F.lit(float("-inf")))
    by_peak, by_total = over("peak_month_hpii"), over("total_hpii_sum")
    label = F.when(by_peak & by_total, "Both").when(by_peak, "Peak").when(by_total, "Total").otherwise("NoCounterSeasonal")
    return (
        peak.join(top, "city", "full_outer")
        .join(cells, "city", "left")
        .withColumns(
            {
                "peak_total_coincide": F.coalesce(F.col("peak_season") == F.col("total_dominant_season"), F.lit(False)).cast("int"),
                "multi_season_high_hpii": (F.col("n_high_hpii_seasons") >= 2).cast("int"),
                "counter_seasonal_label": label,
                "counter_seasonal_binary": (label != "NoCounterSeasonal").cast("int"),
            }
        )
    )


def index_tables(raw: DataFrame, cfg: IndexConfig = IndexConfig(), normalise: bool = False) -> dict[str, DataFrame]:
    """All tables of an index run by name, from its city days: days, months, seasons, typology, polarisation, volume strata, eligibility."""
    every = normalise_city_month(raw, cfg) if normalise else raw
    days = eligible_days(every, cfg)
    by_month, seasons = monthly(days), with_levels(seasonal(days, cfg), cfg)
    strata = volume_strata(days)
    return {
        "city_day": days,
        "city_month": by_month,
        "city_season": with_volume(seasons, strata),
        "city_typology": with_volume(typology(seasons, by_month), strata),
        "polarization": polarisation(seasons, cfg),
        "volume_strata": strata,
        "city_eligibility": eligibility(every, cfg),
    }


def index_run(posts: DataFrame, totals: DataFrame | None = None, total_col: str | None = None, cfg: IndexConfig = IndexConfig(), normalise: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables of an index run by name, and its summary (one row), which says what the run rests on.

    Lazy; ``sources.runs`` writes a run and reads its posts once.
    """
    tables = index_tables(city_day(posts, totals, total_col, cfg), cfg, normalise)
    days, seasons = tables["city_day"], tables["city_season"]
    part = lambda c: (F.avg(F.col(c).cast("double")) if c in days.columns else F.lit(0.0)).alias(c.replace("is_", "") + "_fraction")
    summary = days.agg(F.count("*").alias("city_days"), F.count_distinct("city").alias("cities"), F.sum("heat_posts").alias("heat_posts"), F.sum("total_posts").alias("total_posts"), part("denominator_is_proxy"), part("date_is_synthetic"), part("hemisphere_is_inferred"))
    return tables, summary.crossJoin(F.broadcast(breaks_table(seasons, "seasonal_hpii_percent", cfg.classes)))  # one row each


def volume_strata(days: DataFrame) -> DataFrame:
    """Cities by annual posts: Low to the 30th percentile, Medium to the 70th, else High."""
    annual = days.where("city is not null").groupBy("city").agg(F.sum("total_posts").alias("annual_total_posts"), F.sum("heat_posts").alias("annual_heat_posts"), F.count_distinct("date").alias("active_days"))
    cuts = annual.agg(F.percentile("annual_total_posts", F.lit(0.3)).alias("q30"), F.percentile("annual_total_posts", F.lit(0.7)).alias("q70"))
    out = annual.join(F.broadcast(cuts))
    return out.withColumn("tweet_volume_stratum", F.when(F.col("annual_total_posts") <= F.col("q30"), "Low").when(F.col("annual_total_posts") <= F.col("q70"), "Medium").otherwise("High")).drop("q30", "q70")


def _polarisation(seasons: DataFrame, column: str, kind: str, out: str, alpha: float) -> DataFrame:
    """Normalised Esteban-Ray polarisation per continent and season, from running sums instead of pairs."""
    g = Window.partitionBy("continent", "season")
    v = F.coalesce(F.when(F.abs(F.col(column)) != float("inf"), F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))), F.lit(0.0))
    rows = known(seasons, ["continent", "season"]).select("continent", "season", v.alias("v"))
    lo, hi = F.min("v").over(g), F.max("v").over(g)
    rows = rows.withColumn("scaled", F.when(hi > lo, (F.col("v") - lo) / (hi - lo)).otherwise(0.0))
    x, cuts = (F.col("scaled"), (1 / 3, 2 / 3)) if kind == "hpii" else (F.col("v"), (0.10, 0.30))
    rows = rows.withColumn("a", (F.col("scaled") + 1e-9) * F.when(x <= cuts[0], 1.0).when(x <= cuts[1], 2.0).otherwise(3.0))
    rows = rows.withColumn("p", F.col("a") / F.sum("a").over(g))
    up = g.orderBy("a").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    below, mass = F.sum("p").over(up), F.sum(F.col("p") * F.col("a")).over(up)
    rows = rows.withColumn("away", F.col("a") * (2 * below - F.sum("p").over(g)) - (2 * mass - F.sum(F.col("p") * F.col("a")).over(g)))
    score = F.sum(F.pow("p", F.lit(1 + alpha)) * F.col("away")) / (F.sum(F.pow("p", F.lit(1 + alpha))) * F.greatest(F.max("a") - F.min("a"), F.lit(1e-12)))
    return rows.groupBy("continent", "season").agg(F.when(F.count("*") <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias(out))


def polarisation(seasons: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    keys = ["continent", "season"]
    n = known(seasons, keys).groupBy(*keys).agg(F.count_distinct("city").alias("n_cities"))
    out = n
    for column, kind, name in (("seasonal_hpii_percent", "hpii", "hppi_hpii"), ("hpvi", "hpvi", "hppi_hpvi")):
        out = out.join(_polarisation(seasons, column, kind, name, cfg.alpha), keys)
    tier = lambda c: F.when(F.col(c) < 0.05, "low").when(F.col(c) <= 0.15, "moderate").otherwise("high").alias(c + "_tier")
    return out.select("*", tier("hppi_hpii"), tier("hppi_hpvi"))


def with_volume(df: DataFrame, strata: DataFrame) -> DataFrame:
    return df.join(strata.select("city", "tweet_volume_stratum"), "city", "left")
