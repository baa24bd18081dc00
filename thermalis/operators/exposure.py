"""Lagged exposure-outcome models: exposures, model comparison, joint effects, pooling, report tables.

The panel has one row for each city, date, class and type: country, temp, heatPerception,
pm25, holiday, month, dow, count. Models are fitted per city, type and class by one grouped
map, whose groups are a city's days (bounded by the calendar, not by the events counted).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermalis.functions import lexicon
from thermalis.operators.percentiles import exact_percentiles
from thermalis.sources.scratch import saved

SERIES = ["country", "city", "type", "class"]
WINNERS = [f"{q}-{r}" for q in "PST" for r in "PST"]
CLASSES = ["all-cause", "age0_69", "age70_", "female", "male", *map(chr, range(65, 91))]
CASES = ["Normal & Low", "Normal & High", "Heat & Low", "Heat & High"]
Z = 1.96


def exposures(panel: DataFrame, season_mode: str = "warm", quantile: float = 0.95, perception: float = 1.0, excluded: str | None = "Benito Juárez") -> DataFrame:
    """Warm season, hot days (over the city's own quantile), high perception and their joint level 1-4.

    The quantile is found by passes that count (``percentiles``) and joined, so a city's rows stay spread and no task
    holds its values. The rows are written once before: a temperature that is a mean may differ in its last bit when it is
    worked out again, and all passes and the comparison need the same one. A null temperature is an error.
    """
    rows = panel.where(F.col("city") != excluded) if excluded else panel
    rows = rows.withColumn("temp", F.when(F.col("temp").isNull(), F.raise_error(F.lit("a row has no temperature"))).otherwise(F.col("temp")))
    mexico, mid = F.col("country") == "Mexico", F.col("month").between(5, 9)
    rows = rows.withColumn("warm_season", F.when(mexico, mid).otherwise(~mid).cast("int"))
    rows = saved(rows, "exposures")
    cut = exact_percentiles(rows, ["city"], "temp", [quantile]).withColumnRenamed("q0", "cut")
    rows = rows.join(cut, "city").withColumn("heatday", (F.col("temp") > F.col("cut")).cast("int")).drop("cut")
    rows = rows.withColumn("percep", (F.col("heatPerception") >= perception).cast("int"))
    rows = rows.withColumn("comb_exp", 1 + F.col("percep") + 2 * F.col("heatday"))
    return rows.where("warm_season = 1") if season_mode == "warm" else rows


def joint_counts(rows: DataFrame) -> DataFrame:
    """Days in each joint level, per city."""
    return rows.groupBy("city").agg(*(F.sum((F.col("comb_exp") == k).cast("int")).alias(f"cat{k}") for k in range(1, 5)), F.count("*").alias("n"))


def lagged(rows: DataFrame, column: str, out: str, lags: int = 2) -> DataFrame:
    """Sum of a column over this row and the ``lags`` before it in its series; null at the start."""
    w = Window.partitionBy(*SERIES).orderBy("date")
    terms = [F.lag(column, k).over(w) for k in range(lags + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return rows.withColumn(out, total)


def lag_basis(rows: DataFrame, lags: int = 2) -> DataFrame:
    """Lag-summed terms of both binary exposures and of joint levels 2 to 4."""
    for k in (2, 3, 4):
        rows = rows.withColumn(f"level{k}", (F.col("comb_exp") == k).cast("int"))
    names = {"heatday": "cb_temp", "percep": "cb_perc", **{f"level{k}": f"cb{k}" for k in (2, 3, 4)}}
    for c, out in names.items():
        rows = lagged(rows, c, out, lags)
    return rows.drop("level2", "level3", "level4")


def quasi_poisson(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 25, tolerance: float = 1e-8) -> dict:
    """Log-link Poisson fit by reweighted least squares, with Pearson dispersion.

    Columns that depend on earlier ones get no coefficient (null) but count in ``n_coef``.
    """
    keep, basis = [], np.zeros((len(y), 0))
    for k in range(x.shape[1]):
        col = x[:, k].astype(float)
        rest = col - basis @ (basis.T @ col)
        rest -= basis @ (basis.T @ rest)
        if np.linalg.norm(rest) > 1e-7 * max(1.0, np.linalg.norm(col)):
            keep.append(k)
            basis = np.column_stack([basis, rest / np.linalg.norm(rest)])
    a = x[:, keep].astype(float)
    mu = y + 0.1
    eta, dev, converged = np.log(mu), np.inf, False
    part = lambda m: 2 * np.sum(np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / m), 0) - (y - m))
    for _ in range(rounds):
        z, root = eta + (y - mu) / mu, np.sqrt(mu)
        coef, *_ = np.linalg.lstsq(a * root[:, None], z * root, rcond=None)
        eta = np.clip(a @ coef, -700, 700)
        mu = np.exp(eta)
        new = part(mu)
        if abs(new - dev) / (abs(new) + 0.1) < tolerance:
            converged = True
            dev = new
            break
        dev = new
    free = len(y) - len(keep)
    phi = float(np.sum((y - mu) ** 2 / mu) / free) if free > 0 else math.nan
    cov = np.linalg.pinv((a * mu[:, None]).T @ a) * phi
    loglik = float(np.sum(y * np.log(mu) - mu) - sum(math.lgamma(v + 1) for v in y))
    null = float(part(np.full(len(y), y.mean())))
    place = {names[k]: i for i, k in enumerate(keep)}
    return {"coef": {n: coef[i] for n, i in place.items()}, "cov": cov, "place": place, "phi": phi, "loglik": loglik, "n_coef": x.shape[1], "rank": len(keep), "qaic": -2 * loglik + 2 * x.shape[1] * phi, "r2": 1 - dev / null if null > 0 else -math.inf, "converged": converged}


def design(pdf: pd.DataFrame, terms: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Intercept, terms, weekday and month indicators (first level left out), holiday and pm25; rows with nulls go."""
    used = pdf[[*terms, "dow", "holiday", "month", "pm25", "count"]].dropna()
    cols, names = [np.ones(len(used))], ["intercept"]
    for t in terms:
        cols.append(used[t].to_numpy(float))
        names.append(t)
    for f in ("dow", "month"):
        for level in sorted(used[f].unique())[1:]:
            cols.append((used[f] == level).to_numpy(float))
            names.append(f"{f}{level}")
    for t in ("holiday", "pm25"):
        cols.append(used[t].to_numpy(float))
        names.append(t)
    return np.column_stack(cols), used["count"].to_numpy(float), names


def compare_models(basis: DataFrame) -> DataFrame:
    """Per series: QAIC, pseudo-R2 and convergence of the temperature and of the perception model."""
    columns = [f"{m}_{k}" for k in ("temp", "perc") for m in ("qaic", "r2", "converged", "n_coef", "rank")]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        row = {c: pdf[c].iloc[0] for c in SERIES}
        for k in ("temp", "perc"):
            try:
                m = quasi_poisson(*design(pdf, [f"cb_{k}"]))
            except (np.linalg.LinAlgError, ValueError):
                m = {"qaic": math.nan, "r2": math.nan, "converged": False, "n_coef": 0, "rank": 0}
            row |= {f"{x}_{k}": m[x] for x in ("qaic", "r2", "converged", "n_coef", "rank")}
        return pd.DataFrame([row])[[*SERIES, *columns]]

    kinds = ", ".join(f"{c} {'boolean' if c.startswith('conv') else 'long' if c[0] == 'n' or c.startswith('rank') else 'double'}" for c in columns)
    return basis.groupBy(*SERIES).applyInPandas(fit, f"country string, city string, type string, class string, {kinds}")


def classify_winners(models: DataFrame, qaic: float = 2.0, r2: float = 0.02) -> DataFrame:
    """Which exposure explains more, by QAIC and by R2; series without two converged finite fits go."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    rows = models.where(F.col("converged_temp") & F.col("converged_perc") & finite("r2_temp") & finite("r2_perc"))
    dq, dr = F.col("qaic_temp") - F.col("qaic_perc"), F.col("r2_temp") - F.col("r2_perc")
    rows = rows.withColumn("delta_qaic", dq).withColumn("delta_r2", dr)
    q = F.when(F.abs("delta_qaic") <= qaic, "S").when(F.col("delta_qaic") > qaic, "P").otherwise("T")
    r = F.when(F.abs("delta_r2") <= r2, "S").when(F.col("delta_r2") > r2, "T").otherwise("P")
    return rows.withColumn("qaic_winner", q).withColumn("r2_winner", r).withColumn("winner", F.concat_ws("-", "qaic_winner", "r2_winner"))


def winner_grid(winners: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """Every type and class with its number of cities and the nine counts, zeros filled in.

    The grid is the fixed list of classes exploded beside the types found.
    """
    counts = winners.groupBy("type", "class").pivot("winner", WINNERS).agg(F.count(F.lit(1)))
    cities = winners.groupBy("type", "class").agg(F.count("*").alias("city_num"))
    grid = winners.select("type").distinct().withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    out = grid.join(cities, ["type", "class"], "left").join(counts, ["type", "class"], "left")
    return out.select("type", "class", "city_num", *(F.coalesce(F.col(f"`{w}`"), F.lit(0)).cast("long").alias(w) for w in WINNERS))


def winner_long(grid: DataFrame) -> DataFrame:
    """One row for each type, class and winner, with its share of the class's cities."""
    out = grid.unpivot(["type", "class", "city_num"], WINNERS, "winner", "n")
    return out.withColumn("pct", F.try_divide(F.col("n") * 100.0, "city_num"))


def win_rates(grid: DataFrame) -> DataFrame:
    """Roll-up per type. R2 totals of either side leave out the pairs that the other side wins by QAIC."""
    n = {w: F.sum(F.col(f"`{w}`")) for w in WINNERS}
    total = F.sum("city_num")
    fields = {
        "P_QAIC_only": n["P-S"] + n["P-T"],
        "P_R2_only": n["S-P"],
        "P_both": n["P-P"],
        "P_either": n["P-S"] + n["P-T"] + n["S-P"] + n["P-P"],
        "T_QAIC_only": n["T-S"] + n["T-P"],
        "T_R2_only": n["S-T"],
        "T_both": n["T-T"],
        "T_either": n["T-S"] + n["T-P"] + n["S-T"] + n["T-T"],
        "S_both": n["S-S"],
    }
    counts = [v.alias(f"n_{k}") for k, v in fields.items()]
    return grid.groupBy("type").agg(total.alias("n_pairs"), *counts, *(F.try_divide(100.0 * v, total).alias(f"pct_{k}") for k, v in fields.items()))


def win_summary(rates: DataFrame) -> DataFrame:
    """Long percentages with the one-line annotation of each type."""
    text = F.format_string("P %.0f%% | S %.0f%% | T %.0f%%", "pct_P_either", "pct_S_both", "pct_T_either")
    parts = ["P_both", "P_QAIC_only", "P_R2_only", "S_both", "T_R2_only", "T_QAIC_only", "T_both"]
    out = rates.withColumn("annotation", text)
    return out.unpivot(["type", "annotation"], [f"pct_{p}" for p in parts], "category", "pct").withColumn("category", F.regexp_replace("category", "^pct_", ""))


def joint_effects(basis: DataFrame, lags: int = 2) -> DataFrame:
    """Per series: reduced coefficients b1-b3, their covariance, and relative risks by ``joint_rr``; one fit for both."""
    factor = lags + 1
    cov_names = ["v11", "v21", "v31", "v22", "v32", "v33"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        row = {c: pdf[c].iloc[0] for c in SERIES}
        try:
            terms = ["cb2", "cb3", "cb4"]
            m = quasi_poisson(*design(pdf, terms))
            at = [m["place"][t] for t in terms]
            row |= {f"b{k + 1}": m["coef"][t] * factor for k, t in enumerate(terms)}
            v = m["cov"][np.ix_(at, at)] * factor**2
            row |= dict(zip(cov_names, [v[i, j] for j in range(3) for i in range(j, 3)], strict=True))
        except (KeyError, np.linalg.LinAlgError, ValueError):
            row |= dict.fromkeys(["b1", "b2", "b3", *cov_names])
        out = pd.DataFrame([row])[[*SERIES, "b1", "b2", "b3", *cov_names]]
        return out.astype({c: float for c in out.columns[4:]}).where(out.notna(), None)

    kinds = ", ".join(f"{c} double" for c in ("b1", "b2", "b3", *cov_names))
    return basis.groupBy(*SERIES).applyInPandas(fit, f"country string, city string, type string, class string, {kinds}").where("b1 is not null and not isnan(b1)")


def _risks(keys: list[str], df: DataFrame) -> DataFrame:
    """Rows of the four cases with relative risk and interval from b1-b3 and v11, v22, v33."""
    cells = [F.struct(F.lit(CASES[0]).alias("case"), F.lit(0.0).alias("beta"), F.lit(0.0).alias("se"))]
    cells += [F.struct(F.lit(CASES[k]).alias("case"), F.col(f"b{k}").alias("beta"), F.sqrt(f"v{k}{k}").alias("se")) for k in (1, 2, 3)]
    out = df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
    return out.select(*keys, "case", F.exp("beta").alias("rr"), F.exp(F.col("beta") - Z * F.col("se")).alias("rrlow"), F.exp(F.col("beta") + Z * F.col("se")).alias("rrhigh"), "beta", "se")


def joint_rr(effects: DataFrame) -> DataFrame:
    return _risks(SERIES, effects)


def random_effects(b: np.ndarray, s: np.ndarray, rounds: int = 300, tolerance: float = 1e-8):
    """Multivariate random-effects pooling by EM for restricted likelihood: mean, its covariance, between-study covariance, converged."""
    k, p = b.shape
    psi = np.cov(b.T) if k > 1 else np.zeros((p, p))
    psi = np.atleast_2d(psi) + 1e-10 * np.eye(p)
    if k == 1:
        return b[0], s[0], np.zeros((p, p)), True
    for _ in range(rounds):
        w = np.linalg.inv(s + psi)
        cov = np.linalg.inv(w.sum(axis=0))
        mean = cov @ np.einsum("kij,kj->i", w, b)
        new = np.zeros_like(psi)
        for i in range(k):
            shift = psi @ w[i] @ (b[i] - mean)
            inner = psi - psi @ w[i] @ psi + psi @ w[i] @ cov @ w[i] @ psi
            new += np.outer(shift, shift) + inner
        new /= k
        done = np.max(np.abs(new - psi)) < tolerance * max(1.0, np.max(np.abs(psi)))
        psi = new
        if done:
            break
    w = np.linalg.inv(s + psi)
    cov = np.linalg.inv(w.sum(axis=0))
    return cov @ np.einsum("kij,kj->i", w, b), cov, psi, bool(done)


def pool_effects(effects: DataFrame) -> DataFrame:
    """Pooled b1-b3 and variances per type and class. A group holds one row for each city."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("city")
        b = pdf[["b1", "b2", "b3"]].to_numpy(float)
        s = np.zeros((len(pdf), 3, 3))
        for i in range(3):
            for j in range(i, 3):
                s[:, j, i] = s[:, i, j] = pdf[f"v{j + 1}{i + 1}"].to_numpy(float)
        mean, cov, _, ok = random_effects(b, s)
        return pd.DataFrame([[pdf["type"].iloc[0], pdf["class"].iloc[0], len(pdf), *mean, *np.diag(cov), ok]], columns=["type", "class", "studies", "b1", "b2", "b3", "v11", "v22", "v33", "converged"])

    return effects.groupBy("type", "class").applyInPandas(fit, "type string, class string, studies long, b1 double, b2 double, b3 double, v11 double, v22 double, v33 double, converged boolean")


def _inverse(m: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    """Inverse of a symmetric 3 x 3 matrix given by its lower triangle; null where it has none."""
    at = lambda i, j: m[max(i, j), min(i, j)]
    # cofactors: with cyclic indices their signs come out right
    minor = lambda i, j: at((i + 1) % 3, (j + 1) % 3) * at((i + 2) % 3, (j + 2) % 3) - at((i + 1) % 3, (j + 2) % 3) * at((i + 2) % 3, (j + 1) % 3)
    whole = at(0, 0) * minor(0, 0) + at(0, 1) * minor(0, 1) + at(0, 2) * minor(0, 2)
    return {(i, j): F.try_divide(minor(i, j), whole) for j in range(3) for i in range(j, 3)}


def pool_fixed(effects: DataFrame, keys: tuple[str, ...] = ("type", "class")) -> DataFrame:
    """Fixed-effect pooling of b1-b3 in closed form: generalised least squares with each study's covariance.

    Studies are weighted by their inverse covariances, which are added up before the shuffle; no study is moved. Also Cochran's Q
    and its degrees of freedom. Studies with a null, or without an inverse, are left out.
    """
    low = [(i, j) for j in range(3) for i in range(j, 3)]
    given = {(i, j): F.col(f"v{i + 1}{j + 1}") for i, j in low}
    b = [F.col(f"b{k}") for k in (1, 2, 3)]
    weights = effects.withColumns({f"_w{i}{j}": c for (i, j), c in _inverse(given).items()})
    w = lambda i, j: F.col(f"_w{max(i, j)}{min(i, j)}")
    turned = [sum((w(i, j) * b[j] for j in range(1, 3)), w(i, 0) * b[0]) for i in range(3)]
    usable = weights.where(w(0, 0).isNotNull() & b[0].isNotNull() & b[1].isNotNull() & b[2].isNotNull())
    sums = usable.groupBy(*keys).agg(
        F.count("*").alias("studies"),
        *(F.sum(w(i, j)).alias(f"_s{i}{j}") for i, j in low),
        *(F.sum(t).alias(f"_t{i}") for i, t in enumerate(turned)),
        F.sum(b[0] * turned[0] + b[1] * turned[1] + b[2] * turned[2]).alias("_q"),
    )
    out = sums.withColumns({f"v{i + 1}{j + 1}": c for (i, j), c in _inverse({(i, j): F.col(f"_s{i}{j}") for i, j in low}).items()})
    v = lambda i, j: F.col(f"v{max(i, j) + 1}{min(i, j) + 1}")
    t = [F.col(f"_t{i}") for i in range(3)]
    out = out.withColumns({f"b{i + 1}": v(i, 0) * t[0] + v(i, 1) * t[1] + v(i, 2) * t[2] for i in range(3)})
    out = out.withColumn("q", F.greatest(F.lit(0.0), F.col("_q") - (F.col("b1") * t[0] + F.col("b2") * t[1] + F.col("b3") * t[2]))).withColumn("df", 3 * (F.col("studies") - 1))
    return out.select(*keys, "studies", "b1", "b2", "b3", *(f"v{i + 1}{j + 1}" for i, j in low), "q", "df")


def pooled_rr(pooled: DataFrame, lag_factor: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Pooled relative risks, upper bounds cut at ``cap`` for plotting.

    ``lag_factor`` multiplies log risks once more: 3 sums reduced coefficients over lags
    a second time, 1 does not.
    """
    scaled = pooled.select("type", "class", *((F.col(f"b{k}") * lag_factor).alias(f"b{k}") for k in (1, 2, 3)), *((F.col(f"v{k}{k}") * lag_factor**2).alias(f"v{k}{k}") for k in (1, 2, 3)))
    return truncate(_risks(["type", "class"], scaled).drop("beta", "se"), cap)


def truncate(rows: DataFrame, cap: float) -> DataFrame:
    return rows.withColumns({"ymin_plot": F.col("rrlow"), "ymax_plot": F.least("rrhigh", F.lit(cap)), "high_trunc": F.col("rrhigh") > cap})


def inverse_variance_pool(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Combine relative risks with 95% intervals by inverse variance of their logarithms."""
    se = (F.log("rrhigh") - F.log("rrlow")) / (2 * Z)
    w = rows.where("rrlow < rrhigh").withColumn("w", 1 / (se * se))
    pooled = w.groupBy(*keys).agg((F.sum(F.col("w") * F.log("rr")) / F.sum("w")).alias("m"), F.sqrt(1 / F.sum("w")).alias("s"), F.count("*").alias("n"))
    return pooled.select(*keys, "n", F.exp("m").alias("rr"), F.exp(F.col("m") - Z * F.col("s")).alias("rrlow"), F.exp(F.col("m") + Z * F.col("s")).alias("rrhigh"))


def forest_rows(city_rr: DataFrame, pooled: DataFrame, positions: dict[str, float], cap: float = 4.0) -> DataFrame:
    """City, pooled and combined rows of cases 2-4 with labels and plot positions; rows without a position go."""
    code = F.when(F.col("case") == CASES[1], "Cat2").when(F.col("case") == CASES[2], "Cat3").when(F.col("case") == CASES[3], "Cat4")
    cols = ["row_label", "case", "rr", "rrlow", "rrhigh", "is_pooled", "is_combined"]
    city = city_rr.select(city_label(F.col("city")).alias("row_label"), "case", "rr", "rrlow", "rrhigh", F.lit(False).alias("is_pooled"), F.lit(False).alias("is_combined"))
    pool = pooled.select(F.concat(F.lit("Pooled: "), "type").alias("row_label"), "case", "rr", "rrlow", "rrhigh", F.lit(True).alias("is_pooled"), F.lit(False).alias("is_combined"))
    both = inverse_variance_pool(pooled.where(F.col("case") == CASES[3]), ["case"]).select(F.lit("Combined").alias("row_label"), "case", "rr", "rrlow", "rrhigh", F.lit(True).alias("is_pooled"), F.lit(True).alias("is_combined"))
    rows = city.select(cols).unionByName(pool.select(cols)).unionByName(both.select(cols)).withColumn("cat", code).where("cat is not null")
    place = F.create_map(*(F.lit(x) for pair in positions.items() for x in pair))
    shift = F.when(F.col("cat") == "Cat2", 0.2).when(F.col("cat") == "Cat4", -0.2).otherwise(0.0)
    rows = rows.withColumn("y_center", place[F.col("row_label")]).where("y_center is not null")
    return rows.withColumns({"y_plot": F.col("y_center") + shift, "rr_hi_p": F.least("rrhigh", F.lit(cap)), "trunc": F.col("rrhigh") > cap})


def recoded(column: Column, names: dict[str, str]) -> Column:
    """A column under other names; what has none keeps its own."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(table[column], column)


def outcome_label(kind: str = "type") -> Column:
    """The stored type codes under the names that inputs use."""
    return recoded(F.col(kind), {v: k for k, v in lexicon.OUTCOME_TYPES.items()})


def city_label(city: Column) -> Column:
    """Display name of a city, whatever its case; every spelling of São Paulo is one."""
    known = F.coalesce(F.create_map(*(F.lit(x) for pair in lexicon.CITY_NAMES.items() for x in pair))[F.lower(city)], city)
    return F.when(known.rlike("(?i)paulo"), "São Paulo").otherwise(known)


def short_case(case: Column) -> Column:
    """``Category 2`` as ``Cat2``."""
    return F.regexp_replace(case, "^Category ", "Cat")


def in_order(df: DataFrame, column: str, first: list[str], out: str) -> DataFrame:
    """``out``: place of each label among those that occur, ``first`` ones in their order, then the others by name.

    The labels of a figure are few; they are gathered as one small array.
    """
    labels = df.agg(F.collect_set(column).alias("_labels"))
    named = F.array(*map(F.lit, first))
    levels = F.concat(F.filter(named, lambda x: F.array_contains("_labels", x)), F.array_sort(F.array_except("_labels", named)))
    return df.crossJoin(F.broadcast(labels.select(levels.alias("_levels")))).withColumn(out, F.array_position("_levels", F.col(column)).cast("int")).drop("_levels")  # one row


def supplement_bars(grid: DataFrame) -> DataFrame:
    """Shares of the nine winners by outcome and class, under display names, with the places of bars and fills."""
    rows = winner_long(grid.where("city_num > 0")).where("pct is not null")
    rows = rows.withColumn("outcome", recoded(F.col("type"), lexicon.OUTCOME_LABELS)).withColumn("class", recoded(F.col("class"), lexicon.CLASS_NAMES))
    rows = in_order(rows, "class", list(lexicon.CLASS_NAMES.values()), "class_place")
    outcomes = F.array(*map(F.lit, lexicon.OUTCOME_LABELS.values()))
    return rows.withColumn("fill_place", F.array_position(F.array(*map(F.lit, WINNERS)), F.col("winner")).cast("int")).withColumn("outcome_place", F.array_position(outcomes, F.col("outcome")).cast("int")).drop("type")


def subgroup_table(pooled: DataFrame, kind: str = "Death") -> DataFrame:
    """Pooled rows of one outcome by class, under display names and in the order of figures."""
    rows = pooled.where(F.col("type") == kind).withColumn("class", recoded(F.col("class"), lexicon.CLASS_NAMES))
    return in_order(rows, "class", list(lexicon.CLASS_NAMES.values()), "class_place")
