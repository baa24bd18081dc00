"""Quasi-Poisson fits of all series at once, from sums: no series has to fit a worker.

Each round of reweighted least squares is one pass over the rows. A task adds up, for every series it meets, the outer
products of its design rows, weighted by the current means, and the sums of deviance, Pearson statistic and log-likelihood;
these partial sums (some hundred numbers a series) are shuffled, and a small system is solved for each series. Rows never move:
the coefficients come to them, joined by series. A series leaves the loop as soon as its deviance has settled.

The design is that of the grouped fit (``exposure.design``): intercept, terms, indicators of weekday and month without the first level
that occurs, holiday and pm25; rows with a null in any of them go, and columns that depend on earlier ones get no coefficient but
count in ``n_coef``. Dependence is judged on the sums themselves, so a column counts as dependent below about 1e-5 of its length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalis.operators.exposure import SERIES
from thermalis.sources.scratch import saved

DOW, MONTHS = 7, 12
#: Series whose partial sums a task holds before it hands them on.
HELD = 2048
_KEYS = [*SERIES, "model"]
_KEY_KIND = ", ".join(f"{k} string" for k in _KEYS)
#: What is summed beside the outer products, in this order.
_SUMS = ["n", "y", "y_log_y", "lgamma", "deviance", "pearson", "loglik"]
#: What a series' rows carry from the round before.
_CARRIED = ["coef", "used", "n_coef", "deviance", "turn"]
_PART = f"{_KEY_KIND}, part array<double>, coef array<double>, used array<boolean>, n_coef long, deviance double, turn int"
_STATE = f"{_KEY_KIND}, coef array<double>, used array<boolean>, n_coef long, deviance double, converged boolean, final boolean, gram array<double>, sums array<double>"


def design_rows(basis: DataFrame, models: dict[str, list[str]]) -> DataFrame:
    """Keys, model, x and y of every usable row under each model; all models have equally many terms. Series keys are not null."""
    names = ["dow", "holiday", "month", "pm25", "count"]
    one = lambda c: F.col(c).cast("double")
    levels = [(F.col("dow") == k).cast("double") for k in range(1, DOW + 1)] + [(F.col("month") == k).cast("double") for k in range(1, MONTHS + 1)]
    cells = [
        F.when(
            F.least(*((F.col(c).isNotNull() & ~F.isnan(one(c))).cast("int") for c in (*names, *terms))) == 1,
            F.struct(F.lit(model).alias("model"), F.array(F.lit(1.0), *map(one, terms), *levels, one("holiday"), one("pm25")).alias("x"), one("count").alias("y")),
        )
        for model, terms in models.items()
    ]
    return basis.select(*SERIES, F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select(*SERIES, "c.*")


def _partial(x: np.ndarray, y: np.ndarray, coef: np.ndarray | None) -> np.ndarray:
    """Weighted outer products, weighted working response, and the sums, of one series' rows."""
    log_y = np.log(np.maximum(y, 1e-300))
    if coef is None:
        mu = y + 0.1
        eta = np.log(mu)
    else:
        eta = np.clip(x @ coef, -700, 700)
        mu = np.exp(eta)
    z = eta + (y - mu) / mu
    weighted = x * mu[:, None]
    y_log_y = np.where(y > 0, y * log_y, 0)
    sums = [len(y), y.sum(), y_log_y.sum(), sum(map(math.lgamma, y + 1)), 2 * np.sum(np.where(y > 0, y * (log_y - eta), 0) - (y - mu)), np.sum((y - mu) ** 2 / mu), np.sum(y * eta - mu)]
    return np.concatenate([(weighted.T @ x).ravel(), weighted.T @ z, sums])


def _independent(gram: np.ndarray, terms: int) -> tuple[np.ndarray, int]:
    """(columns with a coefficient, number of columns that the design has) from the sums of outer products."""
    present, first = np.diag(gram) > 0, 1 + terms
    offered = np.ones(len(gram), bool)
    for start, size in ((first, DOW), (first + DOW, MONTHS)):
        at = np.flatnonzero(present[start : start + size])
        offered[start : start + size] = False
        offered[start + at[1:]] = True
    used, kept = np.zeros(len(gram), bool), []
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    even = gram * scale[:, None] * scale[None, :]
    for k in np.flatnonzero(offered):
        rest = even[k, k] * present[k]
        if kept and present[k]:
            rest -= even[k, kept] @ np.linalg.solve(even[np.ix_(kept, kept)], even[kept, k])
        if rest > 1e-10:
            kept.append(k)
    used[kept] = True
    return used, int(offered.sum())


def _solved(gram: np.ndarray, right: np.ndarray, used: np.ndarray) -> np.ndarray:
    at, out = np.flatnonzero(used), np.zeros(len(gram))
    scale = 1 / np.sqrt(np.maximum(np.diag(gram)[at], 1e-300))
    inner = gram[np.ix_(at, at)] * scale[:, None] * scale[None, :]
    out[at] = np.linalg.lstsq(inner, right[at] * scale, rcond=None)[0] * scale
    return out


def fit(rows: DataFrame, terms: int, rounds: int = 25, tolerance: float = 1e-8) -> DataFrame:
    """Per series and model: coefficients, which columns have one, the last sums, and whether the deviance settled."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    width = 1 + terms + DOW + MONTHS + 2
    arrow, state_arrow = to_arrow_schema(StructType.fromDDL(_PART)), to_arrow_schema(StructType.fromDDL(_STATE))

    def gather(batches):
        held: dict[tuple, list] = {}

        def given():
            columns = [pa.array(c, pa.string()) for c in zip(*held, strict=True)]
            columns += [pa.array([h[0] for h in held.values()], pa.list_(pa.float64()))]
            columns += [pa.array([h[1][c] for h in held.values()], kind) for c, kind in zip(_CARRIED, arrow.types[-len(_CARRIED) :], strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            keys = batch.select(_KEYS).to_pandas()
            for key, at in keys.groupby(_KEYS, sort=False).indices.items():
                state = {c: batch.column(c)[int(at[0])].as_py() for c in _CARRIED}
                part = _partial(x[at], y[at], None if state["coef"] is None else np.array(state["coef"]))
                if key in held:
                    held[key][0] += part
                else:
                    held[key] = [part, state]
            if len(held) > HELD:
                yield given()
        if held:
            yield given()

    def settled(key: tuple, total: np.ndarray, before: dict) -> dict:
        """A round's end for one series: done, or the next coefficients."""
        gram, right, sums = total[: width * width].reshape(width, width), total[width * width : width * width + width], total[width * width + width :]
        out = dict(zip(_KEYS, key, strict=True)) | {"gram": gram.ravel(), "sums": sums, "converged": False, "final": False}
        if not np.isfinite(total).all():  # it runs away: no fit
            none = {"coef": np.zeros(width), "used": np.zeros(width, bool)} if before["coef"] is None else {}
            return out | {c: before[c] for c in ("coef", "used", "n_coef")} | none | {"deviance": math.nan, "final": True}
        if before["coef"] is None:
            used, n_coef = _independent(gram, terms)
            return out | {"used": used, "n_coef": n_coef, "deviance": math.inf, "coef": _solved(gram, right, used)}
        deviance = float(sums[_SUMS.index("deviance")])
        out["converged"] = bool(abs(deviance - before["deviance"]) / (abs(deviance) + 0.1) < tolerance)
        out["final"] = out["converged"] or before["turn"] == rounds
        coef = before["coef"] if out["final"] else _solved(gram, right, np.array(before["used"]))
        return out | {"used": before["used"], "n_coef": before["n_coef"], "deviance": deviance, "coef": coef}

    def solve(batches):
        """Partial sums come sorted by series; one series is held at a time."""
        key = total = before = None
        for batch in batches:
            done = []
            carried = {c: batch.column(c).to_pylist() for c in _CARRIED}
            for i, now in enumerate(zip(*(batch.column(k).to_pylist() for k in _KEYS), strict=True)):
                part = batch.column("part")[i].values.to_numpy()
                if now == key:
                    total = total + part
                    continue
                if key is not None:
                    done.append(settled(key, total, before))
                key, total, before = now, part, {c: v[i] for c, v in carried.items()}
            yield pa.RecordBatch.from_pylist(done, schema=state_arrow)
        if key is not None:
            yield pa.RecordBatch.from_pylist([settled(key, total, before)], schema=state_arrow)

    rows = saved(rows, "glm-rows")
    known = rows.withColumns({"coef": F.lit(None).cast("array<double>"), "used": F.lit(None).cast("array<boolean>"), "n_coef": F.lit(0).cast("long"), "deviance": F.lit(0.0), "turn": F.lit(0)})
    done = []
    for turn in range(1, rounds + 2):
        parts = known.mapInArrow(gather, _PART).repartition(*_KEYS).sortWithinPartitions(*_KEYS)
        state = saved(parts.mapInArrow(solve, _STATE), "glm-state")
        done.append(state.where("final"))
        open_ = state.where("not final").select(*_KEYS, "coef", "used", "n_coef", "deviance", F.lit(turn).alias("turn"))
        if open_.isEmpty():
            break
        known = rows.join(open_, _KEYS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def metrics(fits: DataFrame) -> DataFrame:
    """Keys with qaic, r2, converged, n_coef and rank as the grouped fit states them."""
    s = {name: F.element_at("sums", k + 1) for k, name in enumerate(_SUMS)}
    rank = F.size(F.filter("used", lambda u: u)).cast("long")
    free = s["n"] - rank
    phi = F.when(free > 0, s["pearson"] / free).otherwise(F.lit(float("nan")))
    null = 2 * (s["y_log_y"] - s["y"] * F.log(s["y"] / s["n"]))
    return fits.select(
        *_KEYS,
        (-2 * (s["loglik"] - s["lgamma"]) + 2 * F.col("n_coef") * phi).alias("qaic"),
        F.when(null > 0, 1 - F.col("deviance") / null).otherwise(F.lit(float("-inf"))).alias("r2"),
        "converged",
        "n_coef",
        rank.alias("rank"),
    )


def compare_models(basis: DataFrame) -> DataFrame:
    """As ``exposure.compare_models``: the temperature and the perception model of every series, side by side."""
    m = metrics(fit(design_rows(basis, {"temp": ["cb_temp"], "perc": ["cb_perc"]}), 1))
    names = ("qaic", "r2", "converged", "n_coef", "rank")
    side = lambda k: m.where(F.col("model") == k).select(*SERIES, *(F.col(c).alias(f"{c}_{k}") for c in names))
    return side("temp").join(side("perc"), SERIES, "full_outer")


def joint_effects(basis: DataFrame, lags: int = 2) -> DataFrame:
    """As ``exposure.joint_effects``: reduced coefficients of the joint levels and their covariance."""
    terms, factor = ["cb2", "cb3", "cb4"], float(lags + 1)
    fits = fit(design_rows(basis, {"joint": terms}), len(terms))
    names = ["b1", "b2", "b3", "v11", "v21", "v31", "v22", "v32", "v33"]

    def reduce(batches):
        for pdf in batches:
            out = []
            for used, gram, sums, coef in zip(pdf["used"], pdf["gram"], pdf["sums"], pdf["coef"], strict=True):
                used = np.asarray(used, bool)
                free = sums[0] - used.sum()
                if not used[1:4].all() or free <= 0:
                    out.append([None] * len(names))
                    continue
                at = np.flatnonzero(used)
                square = np.asarray(gram).reshape(len(used), -1)[np.ix_(at, at)]
                scale = 1 / np.sqrt(np.diag(square))
                cov = np.linalg.pinv(square * scale[:, None] * scale[None, :]) * scale[:, None] * scale[None, :] * (sums[_SUMS.index("pearson")] / free)
                v = cov[1:4, 1:4] * factor**2  # the intercept, always there, stands first
                out.append([*(np.asarray(coef)[1:4] * factor), *(v[i, j] for j in range(3) for i in range(j, 3))])
            yield pd.concat([pdf[SERIES].reset_index(drop=True), pd.DataFrame(out, columns=names, dtype=float)], axis=1)

    kinds = ", ".join([*(f"{k} string" for k in SERIES), *(f"{n} double" for n in names)])
    return fits.select(*SERIES, "used", "gram", "sums", "coef").mapInPandas(reduce, kinds).where("b1 is not null and not isnan(b1)")
