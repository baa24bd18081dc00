"""Exact percentiles by narrowing brackets against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalis.operators.percentiles import exact_percentiles

Q = [0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0]


def rows():
    rng = np.random.default_rng(6)
    out = [("wide", 1, float(v)) for v in rng.normal(0, 1, 3000) * 10.0 ** rng.integers(-200, 200, 3000)]
    out += [("ties", 1, float(v)) for v in rng.integers(0, 3, 3000)]
    out += [("constant", 1, 5.0)] * 500 + [("one", 1, -3.5)] + [("two", 1, 1.0), ("two", 1, 2.0)]
    out += [(None, 1, float(v)) for v in range(400)] + [(None, None, float(v)) for v in rng.random(300)]
    out += [("wide", 1, None), ("wide", 1, float("nan")), ("none", 1, None), ("none", 1, float("nan"))]
    out += [("edges", 1, v) for v in [float("inf"), float("-inf"), 0.0, -0.0] * 40]
    return out


@pytest.mark.parametrize("most", [10, 200, 10_000])
def test_against_numpy(spark, most):
    data = rows()
    df = spark.createDataFrame(data, "a string, b int, x double").repartition(5)
    got = {(r.a, r.b): [r[f"q{i}"] for i in range(len(Q))] for r in exact_percentiles(df, ["a", "b"], "x", Q, most).collect()}
    groups = {}
    for a, b, x in data:
        if x is not None and not np.isnan(x):
            groups.setdefault((a, b), []).append(x)
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        if k[0] != "edges":
            np.testing.assert_allclose(got[k], np.quantile(v, Q), rtol=1e-12, atol=1e-300)
    assert got["edges", 1][0] == float("-inf") and got["edges", 1][3] == 0.0 and got["edges", 1][-1] == float("inf")
    spark_own = {(r.a, r.b): list(r.q) for r in df.where("x is not null and not isnan(x)").groupBy("a", "b").agg(F.percentile("x", F.array(*map(F.lit, Q))).alias("q")).where("a is not null").collect()}
    for k, v in spark_own.items():
        np.testing.assert_allclose(got[k], v, rtol=1e-14)


def test_empty(spark):
    df = spark.createDataFrame([], "a string, x double")
    assert exact_percentiles(df, ["a"], "x", [0.5]).collect() == []
