"""Metrics, folds, audits; models against numpy; pooling; sources and streaming."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalis.operators import evaluation as ev
from thermalis.operators import exposure as ex
from thermalis.sources import generator, tables
from thermalis.streaming.city_day import streaming_city_day


def test_metrics_without_predicted_positives(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 0), ("b", 1, 1)], "month string, label int, pred_label int")
    r = ev.overall_metrics(df).first()
    assert (r.precision, r.recall) == (1.0, 0.5)
    assert [x.month for x in ev.monthly_metrics(df).collect()] == ["a"]
    assert ev.monthly_metrics(df).first().f1 == 0.0
    with pytest.raises(Exception, match="two classes"):
        ev.class_weights(df.where("label = 1")).collect()


def test_group_folds(spark):
    df = spark.createDataFrame([(g,) for g, n in (("a", 9), ("b", 5), ("c", 5), ("d", 1)) for _ in range(n)], "city_id string")
    got = {r.city_id: (r.n, r.fold) for r in ev.group_folds(df, folds=2).collect()}
    assert got == {"a": (9, 0), "b": (5, 1), "c": (5, 1), "d": (1, 0)}
    with pytest.raises(Exception, match="two groups"):
        ev.group_folds(df.where("city_id = 'a'")).collect()


def test_audit_allocation_and_sample(spark):
    counts = {("m", "x"): 7, ("m", "y"): 7, ("m", "z"): 7, ("k", "x"): 3}
    rows = [(i, m, c) for i, (m, c) in enumerate(k for k, n in counts.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "row_index long, month string, continent string")
    alloc = {(r.month, r.stratum): r.n_take for r in ev.audit_allocation(df, per_month=10).collect()}
    assert alloc == {("m", "x"): 4, ("m", "y"): 3, ("m", "z"): 3, ("k", "x"): 3}
    sample = ev.audit_sample(df, per_month=10).collect()
    assert len(sample) == 13 and len({r.row_index for r in sample}) == 13 and sample[0].audit_status == "pending"


def test_quasi_poisson_recovers_coefficients_and_skips_aliases():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(4000), rng.integers(0, 2, 4000), rng.normal(size=4000), np.ones(4000)])
    y = rng.poisson(np.exp(0.5 + 0.7 * x[:, 1] - 0.2 * x[:, 2])).astype(float)
    m = ex.quasi_poisson(x, y, ["i", "a", "b", "copy"])
    assert m["converged"] and (m["n_coef"], m["rank"]) == (4, 3) and "copy" not in m["coef"]
    assert np.allclose([m["coef"][k] for k in "iab"], [0.5, 0.7, -0.2], atol=0.06) and abs(m["phi"] - 1) < 0.1
    mu = np.exp(x[:, :3] @ np.array([m["coef"][k] for k in "iab"]))
    assert np.allclose(x[:, :3].T @ (y - mu), 0, atol=1e-3)
    assert math.isclose(m["qaic"], -2 * m["loglik"] + 8 * m["phi"])


def test_random_effects():
    b = np.array([[1.0, 2, 3], [1.2, 1.8, 3.1], [0.8, 2.2, 2.9]])
    s = np.stack([np.eye(3) * v for v in (0.01, 0.01, 0.01)])
    mean, cov, psi, _ = ex.random_effects(b, s)
    assert np.allclose(mean, b.mean(axis=0), atol=0.05) and np.all(np.linalg.eigvalsh(psi) > -1e-9) and cov.shape == (3, 3)
    one, v, _, _ = ex.random_effects(b[:1], s[:1])
    assert np.allclose(one, b[0]) and np.allclose(v, s[0])


def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for city, country in (("A", "Mexico"), ("B", "Brazil"), ("Benito Juárez", "Mexico")):
        for k in range(400):
            d = np.datetime64("2020-01-01") + k
            month = int(str(d)[5:7])
            t = float(20 + rng.normal() * 5)
            rows.append((country, city, str(d), "all-cause", "Death", t, float(rng.normal() + 0.8), float(rng.random()), int(k % 30 == 0), month, k % 7 + 1, int(rng.poisson(20 * math.exp(0.2 * (t > 28))))))
    df = spark.createDataFrame(rows, "country string, city string, d string, class string, type string, temp double, heatPerception double, pm25 double, holiday int, month int, dow int, count long")
    return df.withColumn("date", F.to_date("d")).drop("d")


def test_exposures_and_models(spark):
    rows = ex.exposures(panel(spark))
    assert {r.city for r in rows.select("city").distinct().collect()} == {"A", "B"}
    assert {(r.country, r.month) for r in rows.where("city = 'A'").select("country", "month").distinct().collect()} == {("Mexico", m) for m in range(5, 10)}
    basis = ex.lag_basis(ex.exposures(panel(spark), "all"))
    first = basis.where("city = 'A'").orderBy("date").limit(3).collect()
    assert first[0].cb_temp is None and first[1].cb_temp is None and first[2].cb_temp is not None
    models = ex.compare_models(basis)
    winners = ex.classify_winners(models).collect()
    assert len(winners) == 2 and all(w.winner in ex.WINNERS for w in winners)
    effects = ex.joint_effects(basis)
    risks = ex.joint_rr(effects).collect()
    assert len(risks) == 8 and all(r.rr == 1 for r in risks if r.case == ex.CASES[0]) and all(r.rrlow <= r.rr <= r.rrhigh for r in risks)
    pooled = ex.pooled_rr(ex.pool_effects(effects)).collect()
    assert len(pooled) == 4
    grid = ex.winner_grid(ex.classify_winners(models))
    assert grid.count() == len(ex.CLASSES)
    assert grid.where("class = 'all-cause'").first().city_num == 2


def test_winner_bounds(spark):
    rows = [("x", "c", "t", "k", 2.0, 0.0, 0.02, 0.0, True, True), ("x", "d", "t", "k", 2.1, 0.0, 0.5, 0.53, True, True), ("x", "e", "t", "k", 2.1, 0.0, float("-inf"), 0.5, True, True), ("x", "f", "t", "k", 0.0, 2.1, 0.53, 0.5, True, False)]
    df = spark.createDataFrame(rows, "country string, city string, type string, class string, qaic_temp double, qaic_perc double, r2_temp double, r2_perc double, converged_temp boolean, converged_perc boolean")
    assert {r.city: r.winner for r in ex.classify_winners(df).collect()} == {"c": "S-S", "d": "P-P"}


def test_csv_round_trip_and_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok\nnext', 1.5), (2, "NA", float("nan"))], "row_index long, sentence string, x double")
    tables.write_csv(df, str(tmp_path / "csv"))
    got = {r.row_index: r for r in tables.read_csv(spark, str(tmp_path / "csv"), "row_index long, sentence string, x double").collect()}
    assert got[1].sentence == 'say "hi", ok\nnext' and got[2].sentence is None and got[2].x is None
    with pytest.raises(ValueError):
        tables.resolve(df, ["absent"])
    paths = tables.write_outputs({"a": df}, str(tmp_path / "out"), df.agg(F.count("*").alias("n")))
    assert spark.read.text(paths["summary"]).first().value == '{"n":2}'
    indexed = tables.with_row_index(spark.range(1000).select((999 - F.col("id")).alias("k")), "k")
    assert all(r.k == r.row_index for r in indexed.collect())


def test_generator(spark):
    cities = spark.createDataFrame([(f"c{i}", "X", "Y", "south" if i % 2 else "north") for i in range(5)], "city_id string, country string, continent string, hemisphere string")
    bank = [("hot", 1, "p"), ("cold", 0, "n"), ("warm", 1, "p")]
    a = generator.synthetic_posts(spark, bank, cities, 600, 7).collect()
    assert a == generator.synthetic_posts(spark, bank, cities, 600, 7).collect()
    assert len(a) == 600 and len({r.tweet_id for r in a}) == 600 and {r.original_split for r in a} == {"train", "test"}
    summer = [r.month[5:] in ("06", "07", "08") for r in a if r.label == 1 and r.hemisphere == "north"]
    assert np.mean(summer) > 0.3


def test_streaming_city_day(spark, tmp_path):
    events = spark.createDataFrame([("a", "2024-01-01 01:00:00", 1), ("a", "2024-01-01 09:00:00", 0), ("a", "2024-01-05 00:00:00", 1)], "city string, t string, indicator int").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming_city_day(stream).writeStream.outputMode("append").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.city, str(r.date), r.heat_posts, r.observed_posts) for r in spark.table("days").collect()] == [("a", "2024-01-01", 1, 2)]


def test_labels_and_their_order(spark):
    df = spark.createDataFrame([("MEXICO CITY", "zz"), ("Sao Paulo", "male"), ("são paulo", "A"), ("Lima", "all-cause"), ("Lima", "B")], "city string, class string")
    out = ex.in_order(df.withColumn("class", ex.recoded(F.col("class"), {"male": "Male", "all-cause": "All-cause"})), "class", ["All-cause", "Female", "Male"], "place")
    assert {r["class"]: r.place for r in out.collect()} == {"All-cause": 1, "Male": 2, "A": 3, "B": 4, "zz": 5}
    assert {r.c for r in df.select(ex.city_label(F.col("city")).alias("c")).collect()} == {"Mexico City", "São Paulo", "Lima"}
    assert df.select(ex.short_case(F.lit("Category 3")).alias("c")).first().c == "Cat3"
    kinds = spark.createDataFrame([("Hospitlization",), ("other",)], "type string").select(ex.outcome_label().alias("o"))
    assert [r.o for r in kinds.collect()] == ["Hospitalization", "other"]


def test_subgroup_table(spark):
    df = spark.createDataFrame([("Death", "male", 1.0), ("Death", "B", 2.0), ("Hospitlization", "male", 3.0)], "type string, class string, rr double")
    assert sorted((r["class"], r.class_place) for r in ex.subgroup_table(df).collect()) == [("B", 2), ("Male", 1)]


def test_row_index_and_dates_in_ranges(spark, monkeypatch):
    from thermalis.functions import calendar

    monkeypatch.setattr(calendar, "RANGE", 3)
    df = tables.with_row_index(spark.range(40).selectExpr("39 - id as k", "if(id % 3 = 0, null, 'c') as city", "'2022-05' as month"), "k")
    assert [(r.k, r.row_index) for r in df.orderBy("k").collect()] == [(k, k) for k in range(40)]
    got = {(r.city, r.row_index): r.date.day for r in calendar.with_dates(df).collect()}
    for city in (None, "c"):
        own = sorted(k for c, k in got if c == city)
        assert [got[city, k] for k in own] == [i % 28 + 1 for i in range(len(own))]
