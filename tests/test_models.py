"""Fits from sums, closed-form pooling, epoch training, batched inference and saved models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermalis.operators import evaluation as ev
from thermalis.operators import exposure as ex
from thermalis.operators import glm, training
from thermalis.plans import model_queries
from thermalis.sources import models, versions


@pytest.fixture(scope="module")
def panel_basis(spark, sf):
    return model_queries._basis(spark, "/root/testdata/sf0.01", "all").where("city in ('NATION_0', 'NATION_3', 'NATION_7')").cache()


def side_by_side(a, b):
    m = a.toPandas().merge(b.toPandas(), on=ex.SERIES, suffixes=("", "_g"))
    assert len(m) == a.count() == b.count() >= 3
    return m


def test_comparison_equals_the_grouped_fit(panel_basis):
    m = side_by_side(glm.compare_models(panel_basis), ex.compare_models(panel_basis))
    for c in ("qaic_temp", "qaic_perc", "r2_temp", "r2_perc"):
        np.testing.assert_allclose(m[c], m[f"{c}_g"], rtol=1e-6, atol=1e-8)
    for c in ("converged_temp", "n_coef_perc", "rank_temp", "rank_perc"):
        assert (m[c] == m[f"{c}_g"]).all()


def test_joint_effects_equal_the_grouped_fit(panel_basis):
    m = side_by_side(glm.joint_effects(panel_basis), ex.joint_effects(panel_basis))
    for c in ("b1", "b2", "b3", "v11", "v21", "v31", "v22", "v32", "v33"):
        np.testing.assert_allclose(m[c], m[f"{c}_g"], rtol=1e-6, atol=1e-8)


def series(rng, n, **more):
    rows = pd.DataFrame({"country": "c", "city": "x", "type": "t", "class": "k", "date": pd.date_range("2022-01-01", periods=n), "cb_temp": rng.integers(0, 4, n).astype(float), "cb_perc": 1.0, "holiday": 0, "pm25": rng.normal(size=n)})
    rows["dow"], rows["month"] = rows["date"].dt.dayofweek + 1, rows["date"].dt.month
    rows["count"] = rng.poisson(np.exp(1 + 0.2 * rows["cb_temp"]))
    return rows.assign(**more).drop(columns="date")


def test_dependent_columns_nulls_and_runaways(spark):
    rng = np.random.default_rng(1)
    plain, short = series(rng, 400), series(rng, 5, city="short")
    plain.loc[3, "pm25"] = np.nan
    zero = series(rng, 60, city="zero", count=0)
    df = spark.createDataFrame(pd.concat([plain, short, zero])).withColumn("date", F.lit("2022-01-01").cast("date"))
    m = side_by_side(glm.compare_models(df), ex.compare_models(df)).set_index("city")
    assert m.loc["x", "rank_perc"] == m.loc["x", "rank_perc_g"] and m.loc["x", "n_coef_perc"] == m.loc["x", "n_coef_perc_g"]
    for c in ("qaic_temp", "r2_temp", "qaic_perc"):
        assert abs(m.loc["x", c] - m.loc["x", f"{c}_g"]) < 1e-6 * max(1, abs(m.loc["x", c]))
    assert m.loc["short", "rank_temp"] <= 5
    empty = df.where("city = 'none'")
    assert glm.compare_models(empty).collect() == []


def test_sums_do_not_depend_on_tasks(spark):
    df = spark.createDataFrame(series(np.random.default_rng(2), 900)).withColumn("date", F.lit("2022-01-01").cast("date"))
    one, many = (glm.compare_models(df.repartition(n)).first() for n in (1, 7))
    assert abs(one.qaic_temp - many.qaic_temp) < 1e-8


def test_fixed_effects_against_a_solver(spark):
    rng, rows, want = np.random.default_rng(4), [], {}
    for t, k in (("a", 1), ("b", 6)):
        b, s = rng.normal(size=(k, 3)), []
        for _ in range(k):
            r = rng.normal(size=(3, 3))
            s.append(r @ r.T + 0.5 * np.eye(3))
        w = np.linalg.inv(np.array(s))
        cov = np.linalg.inv(w.sum(axis=0))
        mean = cov @ np.einsum("kij,kj->i", w, b)
        q = sum((x - mean) @ v @ (x - mean) for x, v in zip(b, w, strict=True))
        want[t] = (mean, cov, q)
        rows += [(t, "c", *map(float, x), *(float(v[i, j]) for j in range(3) for i in range(j, 3))) for x, v in zip(b, s, strict=True)]
    rows += [("b", "c", None, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0), ("b", "c", 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "type string, class string, b1 double, b2 double, b3 double, v11 double, v21 double, v31 double, v22 double, v32 double, v33 double")
    for r in ex.pool_fixed(df).collect():
        mean, cov, q = want[r.type]
        np.testing.assert_allclose([r.b1, r.b2, r.b3], mean, rtol=1e-9)
        np.testing.assert_allclose([r.v11, r.v21, r.v31, r.v22, r.v32, r.v33], [cov[i, j] for j in range(3) for i in range(j, 3)], rtol=1e-9, atol=1e-12)
        assert abs(r.q - q) < 1e-8 and r.df == 3 * (r.studies - 1)
    assert {r.type: r.studies for r in ex.pool_fixed(df).collect()} == {"a": 1, "b": 6}


WORDS = ["heat", "sun", "sweat", "shade", "don't", "ice"], ["film", "song", "deal", "news", "sauce", "ice"]


def labelled(spark, n=240):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(WORDS[i % 2 if rng.random() > 0.1 else (i + 1) % 2], 8)) + "!", (i + 1) % 2, f"city{i % 12}") for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, 1, "city0"), (n + 1, "", 0, "city1"), (n + 2, "heat", None, "city2")], "row_index long, sentence string, label int, city_id string")


def test_hashing_is_that_of_spark(spark):
    from pyspark.ml.feature import HashingTF

    tf = HashingTF(numFeatures=1 << 14)
    for w in ["", "a", "heat", "can't", "x" * 37, "zażółć", "abc", "abcd", "0"]:
        assert training.murmur3(w.encode()) % (1 << 14) == tf.indexOf(w)


def test_epochs_learn_and_do_not_depend_on_tasks(spark):
    df = labelled(spark)
    trained, held = training.cross_train(df.repartition(1), folds=3)
    assert ev.overall_metrics(held.where("label is not null")).first().f1 > 0.85
    other, _ = training.cross_train(df.repartition(7), folds=3)
    for k, state in trained.states.items():
        assert np.array_equal(state.weights, other.states[k].weights) and np.array_equal(state.bias, other.states[k].bias)
    losses = trained.history.pivot(index="epoch", columns="fold", values="loss")
    assert (losses.iloc[-1] < losses.iloc[0]).all()
    assert held.count() == df.count()


def test_no_row_is_predicted_by_a_model_that_saw_its_group(spark):
    """Changing the labels of one fold must not change that fold's model."""
    df = labelled(spark)
    folds = ev.group_folds(df, "city_id", 3).select("city_id", F.col("fold").alias("fold_id"))
    placed = df.join(folds, "city_id")
    turned = placed.withColumn("label", F.when(F.col("fold_id") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    a, b = (training.train_by_epochs(x, folds=3, epochs=1) for x in (placed, turned))
    assert np.array_equal(a.states[1].weights, b.states[1].weights)
    assert not np.array_equal(a.states[0].weights, b.states[0].weights)


def test_the_best_epoch_is_kept(spark):
    trained, _ = training.cross_train(labelled(spark), folds=3, epochs=6)
    again = {k: training.train_by_epochs(labelled(spark).join(ev.group_folds(labelled(spark), "city_id", 3).select("city_id", F.col("fold").alias("fold_id")), "city_id"), folds=3, epochs=int(n)) for k, n in ((0, _first_best(trained.history, 0)),)}
    assert np.array_equal(again[0].states[0].weights, trained.states[0].weights)


def _first_best(history, fold):
    h = history[(history.fold == fold) & (history.epoch > 0)].reset_index(drop=True)
    return h.epoch[h.f1.idxmax()]


def test_the_final_model_learns_from_all_rows(spark):
    df = labelled(spark)
    state = training.train_final(df, epochs=6)
    seen = training.predict_batched(df.where("label is not null"), {0: state})
    assert ev.overall_metrics(seen).first().f1 > 0.85
    again = training.train_final(df.repartition(5), epochs=6)
    assert np.array_equal(state.weights, again.weights)


def test_one_class_is_an_error(spark):
    with pytest.raises(ValueError, match="two classes"):
        training.train_by_epochs(labelled(spark).withColumn("label", F.lit(1)).withColumn("fold_id", F.col("row_index").cast("int") % 3), folds=3)


def test_batches_equal_the_pipeline_and_survive_a_reload(spark, tmp_path):
    df = labelled(spark).where("label is not null")
    model = ev.fit_baseline(df)
    folder = str(tmp_path / "model")
    first = models.save_model(model, folder, spark)
    loaded = models.load_model(folder, spark=spark)
    texts = df.withColumn("sentence", F.coalesce("sentence", F.lit("")))
    whole = {r.row_index: r for r in ev.predict_baseline(model, texts).collect()}
    for batch in (1, 64):
        for r in training.predict_batched(df, {0: training.State.of_pipeline(loaded)}, batch=batch).collect():
            assert abs(r.pred_prob_1 - whole[r.row_index].pred_prob_1) < 1e-9 and r.pred_label == whole[r.row_index].pred_label
    second = models.save_model(ev.fit_baseline(df.where("row_index > 20")), folder, spark)
    assert versions.current_version(spark, folder) == second and versions.versions(spark, folder) == sorted([first, second])
    old = models.load_model(folder, spark=spark, version=first)
    assert old.stages[3].intercept == model.stages[3].intercept
    with pytest.raises(FileNotFoundError):
        models.load_model(str(tmp_path / "none"), spark=spark)
