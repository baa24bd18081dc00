"""What the reviewer found in round 3."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from __spark_entry__ import queries
from thermalis.operators import exposure as ex
from thermalis.operators import text_pipeline as tp
from thermalis.operators import training
from thermalis.plans import bindings


def test_exposures_compare_the_temperatures_that_gave_the_quantile(spark):
    """F3-F12: temperatures that come out otherwise each time they are worked out."""
    shaken = F.udf(lambda x: x + random.random(), "double").asNondeterministic()
    days = spark.range(400).select(F.lit("Peru").alias("country"), (F.col("id") % 2).cast("string").alias("city"), F.lit(7).alias("month"), F.lit(0.0).alias("heatPerception"), shaken(F.lit(20.0)).alias("temp"))
    got = ex.exposures(days, "all", 0.9).toPandas()
    assert len(got) == 400
    for _, own in got.groupby("city"):
        assert (own["heatday"] == (own["temp"] > np.quantile(own["temp"], 0.9))).all()


def test_days_with_the_same_prices_tie(spark, sf, tmp_path):
    """F4-F11: sums of the same prices in another order differ in their last bit, and one of two equal days was hot."""
    prices = [0.1, 0.2, 0.3]
    assert 0.1 + 0.2 + 0.3 != 0.3 + 0.2 + 0.1
    rows = [(i, 0, p, d, "1-URGENT") for i, (p, d) in enumerate([(p, "1995-01-01") for p in prices] + [(p, "1995-01-02") for p in prices[::-1]])]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string, o_orderpriority string")
    tables = {"orders": orders.withColumn("o_orderdate", F.to_timestamp("o_orderdate")), "customer": spark.createDataFrame([(0, 3, "BUILDING", 1.0)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double")}
    for name in ("orders", "customer", "nation", "region"):
        tables.get(name, bindings.read(spark, sf, name)).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert len({r.temp for r in bindings.panel(spark, str(tmp_path)).collect()}) == 1
    assert [r.cat3 + r.cat4 for r in queries()["joint_exposure_counts"](spark, str(tmp_path)).collect()] == [0]


def test_exact_mean_of_odd_values(spark):
    """F4-F11: what decimals do not hold has the plain mean."""
    inf = float("inf")
    groups = [[0.1, None, 0.3], [None, None], [1e300, 1e300], [inf, 1.0], [1e-13, 3e-13], [float("nan"), 1.0], [-0.25, 0.75]]
    df = spark.createDataFrame([(g, x) for g, xs in enumerate(groups) for x in xs], "g int, x double").coalesce(1)
    got = [r.m for r in df.groupBy("g").agg(bindings.exact_mean("x").alias("m")).orderBy("g").collect()]
    assert got[:5] == [0.2, None, 1e300, inf, 2e-13] and np.isnan(got[5]) and got[6] == 0.25


def test_rule_audit_applies_the_rules_once(spark, sf):
    """F2."""
    plan = queries()["rule_audit"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    assert "Union" not in plan


def test_training_takes_batches_in_bounded_slices(spark):
    """F13, F14, F16, F19: no slice beyond the bound but for single rows, and the same model whatever the batches."""
    batch = pa.RecordBatch.from_pydict({"places": [[1] * 5, [2] * 5, [3] * 20, [], [4]]})
    assert [b.num_rows for b in training.slices(batch, batch.column("places").value_lengths(), 10)] == [2, 1, 2]
    rows = spark.createDataFrame([(f"w{i % 7} w{i % 3} " * (i % 5), i % 2, i % 3) for i in range(90)] + [(None, 1, 0), ("", 0, 1)], "sentence string, label int, fold_id int").coalesce(1)
    got = []
    for most in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        got.append(training.train_by_epochs(rows, folds=3, epochs=2, features=64))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0].history.equals(got[1].history)
    assert all((got[0].states[k].weights == got[1].states[k].weights).all() for k in range(3))


def test_greedy_blocks_and_equal_texts(spark):
    """texts that stand alone in their block are not compared; each row goes to the first representative."""
    rest = " ".join(f"x{i}" for i in range(30))
    texts = [f"a b c d {rest}", f"a b c d {rest}", f"e f g h {rest}", f"a b c d {rest[:-3]}y29", "", None, "", "a b", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_index int, sentence string").repartition(3)
    out = tp.greedy_near_duplicates(df)
    assert {(r.row_index, r.near_duplicate_of) for r in out.collect()} == {(1, 0), (6, 4), (8, 7), (3, 0)}
    assert {(r.row_index, r.near_duplicate_of) for r in tp.greedy_near_duplicates(df, most=1).collect()} == set()


def test_greedy_blocks_are_found_from_keys(spark):
    """no shingles are gathered as strings of a row that nothing is compared with."""
    df = spark.createDataFrame([(0, "a b c"), (1, "d e f")], "row_index long, sentence string")
    plan = tp.greedy_near_duplicates(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
