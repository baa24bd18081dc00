"""Runs written whole: tables, summary, manifest; what a broken run leaves."""

import pytest
from pyspark.sql import functions as F

from thermalis.operators import city_index as ix
from thermalis.plans import bindings as b
from thermalis.sources import runs, versions

CFG = ix.IndexConfig(apply_eligibility_filters=False)


def test_a_run_holds_what_the_operators_give(spark, sf, tmp_path):
    folder, posts = str(tmp_path / "runs"), b.posts(spark, sf)
    name = runs.write_index_run(posts, folder, cfg=CFG)
    tables, summary = runs.read_index_run(spark, folder)
    lazy, _ = ix.index_run(posts, cfg=CFG)
    assert tables.keys() == lazy.keys()
    for key, t in tables.items():
        assert t.columns == lazy[key].columns and t.count() == lazy[key].count()
        assert all(f"/{name}/" in f for f in t.inputFiles())
    assert summary["n_city_days"] == tables["city_day"].count() and summary["denominator_proxy_fraction"] == 1.0
    assert summary["hpvi_thresholds_percent"] == {"low_max": 10.0, "moderate_max": 30.0}
    assert len(summary["artifacts"]) == 7 and len(summary["hpii_jenks_breaks_percent"]) == 8


def test_posts_are_read_once(spark, sf, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    posts = b.posts(spark, sf)
    runs.write_index_run(posts.mapInArrow(count, posts.schema), str(tmp_path / "runs"), cfg=CFG)
    assert seen.value == posts.count()


def test_a_failed_run_changes_nothing_and_can_be_started_again(spark, sf, tmp_path):
    folder, posts = str(tmp_path / "runs"), b.posts(spark, sf)
    first = runs.write_index_run(posts, folder, cfg=CFG)
    broken = posts.withColumn("date", F.when(F.col("row_index") > 0, F.raise_error(F.lit("lost"))).otherwise(F.col("date")))
    with pytest.raises(Exception, match="lost"):
        runs.write_index_run(broken, folder, cfg=CFG)
    assert versions.current_version(spark, folder) == first
    runs.read_index_run(spark, folder)
    second = runs.write_index_run(posts.where("city <> 'NATION_0'"), folder, cfg=CFG)
    assert versions.current_version(spark, folder) == second != first
    assert runs.read_index_run(spark, folder)[1]["n_cities"] == runs.read_index_run(spark, folder, first)[1]["n_cities"] - 1


def test_an_empty_run(spark, sf, tmp_path):
    runs.write_index_run(b.posts(spark, sf).limit(0), str(tmp_path / "runs"), cfg=CFG)
    tables, summary = runs.read_index_run(spark, str(tmp_path / "runs"))
    assert summary["n_city_days"] == 0 and all(t.count() == 0 for t in tables.values())
