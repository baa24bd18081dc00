"""An index run as a set of tables: the posts are read once, and all tables appear together or not at all.

The city-day stage is the only one that reads posts; it is written first, and every table is made from what was written.
The manifest follows when all tables are there, and a rename points to the run.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thermalis.operators import city_index as ix
from thermalis.sources.versions import current_version, new_version, point_to, read_small, write_small

MANIFEST = "_MANIFEST.json"
#: File names of the tables (fixed values).
NAMES = {
    "city_day": "city_day_indices",
    "city_month": "city_month_indices",
    "city_season": "city_season_indices",
    "city_typology": "city_typology_summary",
    "polarization": "continent_season_hppi",
    "volume_strata": "tweet_volume_strata",
    "city_eligibility": "eligibility_summary",
}


def run_summary(tables: dict[str, DataFrame], paths: dict[str, str], cfg: ix.IndexConfig, normalised: bool, indicator: str) -> DataFrame:
    """One row on what a run holds and rests on: counts, shares of stand-ins, breaks, settings and paths."""
    days, seasons = tables["city_day"], tables["city_season"]
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)) if c in days.columns else F.lit(0.0)
    counts = days.agg(
        F.count("*").alias("n_city_days"),
        F.count_distinct("city").alias("n_cities"),
        F.count_distinct("continent").alias("n_continents"),
        share("denominator_is_proxy").alias("denominator_proxy_fraction"),
        share("date_is_synthetic").alias("synthetic_date_fraction"),
        share("hemisphere_is_inferred").alias("hemisphere_inferred_fraction"),
    )
    one = counts.crossJoin(F.broadcast(tables["city_month"].agg(F.count("*").alias("n_city_months"))))  # one row each
    one = one.crossJoin(F.broadcast(seasons.agg(F.count("*").alias("n_city_seasons"))))
    one = one.crossJoin(F.broadcast(ix.breaks_table(seasons, "seasonal_hpii_percent", cfg.classes).withColumnRenamed("breaks", "hpii_jenks_breaks_percent")))
    settings = {
        "used_indicator_col": indicator,
        "normalization_applied": normalised,
        "hpii_units": "share, with percent columns beside it",
        "high_hpii_min_level": cfg.high_min_level,
        "hpvi_units": "ratio, with percent columns beside it",
        "hpvi_epsilon": cfg.epsilon,
        "hppi_alpha": cfg.alpha,
        "eligibility_filters_applied": cfg.apply_eligibility_filters,
    }
    bounds = lambda low, high: F.struct(F.lit(low).alias("low_max"), F.lit(high).alias("moderate_max"))
    return one.select(
        "n_city_days",
        "n_city_months",
        "n_city_seasons",
        *(c for c in counts.columns[1:]),
        "hpii_jenks_breaks_percent",
        *(F.lit(v).alias(k) for k, v in settings.items()),
        bounds(0.1, 0.3).alias("hpvi_thresholds_ratio"),
        bounds(10.0, 30.0).alias("hpvi_thresholds_percent"),
        F.create_map(*(F.lit(x) for pair in paths.items() for x in pair)).alias("artifacts"),
    )


def write_index_run(posts: DataFrame, folder: str, totals: DataFrame | None = None, total_col: str | None = None, cfg: ix.IndexConfig = ix.IndexConfig(), normalise: bool = False, indicator: str = "pred_label") -> str:
    """Write all tables of a run and its summary below ``folder``; the run's name. A run that failed may simply be started again."""
    spark, run = posts.sparkSession, new_version("run")
    at = f"{folder}/{run}"
    raw = ix.city_day(posts, totals, total_col, cfg)
    raw.write.parquet(f"{at}/stage")
    tables, written = ix.index_tables(spark.read.schema(raw.schema).parquet(f"{at}/stage"), cfg, normalise), {}
    paths = {name: f"{at}/{NAMES[name]}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(paths[name])
        written[name] = spark.read.schema(df.schema).parquet(paths[name])
    summary = run_summary(written, {NAMES[n]: p for n, p in paths.items()}, cfg, normalise, indicator).toJSON().first()
    write_small(spark, f"{at}/aggregate_summary.json", summary)
    manifest = {"run": run, "tables": {name: {"path": NAMES[name], "schema": df.schema.jsonValue()} for name, df in written.items()}, "summary": "aggregate_summary.json"}
    write_small(spark, f"{at}/{MANIFEST}", json.dumps(manifest))
    point_to(spark, folder, run)
    return run


def read_index_run(spark: SparkSession, folder: str, run: str | None = None) -> tuple[dict[str, DataFrame], dict]:
    """The tables and the summary of the latest complete run, or of a given one."""
    at = f"{folder}/{run or current_version(spark, folder)}"
    manifest = json.loads(read_small(spark, f"{at}/{MANIFEST}"))
    tables = {name: spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{at}/{t['path']}") for name, t in manifest["tables"].items()}
    return tables, json.loads(read_small(spark, f"{at}/{manifest['summary']}"))
