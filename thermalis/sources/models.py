"""Fitted models on the shared folder: each save is a new version, and a pointer names the one in use."""

from __future__ import annotations

from pyspark.sql import SparkSession

from thermalis.sources.versions import current_version, new_version, point_to


def save_model(model, folder: str, spark: SparkSession | None = None) -> str:
    """Write ``model`` (anything with Spark's ``write()``) as a new version of ``folder`` and point to it; the version."""
    spark, version = spark or SparkSession.active(), new_version()
    model.write().save(f"{folder}/{version}")
    point_to(spark, folder, version)
    return version


def load_model(folder: str, kind=None, spark: SparkSession | None = None, version: str | None = None):
    """The model in use, or a given version; ``kind`` is its class (a fitted pipeline by default)."""
    from pyspark.ml import PipelineModel

    spark = spark or SparkSession.active()
    return (kind or PipelineModel).load(f"{folder}/{version or current_version(spark, folder)}")
