"""Tables written to the cluster's shared checkpoint folder to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` on the file system it names (the default one if it names none).

    Where that is unset, as in tests, a folder in the session's warehouse, which all executors share too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


class Scratch:
    """Parquet tables of one run; each can be dropped as soon as nothing reads it.

    The shuffle files of a save are removed as soon as its table is complete.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.saved = 0

    def save(self, df: DataFrame, compression: str = "snappy", **options: str) -> DataFrame:
        path = f"{self.root}/{self.saved}"
        self.saved += 1
        before = self.spark.conf.get(self.CLEAN, "false")
        self.spark.conf.set(self.CLEAN, "true")
        try:
            df.write.options(compression=compression, **options).parquet(path)
        finally:
            self.spark.conf.set(self.CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
