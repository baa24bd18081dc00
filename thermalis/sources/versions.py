"""Versioned folders: a version is written whole, then one rename points to it.

A reader sees the old version or the new one. A writer that dies leaves only a folder that nothing points to, so
any writer may simply start again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

POINTER = "CURRENT"


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file in place of any older one, by one rename."""
    folder, _, name = path.rpartition("/")
    new, fs = _path(spark, folder, f".{name}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    old = fs.makeQualified(_path(spark, path)[0])
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(old.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), old, how)


def read_small(spark: SparkSession, path: str) -> str:
    at, fs = _path(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def new_version(kind: str = "v") -> str:
    return f"{kind}-{uuid.uuid4().hex}"


def point_to(spark: SparkSession, folder: str, version: str) -> None:
    write_small(spark, f"{folder}/{POINTER}", version)


def current_version(spark: SparkSession, folder: str) -> str:
    return read_small(spark, f"{folder}/{POINTER}")


def versions(spark: SparkSession, folder: str) -> list[str]:
    """All versions written, the unused ones too."""
    path, fs = _path(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()) if fs.exists(path) else []
