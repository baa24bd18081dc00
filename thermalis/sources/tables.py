"""Readers and writers: delimited text with one schema, parquet, and several outputs of one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

from thermalis.sources.scratch import saved

#: Tokens that count as missing in delimited text.
MISSING = ["", "#N/A", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null", "None"]


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A CSV file with header; quotes are doubled inside quotes, fields may span lines."""
    raw = spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE").csv(path)
    return no_missing_tokens(raw)


def no_missing_tokens(df: DataFrame) -> DataFrame:
    """Missing tokens and NaN become null, so that later averages and comparisons skip them."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType):
            c = F.when(~F.trim(c).isin(MISSING), c)
        elif isinstance(f.dataType, DoubleType | FloatType):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def resolve(df: DataFrame, required: list[str] = (), defaults: dict | None = None) -> DataFrame:
    """Check required columns and add missing ones with a default."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: F.lit(v) for c, v in (defaults or {}).items() if c not in df.columns})


def with_row_index(df: DataFrame, *keys: str) -> DataFrame:
    """A stable ``row_index`` from the order of ``keys``: ranks inside ranges plus the ranges' offsets.

    The ordered rows are written once, so a lost executor cannot renumber ties. Only one count for each range reaches the driver.
    """
    ranged = saved(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offset, start = [], 0
    for p, n in sizes:
        offset += [F.lit(p), F.lit(start)]
        start += n
    base = F.create_map(*offset)[part] if offset else F.lit(0)
    return ranged.withColumn("row_index", (base + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at")


def write_csv(df: DataFrame, path: str) -> None:
    flat = df.select(*(F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else c for c in df.columns))
    flat.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_outputs(tables: dict[str, DataFrame], folder: str, summary: DataFrame | None = None, kind: str = "parquet") -> dict[str, str]:
    """Write every table below ``folder`` and the one-row summary as JSON; the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        write_csv(df, paths[name]) if kind == "csv" else df.write.mode("overwrite").parquet(paths[name])
    if summary is not None:
        paths["summary"] = f"{folder}/summary"
        summary.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(paths["summary"])
    return paths


def stage_summary(df: DataFrame, flag: str, reason: str, top: int = 10) -> DataFrame:
    """One row: rows, rows flagged, and the ``top`` most frequent reasons."""
    counts = df.groupBy(F.coalesce(F.col(reason).cast("string"), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("int")).alias("flagged"))
    listed = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "reason"))), 1, top)
    return counts.agg(F.sum("n").alias("rows"), F.sum("flagged").alias("flagged"), F.transform(listed, lambda x: F.struct(x["reason"].alias("reason"), (-x["minus"]).alias("n"))).alias("top_reasons"))
