"""The driver's tables as the logical inputs of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalis.functions.calendar import with_calendar

#: Sentences put before a document's beginning, by its id: our own wording, for the lexicon queries.
PHRASES = [
    "I am sweating and dizzy outside",
    "It is not hot at all",
    "so hot",
    "The heat index is a hot topic",
    "We walked in the sun and need AC on",
    "Turn down the radiator it's hot pot night",
    "cooling center opens as a heat warning is issued",
    "my commute was scorching today",
    "Buy now limited offer on ice pack",
    "RT @someone hot take",
    "record heat in the forecast",
    "can't sleep and thirsty",
    "no lexicon words",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: a phrase before the text's beginning, account, continent and month."""
    d = read(spark, sf_dir, "documents").where("doc_id is not null")
    phrase = F.get(F.array(*map(F.lit, PHRASES)), F.pmod("doc_id", F.lit(len(PHRASES))).cast("int"))
    return d.select(
        F.col("doc_id").alias("row_index"),
        F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit(""))).alias("sentence"),
        F.col("text"),
        F.col("source").alias("author_id"),
        F.col("lang").alias("continent"),
        F.date_format(F.add_months(F.lit("2022-03-01").cast("date"), F.pmod("doc_id", F.lit(12)).cast("int")), "yyyy-MM").alias("month"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts: nations are cities, regions continents, urgent orders positive."""
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("city"), F.col("n_name").alias("country"), F.col("r_name").alias("continent"), F.when(F.col("n_nationkey") % 2 == 0, "north").otherwise("south").alias("hemisphere"))
    joined = o.join(c.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), o.o_custkey == c.c_custkey).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = joined.select(
        F.col("o_orderkey").alias("row_index"),
        "city",
        "country",
        "continent",
        "hemisphere",
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("indicator"),
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    return with_calendar(rows)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a nation's orders by day."""
    o, c, n, line = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem"))
    joined = line.join(o, line.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy(F.col("n_name").alias("city"), F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("total_posts"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a prediction that errs on every third document, month and continent as in ``tweets``."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = tweets(spark, sf_dir).select(F.col("row_index").alias("doc_id"), "continent", "month")
    flipped = F.when(F.col("row_index") % 3 == 0, 1 - F.col("label")).otherwise(F.col("label"))
    return docs.join(labels, "doc_id").withColumnRenamed("doc_id", "row_index").withColumn("pred_label", flipped)


def exact_mean(column: str) -> Column:
    """Mean of a double column from a decimal sum, so that groups of equal values have equal means whatever their order.

    A group with a value that decimals do not hold exactly (more than ten places, not finite, from 1e18) has the plain mean.
    """
    value = F.col(column)
    exact = value.try_cast("decimal(28,10)")
    held = F.bool_and(F.coalesce(exact.cast("double") == value, value.isNull()))
    return F.when(held, F.try_sum(exact).cast("double") / F.count(column)).otherwise(F.avg(column))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by city, day and segment as an outcome panel of three types.

    Days with the same prices tie exactly, so no order of summation moves one of them over a quantile.
    """
    p = posts(spark, sf_dir)
    kind = F.when(F.col("continent") < "AM", "Death").when(F.col("continent") < "E", "Hospitlization").otherwise("Emergency department visit")
    days = p.groupBy("city", "date").agg(exact_mean("price").alias("price"), F.avg("indicator").alias("share"), F.avg("balance").alias("balance"), F.min("continent").alias("continent"))
    counts = p.groupBy("city", "date", "segment").agg(F.count("*").alias("count"))
    out = counts.join(days, ["city", "date"])
    return out.select(
        F.col("city").alias("country"),
        "city",
        "date",
        F.col("segment").alias("class"),
        kind.alias("type"),
        (F.col("price") / 1e4).alias("temp"),
        (100 * F.col("share")).alias("heatPerception"),
        (F.col("balance") / 1e3).alias("pm25"),
        (F.dayofmonth("date") == 1).cast("int").alias("holiday"),
        F.month("date").alias("month"),
        F.dayofweek("date").alias("dow"),
        "count",
    )
