"""Seeded synthetic posts: round-robin cities, season-weighted months, split tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Weight of a month for positive posts, by distance from midsummer, and for others.
SUMMER_WEIGHTS, EVEN = [6, 5, 3, 2, 1, 1, 1], 2


def draw(seed: int, salt: int):
    """A uniform number in [0, 1) that depends on seed, salt and row alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("row_index")), F.lit(1 << 30)) / float(1 << 30)


def synthetic_posts(spark: SparkSession, sentences: list[tuple[str, int, str]], cities: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """``rows`` posts from a bank of (sentence, label, category), dealt over ``cities`` (city_id, country, continent, hemisphere).

    Months of positive posts lean towards the hemisphere's summer, by a cumulative-weight
    lookup; 70% are tagged train. Rows come in order of date.
    """
    bank = F.array(*(F.struct(F.lit(s).alias("sentence"), F.lit(y).alias("label"), F.lit(c).alias("example_category")) for s, y, c in sentences))
    base = spark.range(rows).withColumnRenamed("id", "row_index").withColumn("s", F.get(bank, F.pmod("row_index", F.lit(len(sentences))).cast("int"))).select("row_index", "s.*")
    placed = cities.select(F.row_number().over(Window.orderBy("city_id")).alias("k"), *cities.columns)
    n = cities.count()
    out = base.withColumn("k", F.pmod("row_index", F.lit(n)) + 1).join(F.broadcast(placed), "k").drop("k")
    months = []
    for side in ("north", "south"):
        mid = 7 if side == "north" else 1
        away = [min((m - mid) % 12, (mid - m) % 12) for m in range(1, 13)]
        for y in (0, 1):
            w = [SUMMER_WEIGHTS[a] if y else EVEN for a in away]
            cum = [sum(w[: i + 1]) / sum(w) for i in range(12)]
            months.append(((F.col("hemisphere") == side) & (F.col("label") == y), cum))
    u = draw(seed, 1)
    month = F.lit(None).cast("int")
    for cond, cum in months:
        month = F.when(cond, 1 + sum((F.when(u >= c, 1).otherwise(0) for c in cum[:-1]), F.lit(0))).otherwise(month)
    year = F.when(F.col("m") >= 3, 2022).otherwise(2023)
    out = out.withColumn("m", month).withColumn("date", F.make_date(year, "m", (F.floor(draw(seed, 2) * 28) + 1).cast("int")))
    out = out.withColumn("month", F.date_format("date", "yyyy-MM")).withColumn("original_split", F.when(draw(seed, 3) < 0.7, "train").otherwise("test"))
    return out.withColumn("tweet_id", F.format_string("DEMO_%04d", F.col("row_index") + 1)).withColumn("is_synthetic", F.lit(1)).drop("m").orderBy("date", "row_index")
