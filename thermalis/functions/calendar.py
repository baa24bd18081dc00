"""Months, hemispheres and seasons as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalis.functions import lexicon

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SEASONS = ["Winter", "Spring", "Summer", "Fall"]


def month_number(value: Column) -> Column:
    """From ``YYYY-MM...``, a month's name or three letters (or ``sept``), or a number from 1 to 12; else null."""
    s = F.trim(value.cast("string"))
    low = F.lower(s)
    names = F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS, 1) for n in dict.fromkeys((m, m[:3], *(["sept"] if k == 9 else []))) for x in (n, k)))
    number = s.try_cast("double").cast("int")
    dated = (F.length(s) >= 7) & (F.substring(s, 5, 1) == "-")
    return F.when(dated, F.substring(s, 6, 2).try_cast("int")).otherwise(F.coalesce(names[low], F.when(number.between(1, 12), number)))


def hemisphere(country: Column, continent: Column) -> Column:
    """By country code, else by continent, else north."""
    code = F.upper(F.trim(country))
    south = F.lower(F.trim(F.coalesce(continent, F.lit("")))).isin(*lexicon.SOUTHERN_CONTINENTS)
    return F.when(code.isin(*lexicon.SOUTHERN_COUNTRIES), "south").when(code.isin(*lexicon.NORTHERN_COUNTRIES), "north").when(south, "south").otherwise("north")


def season(month: Column, side: Column) -> Column:
    """Three-month seasons from December on; the southern ones are half a year apart."""
    k = (F.floor(F.pmod(month, F.lit(12)) / 3) + F.when(F.lower(side) == "south", 2).otherwise(0)) % 4
    return F.element_at(F.array(*map(F.lit, SEASONS)), (k + 1).cast("int"))


def with_calendar(df: DataFrame, date: str = "date", side: str = "hemisphere") -> DataFrame:
    """Add year, month_num, month (``yyyy-MM``) and season; a null date is an error."""
    day = F.when(F.col(date).isNull(), F.raise_error(F.lit("a row has no date"))).otherwise(F.col(date)).cast("date")
    out = df.withColumn(date, day)
    return out.withColumns({"year": F.year(date), "month_num": F.month(date), "month": F.date_format(date, "yyyy-MM"), "season": season(F.month(date), F.col(side))})


#: Row numbers in a range of ``with_dates``.
RANGE = 1 << 16


def with_dates(df: DataFrame, city: str = "city", date: str = "date", month: str = "month", start_year: int = 2022, start_month: int = 3) -> DataFrame:
    """Parsed dates if any parses; else the month (and year) with days dealt out in row order.

    Days are 1 + place within city and month, modulo 28. Without a month column months run
    in a cycle from the first. ``date_is_synthetic`` tells which rule held.
    """
    from pyspark.sql import Window

    if date in df.columns:
        parsed = F.try_to_timestamp(F.col(date).cast("string")).cast("date")
        some = df.agg(F.max(parsed.isNotNull())).first()[0]
        if some:
            return df.withColumn(date, parsed).withColumn("date_is_synthetic", F.lit(0))
    if month in df.columns:
        s = F.col(month).cast("string")
        year = F.coalesce(F.when((F.length(s) >= 7) & (F.substring(s, 5, 1) == "-"), F.substring(s, 1, 4).try_cast("int")), F.lit(start_year))
        number = F.coalesce(month_number(F.col(month)), F.lit(start_month))
    else:
        k = F.lit(start_month - 1) + F.pmod(F.col("row_index"), F.lit(12))
        year, number = (F.lit(start_year) + F.floor(k / 12)).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int")
    dated = df.withColumns({"_y": year, "_m": number})
    # a city's month is counted in ranges of rows, so that no window holds more than a range
    keys = [F.col(city).alias("_c"), "_y", "_m", F.floor(F.col("row_index") / RANGE).alias("_r")]
    ranges = dated.groupBy(*keys).agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_c", "_y", "_m").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.struct("_c", "_y", "_m", "_r").alias("_k"), earlier.alias("_before"))
    dated = dated.withColumn("_k", F.struct(*keys)).join(ranges, "_k")  # structs meet nulls
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_k").orderBy("row_index")) - 1
    dated = dated.withColumn("_place", place)
    place = F.col("_place")
    return dated.withColumn(date, F.make_date("_y", "_m", (place % 28 + 1).cast("int"))).withColumn("date_is_synthetic", F.lit(1)).drop("_y", "_m", "_k", "_before", "_place")
