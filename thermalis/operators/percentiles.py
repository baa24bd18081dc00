"""Exact percentiles of groups of any size, without gathering a group's values.

A percentile lies between two neighbouring order statistics. For each group and rank wanted a bracket of values that
holds it is narrowed by passes over the rows inside: sketched quantiles give edges, the values between
and at the edges are counted exactly, and the bracket shrinks to the bin with the rank. A pass makes it some sixty times smaller, and
a value that many rows share becomes a bracket of its own. What is shuffled are counts, at most 2 * EDGES + 1 for a task,
group and rank. Only a bracket of at most ``most`` rows is sorted. Groups that small take no pass at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermalis.sources.scratch import saved

EDGES = 63
#: Rows of a bracket that are sorted together.
MOST = 10_000


def _narrowed(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """The brackets in ``open_`` after one pass over the rows inside them.

    Ranks that share a bracket share its bins. Brackets of a group are equal or disjoint, so a row is counted once a pass.
    """
    probabilities = F.array(*(F.lit((k + 1) / (EDGES + 1)) for k in range(EDGES)))
    spans = open_.select("g", "lo", "hi").distinct()
    inside = rows.join(spans, "g").where(F.col("v").between(F.col("lo"), F.col("hi"))).select("g", F.col("lo").alias("of"), "v")
    edges = saved(inside.groupBy("g", "of").agg(F.array_distinct(F.percentile_approx("v", probabilities, 1000)).alias("edges")), "edges")
    # bin 2k lies between edges, bin 2k + 1 is an edge itself
    place = 2 * F.size(F.filter("edges", lambda e: e < F.col("v"))) + F.array_contains("edges", F.col("v")).cast("int")
    bins = inside.join(edges, ["g", "of"]).groupBy("g", "of", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    through = F.sum("n").over(Window.partitionBy("g", "of").orderBy("bin"))
    ranked = bins.withColumn("through", through).join(open_.select("g", "r", F.col("lo").alias("of"), "below"), ["g", "of"])
    before = F.col("below") + F.col("through") - F.col("n")
    held = ranked.where((before <= F.col("r")) & (F.col("r") < F.col("below") + F.col("through")))
    return held.select("g", "r", "lo", "hi", before.alias("below"), F.col("n").alias("inside"))


def exact_percentiles(df: DataFrame, keys: list[str], column: str, quantiles: list[float], most: int = MOST) -> DataFrame:
    """``keys`` and ``q0``, ``q1``, ...: the linearly interpolated quantiles of a column, as Spark's ``percentile`` gives them.

    Null and NaN values do not count; groups without others are missing. Null keys form groups.
    """
    # a struct equals another one with nulls in the same places, so joins meet null keys
    rows = df.select(F.struct(*keys).alias("g"), F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    groups = saved(rows.groupBy("g").agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    wanted = groups.select("g", "inside", F.posexplode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("qi", "q"))
    wanted = wanted.withColumn("pos", F.col("q") * (F.col("inside") - 1)).select("g", "qi", "pos", F.floor("pos").alias("r0"), F.ceil("pos").alias("r1"))
    ranks = wanted.select("g", F.explode(F.array("r0", "r1")).alias("r")).distinct()
    state = saved(ranks.join(groups, "g").select("g", "r", "lo", "hi", F.lit(0).cast("long").alias("below"), "inside"), "brackets")
    wide = (F.col("inside") > most) & (F.col("lo") < F.col("hi"))
    while not state.where(wide).isEmpty():
        state = saved(state.where(~wide).unionByName(_narrowed(rows, state.where(wide))), "brackets")
    spans = state.where("lo < hi").select("g", "lo", "hi").distinct()
    held = rows.join(spans, "g").where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("g", "lo").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    found = held.join(state.where("lo < hi"), ["g", "lo"]).select("g", "r", F.element_at("vs", (F.col("r") - F.col("below") + 1).cast("int")).alias("x"))
    found = saved(found.unionByName(state.where("lo >= hi").select("g", "r", F.col("lo").alias("x"))), "ranks")
    ends = [found.select("g", F.col("r").alias(f"r{k}"), F.col("x").alias(f"x{k}")) for k in (0, 1)]
    both = wanted.join(ends[0], ["g", "r0"]).join(ends[1], ["g", "r1"])
    value = F.when(F.col("x0") == F.col("x1"), F.col("x0")).otherwise((F.col("r1") - F.col("pos")) * F.col("x0") + (F.col("pos") - F.col("r0")) * F.col("x1"))
    cells = both.withColumn("x", value).groupBy("g").agg(*(F.max(F.when(F.col("qi") == i, F.col("x"))).alias(f"q{i}") for i in range(len(quantiles))))
    return cells.select(*(F.col(f"g.{k}").alias(k) for k in keys), *(f"q{i}" for i in range(len(quantiles))))
