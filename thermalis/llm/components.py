"""Connected components of a table of links, by alternating large and small stars.

Each round hooks every node's larger neighbours to its least one (large star) and its
smaller neighbours to their least (small star) until all links point at the least node
of their component; the number of rounds grows with the logarithm of the longest path.
Links are aggregated before each shuffle, and every round's links are written to the
shared scratch folder, so lineage stays short. Nothing but two numbers of a round
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalis.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the least node reachable.

    Nulls and links of a node with itself are ignored.
    """
    ends = links.where(F.col(a) != F.col(b))
    now = scratch.save(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.union(low).distinct())
        scratch.drop(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state
