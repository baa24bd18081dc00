"""A Merkle manifest of a dataset, with an inclusion proof for each row.

Rows are leaves. The leaves of a group (a source, a shard) stand in ascending order; while
several nodes remain, every ``FANOUT`` consecutive ones (the last run: fewer, even one)
become the digest of their hexadecimal texts, concatenated. What remains is the group's
subroot; the subroots, in the order of their groups, become the root in the same way.

Superblocks: nodes are numbered in their tree, and node numbers divided by FANOUT ** k
name buckets, so a bucket is closed under k levels of parents. One pass collapses k
levels of every bucket; the bucket roots are the nodes of the next pass, so the passes are
the tree's height over k, each on a table FANOUT ** k times smaller. On the way back each
bucket meets the one proof of its own root and puts it behind the proofs inside the
bucket. A group of rows handed to a task holds at most FANOUT ** k nodes, whatever
the size of a source.

Numbers come from a range partitioning: a partition's rows are numbered where they lie,
and what is exchanged are counts for each partition and group.

Null groups are a group of their own and come first; group keys that are equal as strings are one. Within a group rows ascend by the order
column (nulls first), then by leaf; rows alike in these have equal leaves, so which of them comes first
decides only which of them has which proof. Null fields count as ``-``, empty texts as ``0:``; very long texts
are hashed whole, once, before the first exchange. An empty table gives an empty
manifest. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermalis.llm.scratch import Scratch

FANOUT = 3
#: Levels that one pass collapses; a bucket holds at most FANOUT ** SUPERBLOCK nodes.
SUPERBLOCK = 6


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def height(n: int) -> int:
    """Levels between ``n`` nodes and one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _runs(nodes: list[str]) -> list[list[str]]:
    return [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]


def _parents(nodes: list[str]) -> list[str]:
    return [hashlib.sha256("".join(run).encode()).hexdigest() for run in _runs(nodes)]


def _numbered(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """``leaves`` (tree, place, digest, row, further columns) with ``idx`` in their tree and its size ``n``."""
    ordered = leaves.repartitionByRange("tree", "place", "digest", "row").sortWithinPartitions("tree", "place", "digest", "row")
    lain = scratch.save(ordered.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    blocks = lain.groupBy("tree", part).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = scratch.save(blocks.select("tree", "part", "first", before.alias("before"), F.sum("rows").over(tree).alias("n")))
    found = lain.withColumn("part", part).join(blocks, ["tree", "part"])
    return found.withColumn("idx", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before", "place", "row")


def _bucket(k: int) -> Column:
    return F.floor(F.col("idx") / F.lit(FANOUT**k)).cast("long").alias("bucket")


def _collapse(nodes: DataFrame, k: int) -> DataFrame:
    """The roots of all buckets, as nodes ``k`` levels up (fewer where the tree ends)."""

    def up(key, rows):
        import pandas as pd

        rows = rows.sort_values("idx")
        n = int(rows["n"].iloc[0])
        levels, found = min(k, height(n)), [bytes(d).hex() for d in rows["digest"]]
        for _ in range(levels):
            found = _parents(found)
            n = -(-n // FANOUT)
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [n], "digest": [bytes.fromhex(found[0])]})

    return nodes.select("tree", "idx", "n", "digest").groupBy("tree", _bucket(k)).applyInPandas(up, "tree string, idx long, n long, digest binary")


def _descend(nodes: DataFrame, above: DataFrame, k: int) -> DataFrame:
    """``nodes`` with ``left`` and ``right`` (siblings of each level up to the root), ``subroot`` and ``root``.

    ``above``: the same of each bucket's root. The proof inside a bucket stands before that of its root.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = StructType([*nodes.schema.fields, *StructType.fromDDL("left array<string>, right array<string>, subroot string, root string").fields])
    arrow, names = to_arrow_schema(kinds), nodes.columns

    def down(members: pa.Table, roots: pa.Table) -> pa.Table:
        members = members.select(names).sort_by("idx")
        current = [d.hex() for d in members.column("digest").to_pylist()]
        places, lefts, rights = range(len(current)), [], []
        for _ in range(min(k, height(members.column("n")[0].as_py()))):
            lefts.append(["".join(run[:i]) for run in _runs(current) for i in range(len(run))])
            rights.append(["".join(run[i + 1 :]) for run in _runs(current) for i in range(len(run))])
            current = _parents(current)
        top = {c: roots.column(c)[0].as_py() for c in ("left", "right", "subroot", "root")}
        columns = [members.column(c) for c in names]
        for levels, rest in ((lefts, top["left"]), (rights, top["right"])):
            columns.append(pa.array([[level[p // FANOUT**h] for h, level in enumerate(levels)] + rest for p in places], pa.list_(pa.string())))
        columns += [pa.array([top[c]] * len(places), pa.string()) for c in ("subroot", "root")]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    below = nodes.withColumn("bucket", _bucket(k)).groupBy("tree", "bucket")
    roots = above.select("tree", F.col("idx").alias("bucket"), "left", "right", "subroot", "root").groupBy("tree", "bucket")
    return below.cogroup(roots).applyInArrow(down, kinds)


def _prove(leaves: DataFrame, scratch: Scratch, k: int, crown) -> DataFrame:
    """Proofs of numbered leaves. ``crown(subroots)`` continues above the trees' roots.

    ``subroots`` has (tree, digest, passes), where ``passes`` is the number of collapses that led to a
    tree's root; the crown adds left, right, subroot and root, for a proof that starts at the tree's root.
    """
    biggest = leaves.agg(F.max("n")).first()[0] or 0
    levels, tops = [leaves], [leaves.where("n = 1").select("tree", "digest", F.lit(0).alias("passes"))]
    while biggest > 1:
        parents = scratch.save(_collapse(levels[-1].where("n > 1"), k))
        tops.append(parents.where("n = 1").select("tree", "digest", F.lit(len(levels)).alias("passes")))
        levels.append(parents)
        biggest = -(-biggest // FANOUT**k)
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    crowned = scratch.save(crown(subroots))
    proof = ["left", "right", "subroot", "root"]
    above = None
    for passes in reversed(range(len(levels))):
        own = crowned.where(F.col("passes") == passes).select("tree", *proof)
        found = levels[passes].where("n = 1").join(own, "tree")
        if above is not None:
            found = found.unionByName(_descend(levels[passes].where("n > 1"), above, k))
        above = found if passes == 0 else scratch.save(found.select("tree", "idx", *proof))
    return above


def manifest(leaves: DataFrame, group: str, order: str, digest: str, carry: list[str] | tuple = (), superblock: int = SUPERBLOCK) -> DataFrame:
    """One row per leaf: the order column, the columns in ``carry``, ``digest`` (hexadecimal), ``subroot``, ``root`` and ``proof``.

    ``proof`` is an array of (left, right): the siblings' texts at each level from the leaf
    to the root. ``fold`` recomputes the root from it.
    """
    scratch = Scratch(leaves.sparkSession)
    kept = {f"kept{i}": c for i, c in enumerate([order, *carry])}
    named = leaves.select(
        # strings sort by their bytes; the mark puts null before all others
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(order).alias("place"),
        F.unhex(F.col(digest)).alias("digest"),
        *[F.col(c).alias(k) for k, c in kept.items()],
    )
    hashed = scratch.save(named.withColumn("row", F.monotonically_increasing_id()))

    def forest(subroots: DataFrame) -> DataFrame:
        nodes = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(0).cast("long").alias("row"), F.col("tree").alias("below"), "passes")
        numbered = _numbered(nodes, scratch)
        empty = F.array().cast("array<string>")

        def top(root: DataFrame) -> DataFrame:
            whole = F.lower(F.hex("digest"))
            return root.select("tree", "passes", empty.alias("left"), empty.alias("right"), whole.alias("subroot"), whole.alias("root"))

        proven = _prove(numbered, scratch, superblock, top)
        return proven.select(F.col("below").alias("tree"), "passes", "left", "right", F.lower(F.hex("digest")).alias("subroot"), "root")

    proven = _prove(_numbered(hashed, scratch), scratch, superblock, forest)
    return proven.select(
        *[F.col(k).alias(c) for k, c in kept.items()],
        F.lower(F.hex("digest")).alias(digest),
        "subroot",
        "root",
        F.arrays_zip("left", "right").alias("proof"),
    )
