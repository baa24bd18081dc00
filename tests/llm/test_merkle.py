import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from thermalis.llm import merkle, queries


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain(rows: list[tuple], fanout: int = 3):
    """(group, order, leaf, other leaf) -> sorted (order, leaf, subroot, root, proof digest, folded), level by level over whole lists."""

    def climb(nodes):
        """The root, and each node's siblings before and after it, level by level."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for j, i in enumerate(at):
                start = i // fanout * fanout
                steps[j].append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + fanout])))
                at[j] = i // fanout
            nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        return nodes[0] if nodes else None, steps

    groups = {}
    for g, o, leaf, other in rows:
        groups.setdefault(g, []).append(((o is not None, o or 0), leaf, other))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {g: climb([leaf for _, leaf, _ in sorted(groups[g], key=lambda r: r[:2])]) for g in order}
    root, above = climb([found[g][0] for g in order])
    out = []
    for g, over in zip(order, above, strict=True):
        for (o, leaf, other), steps in zip(sorted(groups[g], key=lambda r: r[:2]), found[g][1], strict=True):
            folded = other or leaf
            for a, b in steps + over:
                folded = h(a, folded, b)
            out.append((o[1] if o[0] else -1, leaf, found[g][0], root, h(*[a + b for a, b in steps + over]), folded))
    return sorted(out)


def got(leaves, superblock):
    out = merkle.manifest(leaves, "g", "o", "leaf", ["other"], superblock)
    out = out.select(F.coalesce("o", F.lit(-1)).alias("o"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.fold(F.coalesce("other", "leaf"), F.col("proof")))
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("superblock", [1, 2, 6])
def test_trees_of_many_sizes(spark, superblock):
    rows = [(g, o, h(str(g), str(o)), h("x", str(o)) if o % 5 == 0 else None) for g, n in enumerate([1, 2, 3, 4, 8, 9, 10, 27, 28, 82, 244]) for o in range(n)]
    rows = [(None if g == 2 else f"s{g}", *r) for g, *r in rows]
    leaves = spark.createDataFrame(rows, "g string, o long, leaf string, other string")
    assert got(leaves, superblock) == plain(rows)


def test_edges(spark):
    rows = [("", 1, h("a"), None), (None, 1, h("a"), None), ("b", None, h("n"), None), ("b", None, h("m"), None), ("b", 7, h("same"), None), ("b", 7, h("same"), None), ("é", 3, h("e"), h("f")), ("z", 3, h("z"), None), ("=", 3, h("q"), None)]
    leaves = spark.createDataFrame(rows, "g string, o long, leaf string, other string").withColumn("tree", F.lit(1)).withColumn("digest", F.lit("clash")).withColumn("idx", F.lit(9))
    assert got(leaves, 2) == plain(rows)
    assert got(leaves.limit(0), 2) == []
    one = [("only", 5, h("a"), None)]
    assert got(spark.createDataFrame(one, "g string, o long, leaf string, other string"), 6) == plain(one)


def test_leaf(spark):
    row = spark.createDataFrame([(12, None, "", "aé\n" * 100_000)], "a long, b string, c string, d string")
    assert row.select(merkle.leaf_digest(*map(F.col, "abcd"))).first()[0] == h(*map(field, (12, None, "", "aé\n" * 100_000)))


def test_query(spark, sf):
    rows = []
    for r in queries.table(spark, sf, "documents").collect():
        leaf = lambda text, r=r: h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))
        even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        rows.append((r.source, r.doc_id, leaf(r.text), leaf(r.text.replace("\n", "")) if even and r.text is not None else None))
    out = queries.op11_merkle_manifest(spark, sf)
    found = sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root").collect()))
    assert found == plain(rows)
    assert all(r.verified == (r.folded_root == r.root) for r in out.collect())
    assert 0 < out.where("not verified").count() < len(rows)
