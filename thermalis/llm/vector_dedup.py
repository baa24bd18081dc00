"""Embedding near-duplicates by PCA-ordered tiles with suffix-norm bounds.

Vectors are scaled to length 1 and rotated to their principal axes, so the leading
coordinates hold the most. They are cut into tiles by halving, each time along that
leading axis on which a tile spreads the most; a tile's box holds its vectors' ranges on
all leading axes. Cosine >= t means a distance of at most sqrt(2 - 2t), so only tiles whose boxes
are as near as that can hold a link. Neighbouring tiles form groups of bounded bytes, and pairs of groups
whose boxes are near meet in a task each. Which groups meet is told in rounds, in each of which a group is sent to two tasks
at most, and the shuffle files of a round go when it is over: so what lies on disk grows with the vectors, not with
the pairs of tiles. For a pair of
tiles the products of the leading coordinates are accumulated first; what the others
can add is at most the product of the two suffix norms (Cauchy-Schwarz), and a pair
stops as soon as that cannot reach the threshold. The survivors of one group of
coordinates go on to the next, and the last ones get their cosine in double precision.
Vectors of floats are kept and sent as floats, which lose nothing.

Exact copies are folded into one representative before any comparison, and a pair of groups
returns per vector the number of links and one link into its local cluster, not all
pairs; so a third of all rows being one vector, or near copies of one, gives no
quadratic output. The rotation is fitted to a bounded sample; it affects speed alone.

Vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths never link. Repeated rows are vectors of their
own. Rows with a null id are kept and link with nothing. Extra columns are ignored; an
empty table gives an empty result. A cosine within rounding of the threshold counts as
double precision gives it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from thermalis.llm.arrowio import give_back, map_columns
from thermalis.llm.components import components
from thermalis.llm.scratch import Scratch

#: Coordinates after which the bound is tried.
STEPS = (24, 64)
#: Vectors of a block of products: few enough that it stays in a core's cache.
ROWS, COLUMNS = 256, 1024
#: Pairs within the bound that are decided together.
HELD = 1 << 15
#: Bytes of vectors in a group of tiles, groups at least where there are as many tiles, and bytes of vectors that
#: rounds may send together (one round by itself sends twice the vectors).
GROUP_BYTES, LEAST_GROUPS, SENT_BYTES = 32 << 20, 16, 128 << 20
#: Leading axes that tiles are cut along and boxed in; about so many vectors' leading coordinates
#: (at most twice as many) decide where the cuts lie, which affects speed alone.
LEADING, CUT_FROM = 8, 1 << 19
#: Allowance for rounding in single precision; survivors are decided in double.
SLACK = 1e-4


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Columns are axes, greatest variance first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1] if len(sample) else np.eye(sample.shape[1])


def halving(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) of each node of a complete binary tree with ``leaves`` leaves, a power of two: medians of the widest axis."""
    axis, cut = np.zeros(leaves, np.int64), np.zeros(leaves)
    held = {1: sample}
    for node in range(1, leaves):
        own = held.pop(node)
        if len(own):
            axis[node] = int(np.argmax(own.std(axis=0)))
            cut[node] = np.median(own[:, axis[node]])
        below = own[:, axis[node]] < cut[node]
        held[2 * node], held[2 * node + 1] = own[below], own[~below]
    return axis, cut


def leaf_of(lead: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Number of the leaf of each row of leading coordinates."""
    node, leaves = np.ones(len(lead), np.int64), len(axis)
    for _ in range(leaves.bit_length() - 1):
        node = 2 * node + (lead[np.arange(len(lead)), axis[node]] >= cut[node])
    return node - leaves


def _bounded(x: np.ndarray, steps) -> list[np.ndarray]:
    """For each step, leading coordinates with the norm of the others as one more."""
    return [np.column_stack([x[:, :m], np.linalg.norm(x[:, m:], axis=1)]).astype(np.float32) for m in steps if m < x.shape[1]]


class Tile:
    """Vectors of a tile, ready to be compared."""

    def __init__(self, uids: np.ndarray, copies: np.ndarray, body: np.ndarray, axes: np.ndarray):
        self.uids, self.copies, self.body = uids, copies, body
        self.norm = np.linalg.norm(body.astype(float), axis=1, keepdims=True)
        self.bounds = _bounded(self.unit(slice(None)) @ axes, STEPS)

    def unit(self, rows) -> np.ndarray:
        """Those vectors with length 1, in double precision."""
        return self.body[rows].astype(float) / self.norm[rows]


def _places(reach: np.ndarray, least: float, hit: np.ndarray) -> np.ndarray:
    """Places in ``reach`` that hold ``least`` or more, few as a rule; eight places at a time are looked at in ``hit``."""
    n = reach.size
    hit[n : n + 8] = False
    np.greater_equal(reach.ravel(), least, out=hit[:n])
    eights = hit[: -(-n // 8) * 8]
    some = np.flatnonzero(eights.view(np.uint64))
    row, column = np.nonzero(eights.reshape(-1, 8)[some])
    return some[row] * 8 + column


def linked(x: Tile, y: Tile, threshold: float):
    """Blocks of (i, j) with cosine >= threshold."""
    buffer, hit, held, many = np.empty(ROWS * COLUMNS, np.float32), np.empty(ROWS * COLUMNS + 8, bool), [], 0

    def decided():
        i, j = (np.concatenate(c) for c in zip(*held, strict=True))
        for bx, by in zip(x.bounds[1:], y.bounds[1:], strict=True):
            on = np.einsum("ij,ij->i", bx[i], by[j]) >= threshold - SLACK
            i, j = i[on], j[on]
        on = np.einsum("ij,ij->i", x.unit(i), y.unit(j)) >= threshold
        return i[on], j[on]

    for a in range(0, len(x.body), ROWS):
        for c in range(0, len(y.body), COLUMNS):
            rows, columns = slice(a, a + ROWS), slice(c, c + COLUMNS)
            n, m = len(x.body[rows]), len(y.body[columns])
            if x.bounds:
                reach = np.matmul(x.bounds[0][rows], y.bounds[0][columns].T, out=buffer[: n * m].reshape(n, m))
                at = _places(reach, np.float32(threshold - SLACK), hit)
            if not x.bounds or len(at) > n * m // 20:  # nearly all are alike: one product for the block
                i, j = np.nonzero(x.unit(rows) @ y.unit(columns).T >= threshold)
                yield i + a, j + c
                continue
            if len(at):
                held.append((at // m + a, at % m + c))
                many += len(at)
            if many > HELD:
                yield decided()
                held, many = [], 0
    if held:
        yield decided()


def _roots(n: int, i: np.ndarray, j: np.ndarray, parent: np.ndarray) -> None:
    """Union of i and j in ``parent``, by label propagation over the new links."""
    while True:
        low = np.minimum(parent[i], parent[j])
        before = parent.copy()
        np.minimum.at(parent, parent[i], low)
        np.minimum.at(parent, parent[j], low)
        parent[:] = parent[parent]
        if (parent == before).all():
            return


def _compare(x: Tile, y: Tile, threshold: float):
    """(ids, links weighted by copies, id of a vector in the same local cluster) of linked vectors."""
    same = x is y
    n = len(x.uids) + (0 if same else len(y.uids))
    links, parent = np.zeros(n), np.arange(n)
    for i, j in linked(x, y, threshold):
        if same:
            on = i < j
            i, j = i[on], j[on]
        if len(i):
            links[: len(x.uids)] += np.bincount(i, y.copies[j], len(x.uids))
            other = j if same else j + len(x.uids)
            links += np.bincount(other, x.copies[i], n)
            _roots(n, i, other, parent)
    ids = x.uids if same else np.concatenate([x.uids, y.uids])
    found = np.flatnonzero(links > 0)
    return ids[found], links[found], ids[parent[found]]


def _summed(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_compare`` gave for several pairs of tiles, as one row for each vector."""
    none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    ids, links, others = (np.concatenate(c) for c in zip(none, *found, strict=True))
    names, at = np.unique(np.concatenate([ids, others]), return_inverse=True)
    parent = np.arange(len(names))
    _roots(len(names), at[: len(ids)], at[len(ids) :], parent)
    return names, np.bincount(at[: len(ids)], links, len(names)), names[parent]


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = 4096, tile_bytes: int = 16 << 20, sample_bytes: int = 32 << 20) -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id (least id reachable) and kept."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    kind = df.schema[vector_col].dataType
    kind = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    usable = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    plain = F.transform(v, lambda x: x + F.lit(0.0).cast(kind))  # -0.0 and 0.0 are alike
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(usable, F.lit(False)), plain).alias("vector"))
    rows = rows.withColumn("uid", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    whole = scratch.save(rows.where("vector is not null").groupBy("uid", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    heads = scratch.save(whole.select("uid", "id", "copies"))
    nodes, lengths = None, sorted((r["d"], r["count"]) for r in whole.groupBy(F.size("vector").alias("d")).count().collect())
    for d, count in lengths:
        dealt = (lambda: scratch.drop(whole)) if d == lengths[-1][0] else (lambda: None)  # vectors lie in their tiles from then on
        found = _one_length(whole.where(F.size("vector") == d), d, count, np.float32 if kind == "float" else np.float64, threshold, max(1, min(tile, tile_bytes // (8 * d))), sample_bytes, scratch, dealt)
        nodes = found if nodes is None else nodes.union(found)
    if nodes is None:
        nodes = spark.createDataFrame([], "uid long, links double, other long")
    nodes = scratch.save(nodes)
    groups = components(nodes.select("uid", "other"), scratch, "uid", "other")
    named = heads.join(groups.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    links = nodes.groupBy("uid").agg(F.sum("links").cast("long").alias("links"))
    known = named.join(least, "component").join(links, "uid", "left").select("uid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.join(known, "uid", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("component_id", "id").eqNullSafe(F.col("id")).alias("kept"),
    )


def near_tiles(tiles: DataFrame, reach: float) -> DataFrame:
    """Pairs (i, j), i <= j, of tiles whose boxes are at most ``reach`` apart, by bins on the first axis."""
    width = max(reach, 0.02)
    box = tiles.select("tile", "lo", "hi")
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.get(low, F.lit(0)) / width), F.floor(F.get(high, F.lit(0)) / width))).alias("bin")
    wider = F.transform("hi", lambda v: v + F.lit(reach))
    a = box.select(F.col("tile").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"), bins(F.transform("lo", lambda v: v - F.lit(reach)), wider))
    b = box.select(F.col("tile").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"), bins(F.col("lo"), F.col("hi")))
    gap = F.zip_with(F.zip_with("lo_i", "hi_j", lambda x, y: x - y), F.zip_with("lo_j", "hi_i", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda acc, g: acc + g * g)
    return a.join(b, "bin").where((F.col("i") <= F.col("j")) & (apart <= F.lit(reach * reach))).select("i", "j").distinct()


def _one_length(whole: DataFrame, d: int, count: int, kind: type, threshold: float, tile: int, sample_bytes: int, scratch: Scratch, dealt) -> DataFrame:
    spark = whole.sparkSession
    n_sample = max(1, min(20_000, sample_bytes // (8 * d)))
    sample = whole.orderBy(F.xxhash64("uid"), "uid").limit(n_sample).select("uid", "vector")

    def axes_of(batches):
        x = [np.stack([np.asarray(v, float) for v in b.column("vector").to_pylist()]) for b in batches if b.num_rows]
        x = np.concatenate(x)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        yield pa.array([0]), [[principal_axes(x).tobytes()]]

    axes = np.frombuffer(map_columns(sample.repartition(1), "k long, axes binary", axes_of).first()["axes"]).reshape(d, d)
    leaves = 1 << max(0, min(-(-count // tile), CUT_FROM // 16) - 1).bit_length()

    def leading(b: pa.RecordBatch):
        flat = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        return flat, lead_of(flat)

    def lead_of(flat: np.ndarray) -> np.ndarray:
        flat = flat.astype(float)
        return (flat / np.linalg.norm(flat, axis=1, keepdims=True)) @ axes[:, :LEADING]

    def project(batches):
        for b in batches:
            yield b.column("uid"), [list(leading(b)[1])]

    def tree_of(batches):
        lead = [b.column("lead").flatten().to_numpy().reshape(-1, min(d, LEADING)) for b in batches if b.num_rows]
        axis, cut = halving(np.concatenate(lead), leaves)
        yield pa.array([0]), [[axis.tobytes()], [cut.tobytes()]]

    chosen = whole.select("uid", "vector").where(F.pmod(F.xxhash64("uid"), F.lit(max(1, count // CUT_FROM))) == 0)
    tree = map_columns(map_columns(chosen, "uid long, lead array<double>", project).repartition(1).sortWithinPartitions("uid"), "k long, axis binary, cut binary", tree_of).first()
    sent = spark.sparkContext.broadcast((np.frombuffer(tree["axis"], np.int64), np.frombuffer(tree["cut"])))

    def place(batches):
        axis, cut = sent.value
        for b in batches:
            flat, lead = leading(b)
            yield b.column("uid"), [b.column("copies"), pa.array([r.tobytes() for r in np.ascontiguousarray(flat)], pa.binary()), leaf_of(lead, axis, cut)]

    placed = scratch.save(map_columns(whole.select("uid", "copies", "vector"), "uid long, copies long, vector binary, leaf long", place))
    dealt()
    # a leaf that holds more than its share is split by hash, so no tile outgrows a task
    sizes = placed.groupBy("leaf").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / tile)).alias("parts"))
    # one row for each leaf, at most CUT_FROM / 16; tiles are numbered in the order of leaves, so neighbours form a group
    sizes = scratch.save(sizes.withColumn("before", F.sum("parts").over(Window.orderBy("leaf")) - F.col("parts")))
    n_tiles = sizes.agg(F.sum("parts")).first()[0]
    in_group = max(1, min(GROUP_BYTES // (tile * d * np.dtype(kind).itemsize), n_tiles // LEAST_GROUPS))
    groups = -(-n_tiles // in_group)
    tiled = placed.join(F.broadcast(sizes), "leaf").withColumn("tile", F.col("before") + F.pmod("uid", "parts")).drop("leaf", "parts", "before")

    def assemble(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")
        body = b"".join(t.column("vector").to_pylist())
        lead = lead_of(np.frombuffer(body, kind).reshape(-1, d))
        cells = {"lo": [lead.min(axis=0)], "hi": [lead.max(axis=0)], "uids": [t.column("uid").to_numpy().tobytes()], "copies": [t.column("copies").to_numpy().tobytes()], "body": [body]}
        kinds = dict.fromkeys(("lo", "hi"), pa.list_(pa.float64())) | dict.fromkeys(("uids", "copies", "body"), pa.binary())
        return pa.table({"tile": t.column("tile")[:1]} | {c: pa.array(v, kinds[c]) for c, v in cells.items()})

    tiles = tiled.groupBy("tile").applyInArrow(assemble, "tile long, lo array<double>, hi array<double>, uids binary, copies binary, body binary")
    tiles = scratch.save(tiles.withColumn("of", F.floor(F.col("tile") / in_group)))
    scratch.drop(placed)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    ends = lambda name, f: F.array(*(f(F.get(name, F.lit(k))) for k in range(min(d, LEADING)))).alias(name)
    boxes = tiles.groupBy(F.col("of").alias("tile")).agg(ends("lo", F.min), ends("hi", F.max))
    # in a round each group meets the ones so many places before and behind it, counted in a circle
    apart = F.col("j") - F.col("i")
    together = max(1, SENT_BYTES // max(1, 2 * count * d * np.dtype(kind).itemsize))
    pairs = scratch.save(near_tiles(boxes, reach).withColumn("step", F.floor(F.least(apart, groups - apart) / together)))

    def compare(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        t = t.sort_by("tile")
        get = lambda name, k, kind: np.frombuffer(t.column(name)[k].as_buffer(), kind)
        of, lo, hi = t.column("of").to_pylist(), np.array(t.column("lo").to_pylist()), np.array(t.column("hi").to_pylist())
        ready = lambda k: Tile(get("uids", k, np.int64), get("copies", k, np.int64), get("body", k, kind).reshape(-1, d), axes)
        left = {k: ready(k) for k in range(t.num_rows) if of[k] == i}
        found = []
        for k in range(t.num_rows):
            if of[k] != j:
                continue
            own = left[k] if i == j else ready(k)
            for q, other in left.items():
                gap = np.maximum(np.maximum(lo[q] - hi[k], lo[k] - hi[q]), 0)
                if (i != j or q <= k) and gap @ gap <= reach * reach:
                    found.append(_compare(other, own, threshold))
        ids, links, others = _summed(found)
        del left, found
        give_back()
        return pa.table({"uid": pa.array(ids, pa.int64()), "links": pa.array(links, pa.float64()), "other": pa.array(others, pa.int64())})

    out = None
    for step, many in sorted((r["step"], r["count"]) for r in pairs.groupBy("step").count().collect()):
        ask = pairs.where(F.col("step") == step).select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("of"))
        # at most two rows for each group and round; more partitions than pairs, so few meet in one
        met = tiles.join(F.broadcast(ask), "of").repartition(2 * many, "i", "j")
        found = scratch.save(met.groupBy("i", "j").applyInArrow(compare, "uid long, links double, other long"))
        out = found if out is None else out.union(found)
    scratch.drop(tiles)
    return out
