"""N-gram Jaccard self-join by token-combination prefixes.

A document is the set of its distinct ``n``-word shingles (64-bit hashes), the tokens of
the join. All sets are ordered alike: rare tokens before frequent ones, each by hash.
``frequent`` may be any fixed set of tokens, since any common order is right; here it is
a bounded set of those that single tasks saw most often, so its cost does not grow.

*Singles.* Of two sets with similarity >= t the first ``|x| - ceil(t|x|) + 1`` tokens
share one. Rare tokens among these are indexed one by one.

*Combinations.* If a set has too few rare tokens to fill that prefix, the shared one may
be frequent. Such a set extends its prefix until it shares so many tokens with any
partner that two shared ones must stand side by side among the frequent tokens of both
(a shared neighbourhood breaks only at the few tokens not shared), and indexes each pair
of neighbours instead of the frequent tokens themselves. Two sets that share a rare
token meet by singles, two that share none meet by combinations; no pair is lost.

*Candidates.* Sets in one index list are compared by bucket counts of their hashes: the
sum of differences never exceeds the sets' symmetric difference, so a pair beyond what t
allows is out. Lists give edges of a spanning forest, never all pairs; lists longer than
``chunk`` are compared chunk against chunk. The surviving edges form small clusters.

*Verification.* Sets of one cluster meet in one group (large clusters again chunk
against chunk) and every pair whose sizes fit is counted exactly, in integers.

Equal sets are folded into one before the join, and count as many partners as they stand
for. Sets travel only if they are in clusters, and their texts are found by a join on the id; nothing of
all documents reaches the driver but counts of frequency classes and the frequent tokens
(at most ``max_frequent``).

Null and empty texts and texts without words have empty sets and link with nothing;
fewer words than ``n`` count as one shingle. Rows with a null id are returned with a null
component and link with nothing. A repeated id stands for each of its rows. Extra columns
are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalis.llm.arrowio import map_columns, slices
from thermalis.llm.components import components
from thermalis.llm.scratch import Scratch
from thermalis.llm.words import mix, shingles, words

#: A token counts as frequent from this many documents on, if there is room.
FREQUENT_FROM = 8


def text_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text."""
    found, rows = shingles(*words(texts), n)
    cut = np.searchsorted(rows, np.arange(len(texts) + 1))
    return [np.unique(found[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit fingerprint of a set, as a signed integer."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(tokens).sum() * np.uint64(3) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def need(size, percent: int):
    """Least overlap of a set with any partner: ceil(t * size)."""
    return -(-size * percent // 100)


def index_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The keys under which a set is listed."""
    size = len(tokens)
    if not size:
        return tokens
    common = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens if len(frequent) else np.zeros(size, bool)
    rare, common = tokens[~common], tokens[common]
    prefix = size - need(size, percent) + 1
    if len(rare) >= prefix or len(common) < 2:
        return rare[:prefix]
    most = size * 100 // percent  # the largest partner, and its prefix
    extended = min(size, size - need(size, percent) + prefix + most - need(most, percent) + 1)
    run = common[: max(0, extended - len(rare))]
    with np.errstate(over="ignore"):
        return np.concatenate([rare, mix(mix(run[:-1]) + run[1:] + np.uint64(1))])


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Counts of hashes by their leading bits, about eight to a bucket, a power of two of buckets."""
    bits = max(4, int(np.ceil(np.log2(max(1, len(tokens) / 8)))))
    return np.minimum(np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def allowed(x, y, percent: int):
    """Greatest symmetric difference of sets of these sizes that are similar enough."""
    return (x + y) * (100 - percent) // (100 + percent)


class Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def possible_edges(sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that bucket counts do not rule out."""
    order = np.argsort(sizes, kind="stable")
    n = sizes[order].astype(np.int64)
    forest, edges, folded = Forest(len(order)), [], {}

    def at(i: int, width: int) -> np.ndarray:
        got = folded.get((i, width))
        if got is None:
            s = sketches[order[i]].astype(np.int32)
            got = folded[i, width] = s.reshape(width, -1).sum(axis=1)
        return got

    widths = [len(sketches[k]) for k in order]
    for i in range(len(order)):
        last = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
        others = np.arange(i + 1, last)
        if len(others) > 8:  # those in the same tree need no look
            own = forest.root(i)
            others = np.array([j for j in others.tolist() if forest.root(j) != own], np.int64)
        if not len(others):
            continue
        width = widths[i]
        apart = np.abs(np.stack([at(j, width) for j in others.tolist()]) - at(i, width)).sum(axis=1)
        for j in others[apart <= allowed(n[i], n[others], percent)].tolist():
            if forest.join(i, j):
                edges.append((int(order[i]), int(order[j])))
    return edges


def similar_edges(sets: list[np.ndarray], percent: int, split: int | None = None, copies: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The pairs with 100 * overlap >= percent * union, counted exactly: a spanning forest, and each set's number of partners.

    With ``split`` only pairs of one set before and one from that position on count. A partner
    counts as many times as ``copies`` says, else once.
    """
    copies = np.ones(len(sets), np.int64) if copies is None else copies
    partners = np.zeros(len(sets), np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(place, kind="stable")
    lists, ends = owner[order], np.searchsorted(place[order], np.arange(len(tokens) + 1))
    forest, edges = Forest(len(sets)), []
    for i in range(len(sets)):
        mine = place[starts[i] : starts[i + 1]]
        count = ends[mine + 1] - ends[mine]
        at = np.repeat(ends[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        overlap = np.bincount(lists[at], minlength=len(sets))
        on = 100 * overlap >= percent * (sizes + sizes[i] - overlap)
        on[: i + 1] = False
        if split is not None:
            on[: max(split, i + 1)] = False
            if i >= split:
                break
        partners[i] += copies[on].sum()
        partners[on] += copies[i]
        for j in np.flatnonzero(on).tolist():
            if forest.join(i, j):
                edges.append((i, j))
    return edges, partners


def grouped(batches, key: str):
    """Rows of neighbouring equal keys as Arrow tables, across batches."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cuts.tolist(), b.num_rows]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column(key)[0].as_py() != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _pack(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _chunk_pairs(rows: DataFrame, group: str, chunk: str, scratch: Scratch) -> DataFrame:
    """Give each row of a group in several chunks to every pair of them (``meet``, and ``side`` of it)."""
    large = rows.groupBy(group).agg(F.max(chunk).alias("last")).where("last > 0")
    both = rows.join(large, group, "left").withColumn("last", F.coalesce("last", F.lit(0)))
    spread = both.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return spread.withColumn("meet", F.xxhash64(group, F.least("k", chunk), F.greatest("k", chunk))).withColumn("side", F.when(F.col("last") == 0, 0).when(F.col("k") == F.col(chunk), 0).when(F.col("k") > F.col(chunk), 1).otherwise(2))


def cluster_sets(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", max_frequent: int = 1 << 19, chunk: int = 1024) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id reachable by links of similarity >= percent / 100) and n_links (other rows linked directly, copies and all)."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    # Scan 1: every document's set as a fingerprint and size, and the tokens that a task saw in several sets.
    def survey(batches):
        seen: set[int] = set()
        pool, pooled = [], 0

        def counts():
            t, c = np.unique(np.concatenate(pool), return_counts=True)
            t, c = t[c > 1], c[c > 1]
            pool.clear()
            return pa.nulls(len(t), pa.int64()), [t.view(np.int64), c, np.ones(len(t), np.int32), pa.nulls(len(t), pa.binary())]

        for batch in batches:
            for part in slices(batch, "text"):
                sets = text_sets(part.column("text"), n)
                uids = [set_id(s) for s in sets]
                body = []
                for s, u in zip(sets, uids, strict=True):
                    new = len(s) and u not in seen
                    body.append(sketch(s).tobytes() if new else None)
                    if new:
                        seen.add(u)
                        pool.append(s)
                        pooled += len(s)
                yield part.column("id"), [uids, [len(s) for s in sets], [0] * len(sets), pa.array(body, pa.binary())]
                if pooled > 4 << 20:
                    yield counts()
                    pooled, seen = 0, set() if len(seen) > 1 << 20 else seen
        if pool:
            yield counts()

    surveyed = scratch.save(map_columns(texts, "id long, uid long, n long, kind int, sketch binary", survey))
    docs = surveyed.where("kind = 0").select("id", "uid", "n")
    seen = scratch.save(surveyed.where("kind = 1").groupBy("uid").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM))
    room, level = max_frequent, 63
    for c, k in sorted(((r["c"], r["count"]) for r in seen.groupBy(F.floor(F.log2("n")).cast("int").alias("c")).count().collect()), reverse=True):
        if k > room:
            break
        room, level = room - k, c
    tokens = seen.where(F.floor(F.log2("n")) >= level).select("uid").toPandas()["uid"].to_numpy(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(np.sort(tokens))

    # Scan 2: index keys of each distinct set.
    def post(batches):
        frequent, seen = sent.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                keys, uids = [], []
                for s in text_sets(part.column("text"), n):
                    u = set_id(s)
                    if len(s) and u not in seen:
                        if len(seen) < 1 << 20:  # other repeats are dropped where lists are read
                            seen.add(u)
                        keys.append(index_keys(s, frequent, percent))
                        uids.append(u)
                many = [len(k) for k in keys]
                yield pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64()), [np.repeat(np.array(uids, np.int64), many)]

    postings = map_columns(texts.where(F.col("id").isNotNull()).select(F.col("text"), F.col("id").alias("row")), "key long, uid long", post)

    def lists(batches):
        """Lists of two sets or more under a name that depends on their members; equal lists once."""
        known: set[int] = set()
        now, held, part = None, [], 0

        def close():
            nonlocal held, part
            whole = np.concatenate(held) if held else np.zeros(0, np.int64)
            out = None
            if part:
                name = int(mix(np.array([now], np.int64).view(np.uint64)).view(np.int64)[0])
                out = (np.full(len(whole), name), whole, np.full(len(whole), part, np.int32)) if len(whole) else None
            held, part = [], 0
            return out

        for b in batches:
            if not b.num_rows:
                continue
            key, uid = b.column("key").to_numpy(), b.column("uid").to_numpy()
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (uid[1:] != uid[:-1])
            if held and now == key[0] and held[-1][-1] == uid[0]:
                fresh[0] = False
            key, uid = key[fresh], uid[fresh]
            if not len(key):
                continue
            out = []
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            whole = ends - starts
            # the first and the last list may go on in other batches
            inner = np.zeros(len(starts), bool)
            inner[1:-1] = whole[1:-1] > 1
            inner &= whole <= chunk
            with np.errstate(over="ignore"):
                names = mix(np.add.reduceat(mix(uid.view(np.uint64)), starts) * np.uint64(5) + whole.astype(np.uint64)).view(np.int64)
            pick = [k for k in np.flatnonzero(inner).tolist() if names[k] not in known and not known.add(int(names[k]))]
            if pick:
                at = np.concatenate([np.arange(starts[k], ends[k]) for k in pick])
                out.append((np.repeat(names[pick], whole[pick]), uid[at], np.zeros(len(at), np.int32)))
            for k in sorted({0, len(starts) - 1, *np.flatnonzero(whole > chunk).tolist()}):
                if now is not None and key[starts[k]] != now:
                    out += finish(now, held, part, known, close)
                now = int(key[starts[k]])
                held.append(uid[starts[k] : ends[k]])
                while sum(map(len, held)) > chunk:
                    flat = np.concatenate(held)
                    name = int(mix(np.array([now], np.int64).view(np.uint64)).view(np.int64)[0])
                    out.append((np.full(chunk, name), flat[:chunk], np.full(chunk, part, np.int32)))
                    held, part = [flat[chunk:]], part + 1
            for o in out:
                yield pa.array(o[0]), [o[1], o[2]]
        for o in finish(now, held, part, known, close):
            yield pa.array(o[0]), [o[1], o[2]]

    def finish(now, held, part, known, close):
        if not part:
            flat = np.concatenate(held) if held else np.zeros(0, np.int64)
            close()
            if len(flat) < 2:
                return []
            with np.errstate(over="ignore"):
                name = int(mix(np.array([mix(flat.view(np.uint64)).sum() * np.uint64(5) + np.uint64(len(flat))], np.uint64)).view(np.int64)[0])
            if name in known:
                return []
            known.add(name)
            return [(np.full(len(flat), name), flat, np.zeros(len(flat), np.int32))]
        out = close()
        return [out] if out else []

    listed = scratch.save(map_columns(postings.repartition("key").sortWithinPartitions("key", "uid"), "list long, uid long, chunk int", lists))
    sketches = surveyed.where("kind = 0 and sketch is not null").groupBy("uid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    members = _chunk_pairs(listed, "list", "chunk", scratch).join(sketches, "uid").select("meet", "side", "uid", "n", "sketch")

    def propose(batches):
        for t in grouped(batches, "meet"):
            uid, first = np.unique(t.column("uid").to_numpy(), return_index=True)
            t = t.take(pa.array(first))
            edges = possible_edges(t.column("n").to_numpy(), [np.frombuffer(x, np.uint8) for x in t.column("sketch").to_pylist()], percent)
            if edges:
                yield pa.array([uid[a] for a, _ in edges]), [[uid[b] for _, b in edges]]

    proposed = map_columns(members.repartition("meet").sortWithinPartitions("meet"), "a long, b long", propose)
    clusters = components(proposed.distinct(), scratch)

    # Verification: one document for each set in a cluster, with the number of its copies.
    distinct = docs.where("id is not null and n > 0").groupBy("uid").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    chosen = distinct.join(clusters.withColumnRenamed("node", "uid"), "uid")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    chosen = chosen.join(sizes, "component").select("id", "uid", "copies", "component", F.pmod(F.xxhash64("uid"), F.ceil(F.col("members") / chunk)).cast("int").alias("chunk"))
    wanted = texts.where(F.col("id").isNotNull()).join(chosen, "id")

    def fetch(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = text_sets(part.column("text"), n)
                same = [k for k, (s, u) in enumerate(zip(sets, part.column("uid").to_pylist(), strict=True)) if set_id(s) == u]
                at = pa.array(same, pa.int64())
                yield part.column("component").take(at), [*(part.column(c).take(at) for c in ("uid", "copies", "chunk")), _pack([sets[k] for k in same])]

    bodies = map_columns(wanted.select("component", "uid", "copies", "chunk", "text"), "component long, uid long, copies long, chunk int, body binary", fetch)
    bodies = scratch.save(bodies)
    meeting = _chunk_pairs(bodies, "component", "chunk", scratch).select("meet", "side", "uid", "copies", "body").repartition("meet").sortWithinPartitions("meet", "side", "uid")

    def verify(batches):
        """Links (a, b) of a forest, and the number n of partners that the set ``a`` met here."""
        for t in grouped(batches, "meet"):
            side, uid = t.column("side").to_numpy(), t.column("uid").to_numpy()
            keep = np.concatenate([[True], (uid[1:] != uid[:-1]) | (side[1:] != side[:-1])])
            side, uid, copies = side[keep], uid[keep], t.column("copies").to_numpy()[keep]
            sets = [np.frombuffer(x, np.uint64) for x, k in zip(t.column("body").to_pylist(), keep, strict=True) if k]
            split = int((side == 1).sum()) if side[0] else None  # a chunk that is empty meets nothing
            if len(sets) > 1:
                edges, partners = similar_edges(sets, percent, split, copies)
                linked = np.flatnonzero(partners)
                if len(linked):
                    a = np.concatenate([uid[[i for i, _ in edges]], uid[linked]])
                    b = pa.array([*(int(uid[j]) for _, j in edges), *[None] * len(linked)], pa.int64())
                    yield pa.array(a), [b, pa.array([*[None] * len(edges), *partners[linked].tolist()], pa.int64())]

    met = scratch.save(map_columns(meeting, "a long, b long, n long", verify))
    links = components(met.where("b is not null").select("a", "b").distinct(), scratch)
    partners = met.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("partners"))
    scratch.drop(seen, listed, bodies)
    known = distinct.join(links.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = known.groupBy("component").agg(F.min("id").alias("component_id"))
    named = known.join(least, "component").join(partners, "uid", "left").select("uid", "component_id", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_set = F.col("id").isNotNull() & (F.col("n") > 0)
    return docs.join(named, "uid", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(of_set, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(of_set, F.col("n_links")).otherwise(0).alias("n_links"),
    )
