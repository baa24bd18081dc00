"""Benchmark decontamination by SimHash over item-sized windows.

Texts become 64-bit word hashes (A-Z lower-cased, split at ASCII white space) and
five-word shingles. Of an item, every window of the document with as many words counts
(a shorter document is one window). The shingles shared in a window cannot be more than
its positions whose shingle the item has, so the windows proposed are all those with
enough such positions to reach ``threshold``, wherever these stand in the item. Running counts, in which a shingle that repeats counts
as often as the item has it, put the windows of an item in order and drop those that cannot reach the threshold. From the best on they
get a SimHash of 128 bits from their shingles, weighted by their counts, until one is found. Fingerprints are
compared by blocks: two within ``radius`` bits differ in at most ``radius // 2`` bits in one
of two blocks of 64 at least, so the blocks let every fingerprint within the radius
through (and of unrelated ones less than 1 in 200). What is left is verified by exact weighted-shingle similarity, sum of least over sum of
greatest counts. At 0.8 the expected distance is 19.4 bits with a deviation of 4.1, so
the default radius of 40 is five deviations away. Of windows with equal similarity the first is returned.

The benchmark is sent to all tasks in parts of at most ``part_bytes`` of text, one scan
of the documents for each part. Documents stay where they are: no shuffle, and neither
a hot source nor long texts or repeated passages gather anywhere.

Null and empty texts match nothing. An item of fewer than five words has one
shingle, its whole sequence, so it matches where a document holds just these words in a row; an item without words matches nothing. Texts
of any length count whole. Rows with a null id are judged like others.
Repeated documents and repeated items all give rows. Extra columns are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalis.llm.arrowio import give_back, map_columns, slices
from thermalis.llm.words import combine, mix, shingles, words

#: Bits of a block, and what tells the second block's hashes from the first's.
BITS, SECOND = 64, np.uint64(0x6A09E667F3BCC909)


def both(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles for the two blocks of a fingerprint."""
    return hashes, mix(hashes ^ SECOND)


def simhash(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Two blocks of 64 bits; each bit is set if the weight of shingles with it exceeds that of those without."""
    out = np.zeros(2, np.uint64)
    for k, own in enumerate(both(hashes)):
        bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
        votes = ((2 * bits - 1) * weights[:, None]).sum(axis=0)
        out[k] = np.packbits(votes > 0, bitorder="little").view("<u8")[0]
    return out


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (ascending distinct shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least)) if len(i) else 0.0


def window_prints(found: np.ndarray, at: np.ndarray, m: int, span: int = 1 << 13) -> np.ndarray:
    """SimHash of the ``m`` shingles from each of the ascending places ``at``, by running sums of bits."""
    out, k = np.zeros(len(at), np.uint64), 0
    while k < len(at):
        stop = int(np.searchsorted(at, at[k] + span))
        own = found[at[k] : at[stop - 1] + m].astype("<u8")
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((len(own) + 1, BITS), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        first = at[k:stop] - at[k]
        votes = 2 * (sums[first + m] - sums[first]) > m
        out[k:stop] = np.packbits(votes, axis=1, bitorder="little").view("<u8")[:, 0]
        k = stop
    return out


def within(prints: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """Which of the fingerprints (rows of two blocks) differ from ``other`` in at most ``radius`` bits.

    The second block of a fingerprint is looked at only if the first does not decide.
    """
    first = np.bitwise_count(prints[:, 0] ^ other[0]).astype(np.int64)
    maybe = np.flatnonzero(first <= radius)
    second = np.bitwise_count(prints[maybe, 1] ^ other[1]).astype(np.int64)
    near = np.minimum(first[maybe], second) <= radius // 2
    out = np.zeros(len(prints), bool)
    out[maybe] = near & (first[maybe] + second <= radius)
    return out


class Benchmark:
    """Items' shingles, their index and fingerprints; built in time linear in the items but for sorting."""

    def __init__(self, ids: list, texts: pa.Array, n: int, radius: int):
        hashes, offsets = words(texts)
        self.n, self.ids, self.size = n, ids, np.diff(offsets)
        found, rows = shingles(hashes, offsets, n)
        keep = self.size[rows] >= n
        found_, rows_ = found[keep], rows[keep]
        order = np.lexsort((rows_, found_))
        found_, rows_ = found_[order], rows_[order]
        once = np.ones(len(found_), bool)
        once[1:] = (found_[1:] != found_[:-1]) | (rows_[1:] != rows_[:-1])
        self.shingles, self.rows = found_[once], rows_[once]
        #: How often an item has each of its shingles.
        self.counts = np.diff(np.append(np.flatnonzero(once), len(found_)))
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        cut = np.searchsorted(rows, np.arange(len(ids) + 1))
        self.bags = [np.unique(found[a:b], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.prints, self.radius = [simhash(*bag) for bag in self.bags], radius
        #: Items of fewer than ``n`` words, by their number of words and the hash of these.
        self.short: dict[int, dict[int, list[int]]] = {}
        for r in np.flatnonzero((self.size > 0) & (self.size < n)).tolist():
            words_ = int(self.size[r])
            own = int(combine(hashes[offsets[r] : offsets[r + 1]], words_)[0])
            self.short.setdefault(words_, {}).setdefault(own, []).append(r)

    def short_matches(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """The first window of each document that is word for word an item of fewer than ``n`` words."""
        out, row = [], np.repeat(np.arange(len(counts)), counts)
        begin = np.cumsum(counts) - counts
        for size, items in self.short.items():
            if len(hashes) < size:
                continue
            runs = combine(hashes, size)
            hits = np.flatnonzero(np.isin(runs, np.array(list(items), np.uint64)) & (row[: len(runs)] == row[size - 1 :]))
            order = np.lexsort((hits, runs[hits], row[hits]))
            hits = hits[order]
            new = np.ones(len(hits), bool)
            new[1:] = (row[hits[1:]] != row[hits[:-1]]) | (runs[hits[1:]] != runs[hits[:-1]])
            out += [(int(row[h]), item, 1.0, int(h - begin[row[h]]), size) for h in hits[new] for item in items[int(runs[h])]]
        return out

    def shared(self, group: np.ndarray, at: np.ndarray, doc: np.ndarray, which: np.ndarray, m: np.ndarray, of: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For windows at ``start`` of groups ``of``: how many of an item's shingles they hold, each as often as in both.

        A hit counts in a window if it stands among the window's first occurrences of its shingle, as many as the item has: from
        behind the occurrence that many places before it, or the window's length before it, up to itself. So every hit is an
        interval of starts, and a window's sum is the intervals open at its start.
        """
        order = np.lexsort((at, doc, which))
        back = np.arange(len(order)) - self.counts[which[order]]
        other = order[np.maximum(back, 0)]
        same = (back >= 0) & (which[other] == which[order]) & (doc[other] == doc[order])
        closed = np.full(len(at), -1, np.int64)
        closed[order] = np.where(same, at[other], -1)
        closed = np.maximum(closed, at - m)
        wide = np.int64(2 * (at.max() + m.max() + 2))
        shift = wide // 2
        begun = np.sort(group * wide + closed + shift)
        ended = group * wide + at + shift  # in order already
        now = of * wide + start + shift
        return np.searchsorted(begun, now) - np.searchsorted(ended, now)

    def matches(self, texts: pa.Array, threshold: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of the best window of each item found."""
        hashes, offsets = words(texts)
        found, rows = shingles(hashes, offsets, self.n)
        counts = np.diff(offsets)
        out = self.short_matches(hashes, counts) if self.short else []
        hits = np.flatnonzero(self.known[(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.shingles, found[hits], "left"), np.searchsorted(self.shingles, found[hits], "right")
        real = hi > lo
        hits, lo, hi = hits[real], lo[real], hi[real]
        if not len(hits):
            return out
        row_start = np.searchsorted(rows, rows[hits])  # a row's first shingle
        times = hi - lo
        which = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        doc, item, at = np.repeat(rows[hits], times), self.rows[which], np.repeat(hits - row_start, times)
        order = np.lexsort((at, item, doc))
        doc, item, at, which = doc[order], item[order], at[order], which[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        group = np.cumsum(new) - 1
        size = np.minimum(self.size[item], counts[doc])
        m, whole = size - self.n + 1, self.size[item] - self.n + 1
        need = np.maximum(1, np.ceil(threshold * (m + whole) / (1 + threshold) - 1e-6).astype(np.int64))
        # runs of ``need`` hits that one window can hold, and the starts of all windows that do
        last = np.arange(len(at)) + need - 1
        inside = np.minimum(last, len(at) - 1)
        run = np.flatnonzero((last < len(at)) & (group[inside] == group) & (at[inside] - at < m))
        if not len(run):
            return out
        low = np.maximum(0, at[inside[run]] - m[run] + 1)
        high = np.minimum(at[run], (counts[doc] - size)[run])
        # runs of a group start in ascending order: each adds the starts after those of the run before
        again = group[run[1:]] == group[run[:-1]]
        low[1:] = np.where(again, np.maximum(low[1:], high[:-1] + 1), low[1:])
        times = np.maximum(0, high - low + 1)
        own = np.repeat(run, times)
        start = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        held = self.shared(group, at, doc, which, m, group[own], start)
        similar = held / (m[own] + whole[own] - held)
        keep = similar >= threshold - 1e-9
        own, start, similar = own[keep], start[keep], similar[keep]
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        edges = np.flatnonzero(np.diff(group[own], prepend=-1, append=-1))
        bases = np.searchsorted(rows, doc[own[edges[:-1]]])
        for x, y, base in zip(edges[:-1], edges[1:], bases.tolist(), strict=True):
            r, k, words_, w = int(doc[own[x]]), int(item[own[x]]), int(size[own[x]]), int(m[own[x]])
            shingles_ = found[base : base + int(counts[r])]
            # the most similar first, of equals the first in the text; a few fingerprints at a time
            ranked = x + np.lexsort((start[x:y], -similar[x:y]))
            for part in (ranked[:1], *(ranked[z : z + 256] for z in range(1, len(ranked), 256))):
                places = np.sort(start[part])
                prints = np.stack([window_prints(own_, places, w) for own_ in both(shingles_)], axis=1)
                near = set(places[within(prints, self.prints[k], self.radius)].tolist())
                for a in start[part].tolist():
                    s = weighted_similarity(np.unique(shingles_[a : a + w], return_counts=True), self.bags[k]) if a in near else 0.0
                    if s >= threshold:
                        best[r, k] = (s, a, words_)
                        break
                if (r, k) in best:
                    break
        return out + [(r, item, *v) for (r, item), v in best.items()]


def benchmark_parts(benchmark: DataFrame, item_col: str, text_col: str, part_bytes: int):
    """The items as broadcast (ids, texts), in parts of about ``part_bytes`` of text."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    for k in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        got = own.orderBy("item", "text").toPandas()
        yield benchmark.sparkSession.sparkContext.broadcast((got["item"].tolist(), got["text"].tolist()))


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 5, threshold: float = 0.8, radius: int = 40, part_bytes: int = 16 << 20) -> DataFrame:
    """Rows (id, item id, similarity, first word and words of the best window) at or over ``threshold``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} long, item_id long, similarity double, first_word long, n_words long"
    out = None
    for sent in benchmark_parts(benchmark, item_col, item_text_col, part_bytes):

        def run(batches, sent=sent):
            ids, texts = sent.value
            bench = Benchmark(ids, pa.array(texts, pa.string()), n, radius)
            for batch in batches:
                for part in slices(batch, "text"):
                    found = bench.matches(part.column("text"), threshold)
                    r = pa.array([f[0] for f in found], pa.int64())
                    yield part.column("id").take(r), [[ids[f[1]] for f in found], [f[2] for f in found], [f[3] for f in found], [f[4] for f in found]]

        one = map_columns(rows, schema, run)
        out = one if out is None else out.unionByName(one)
    return out


def without_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 5, threshold: float = 0.8, radius: int = 40, part_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``df`` without a passage of any item, as they are: judged and dropped where they lie, one by one."""
    for sent in benchmark_parts(benchmark, item_col, item_text_col, part_bytes):

        def run(batches, sent=sent):
            ids, texts = sent.value
            bench = Benchmark(ids, pa.array(texts, pa.string()), n, radius)
            for batch in batches:
                for part in slices(batch, text_col):
                    clean = np.ones(part.num_rows, bool)
                    clean[[f[0] for f in bench.matches(part.column(text_col), threshold)]] = False
                    yield part.filter(pa.array(clean))
            give_back()

        df = df.mapInArrow(run, df.schema)
    return df
