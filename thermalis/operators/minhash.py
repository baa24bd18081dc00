"""Similar texts by MinHash signatures, locality-sensitive bands and an exact check.

A text's set is its distinct five-word shingles (fewer words: the whole sequence as one), as 64-bit
hashes. Equal sets are folded into one, named by the least ``row_index`` that has it. A signature holds the least
value of the set under each of BANDS * ROWS hash functions; ROWS neighbours make a band, and two sets become a
candidate pair in the first band that they agree in, so each pair is met once. Every candidate pair is compared
exactly; no bucket is capped. At similarity s a pair is proposed with probability 1 - (1 - s ** ROWS) ** BANDS: more
than 0.9999 at 0.85, and the expected recall of pairs above is higher.

Sets are not sent along with each pair: representatives are dealt to blocks, a pair belongs to the tile of its two
blocks, and a set goes once to each tile that needs it. A tile holds two blocks at most.

Texts without words (null ones too) link with nothing. Long texts are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalis.functions import text
from thermalis.sources.scratch import saved

BANDS, ROWS = 20, 6
#: Words of texts hashed at a time inside a task; one longer text forms a slice of its own.
SLICE_WORDS = 1 << 19
#: Sets in a block, and bytes of their shingles, on average.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all others (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sets(words: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all rows, ascending inside a row; their row) from word hashes and the rows' ends."""
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    many = np.maximum(size - n + 1, (size > 0).astype(np.int64))
    row = np.repeat(np.arange(len(size)), many)
    first = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + starts[row]
    length = np.minimum(size[row], n)
    out = length.astype(np.uint64) * _GOLDEN
    for k in range(n):
        inside = k < length
        out = np.where(inside, _mix(out * _GOLDEN + words[np.minimum(first + k, max(0, len(words) - 1))]), out) if len(words) else out
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], row[new]


def _described(batch: pa.RecordBatch, n: int, bands: int, rows: int, seed: int) -> list[pa.Array]:
    """hi and lo (128 bits of the set), n, shingles and bands for each row of (row_index, words)."""
    lists = batch.column("words")
    words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    with np.errstate(over="ignore"):
        found, row = _sets(words, ends, n)
        count = np.bincount(row, minlength=batch.num_rows)
        filled = np.flatnonzero(count)
        starts = (np.cumsum(count) - count)[filled]
        rng = np.random.default_rng(seed)
        multiply = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        hi, lo = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
        keys = np.zeros((batch.num_rows, bands), np.uint64)
        if len(found):
            hi[filled] = np.add.reduceat(_mix(found), starts)
            lo[filled] = np.add.reduceat(_mix(found ^ _GOLDEN), starts)
            for b in range(bands):
                key = np.full(len(filled), np.uint64(b + 1))
                for k in range(b * rows, b * rows + rows):
                    key = _mix(key * _GOLDEN + np.minimum.reduceat(found * multiply[k] + add[k], starts))
                keys[filled, b] = key
    signed = lambda x: pa.array(x.view(np.int64))
    offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
    each = pa.array(np.arange(batch.num_rows + 1) * bands, pa.int32())
    return [signed(hi), signed(lo), pa.array(count, pa.int32()), pa.ListArray.from_arrays(offsets, signed(found)), pa.ListArray.from_arrays(each, signed(keys.ravel()))]


def described(df: DataFrame, text_col: str = "sentence", n: int = 5, bands: int = BANDS, rows: int = ROWS, seed: int = 42) -> DataFrame:
    """row_index, hi, lo, n, shingles and bands of every row."""
    words = F.transform(text.tokens(text.clean(F.col(text_col), ""), "alnum"), lambda w: F.xxhash64(w))
    kinds = "row_index long, hi long, lo long, n int, shingles array<long>, bands array<long>"

    def run(batches):
        for batch in batches:
            ends = np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_WORDS, side="right")))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column("row_index"), *_described(part, n, bands, rows, seed)], names=["row_index", "hi", "lo", "n", "shingles", "bands"])
                start = stop

    return df.select(F.col("row_index").cast("long").alias("row_index"), words.alias("words")).mapInArrow(run, kinds)


class SimilarTexts:
    """``members``: row_index, representative, size of the set and its copies; ``pairs``: row_index < other of representatives, with their similarity."""

    def __init__(self, members: DataFrame, pairs: DataFrame):
        self.members, self.pairs = members, pairs

    def rows(self) -> DataFrame:
        """One row for each text: its representative, the number of links to other sets and of links to other texts (copies counted)."""
        copies = self.members.groupBy("representative").agg(F.count("*").alias("copies"))
        ends = self.pairs.select(F.explode(F.array(F.struct(F.col("row_index").alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col("row_index").alias("b")))).alias("e")).select("e.*")
        linked = ends.join(copies, F.col("b") == F.col("representative")).groupBy(F.col("a").alias("representative")).agg(F.count("*").alias("set_links"), F.sum("copies").alias("text_links"))
        sums = copies.join(linked, "representative", "left")
        out = self.members.join(sums, "representative", "left")
        none = F.lit(0).cast("long")
        texts = F.when(F.col("n") == 0, none).otherwise(F.coalesce("text_links", none) + F.col("copies") - 1)
        return out.select("row_index", "representative", F.col("n").alias("n_shingles"), F.coalesce("set_links", none).alias("set_links"), texts.alias("text_links"))


def _first_agreement(a: Column, b: Column, band: Column) -> Column:
    """Whether no earlier band agrees."""
    return F.forall(F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), 1, band), lambda p: p["x"] != p["y"])


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b) with a < b for sets (representative, bands) that agree in some band, each pair once.

    Only sets that share a key with another carry their bands along.
    """
    keys = sets.select("representative", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("sharers")).where("sharers > 1").drop("sharers")
    sets = sets.join(keys.join(shared, ["band", "key"]).select("representative").distinct(), "representative", "left_semi")
    keyed = sets.select("representative", "bands", F.posexplode("bands").alias("band", "key"))
    left = keyed.select("band", "key", F.col("representative").alias("a"), F.col("bands").alias("x"))
    right = keyed.select("band", "key", F.col("representative").alias("b"), F.col("bands").alias("y"))
    met = left.join(right, ["band", "key"]).where((F.col("a") < F.col("b")) & _first_agreement(F.col("x"), F.col("y"), F.col("band")))
    return met.select("a", "b")


def blocks_for(sets: DataFrame) -> int:
    """Blocks that keep to BLOCK and BLOCK_BYTES."""
    return _blocks(*sets.agg(F.count("*"), F.sum(8 * F.size("shingles"))).first())


def _blocks(n: int, held: int | None) -> int:
    return max(1, -(-n // BLOCK), -(-(held or 0) // BLOCK_BYTES))


def compared(pairs: DataFrame, sets: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """The pairs whose sets' Jaccard similarity is at least ``threshold``, compared tile by tile."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    x, y = F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))
    tiled = pairs.select(x.alias("x"), y.alias("y"), "a", "b")
    needed = tiled.select(F.col("x").alias("of_x"), F.col("y").alias("of_y"), F.explode(F.array("a", "b")).alias("representative")).distinct()
    members = needed.join(sets.select("representative", "shingles"), "representative")

    def check(two: pa.Table, lists: pa.Table) -> pa.Table:
        of = dict(zip(lists.column("representative").to_pylist(), lists.column("shingles").combine_chunks(), strict=True)) if lists.num_rows else {}
        held: dict[int, np.ndarray] = {}
        out = ([], [], [])
        for a, b in sorted(zip(two.column("a").to_pylist(), two.column("b").to_pylist(), strict=True)):
            for r in (a, b):
                if r not in held:
                    held[r] = of[r].values.to_numpy()
            p, q = held[a], held[b]
            if min(len(p), len(q)) < threshold * max(len(p), len(q)):
                continue
            both = len(np.intersect1d(p, q, assume_unique=True))
            similarity = both / (len(p) + len(q) - both)
            if similarity >= threshold:
                for column, value in zip(out, (a, b, similarity), strict=True):
                    column.append(value)
        return pa.table({"row_index": pa.array(out[0], pa.int64()), "other": pa.array(out[1], pa.int64()), "similarity": pa.array(out[2], pa.float64())})

    return tiled.groupBy("x", "y").cogroup(members.groupBy("of_x", "of_y")).applyInArrow(check, "row_index long, other long, similarity double")


def similar_texts(df: DataFrame, text_col: str = "sentence", threshold: float = 0.85, n: int = 5, bands: int = BANDS, rows: int = ROWS, seed: int = 42) -> SimilarTexts:
    """All links of Jaccard similarity ``threshold`` or more that the bands propose."""
    found = saved(described(df, text_col, n, bands, rows, seed), "minhash")
    heads = found.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("row_index").alias("representative"))
    # texts without words stand for themselves
    members = found.select("row_index", "hi", "lo", "n").join(heads, ["hi", "lo", "n"], "left").select("row_index", F.coalesce("representative", "row_index").alias("representative"), "n")
    # shingles stay where they were written until a pair needs them
    heads = saved(heads.select("representative", "n"), "minhash-heads")
    bands_of = found.select(F.col("row_index").alias("representative"), "bands").join(heads.select("representative"), "representative", "left_semi")
    pairs = saved(candidates(bands_of), "minhash-pairs")
    sets = found.select(F.col("row_index").alias("representative"), "shingles")
    return SimilarTexts(members, compared(pairs, sets, threshold, _blocks(*heads.agg(F.count("*"), F.sum(8 * F.col("n"))).first())))
