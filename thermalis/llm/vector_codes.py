"""Product codes for vectors: one small codebook for each part position, fitted by Lloyd's rounds on all vectors.

A component x counts as the integer floor(4096 * x). A vector is cut into ``PARTS`` equal
consecutive parts; each part position has a codebook of at most ``ENTRIES`` entries, which
starts as that part of the vectors with the smallest ids. A round assigns every part to the nearest
entry of its codebook (squared Euclidean distance, ties to the lower index) and replaces each entry by
the componentwise floor of its parts' mean; unused entries stay.

Heap Lloyd: what a task holds is blocks of vectors, each with a heap per codebook entry. A
heap orders the parts assigned to its entry by slack: the lower bound of the distance to any other entry minus the upper
bound of that to their own, plus what the entry's bounds had drifted when the part was put
there. After an update only the parts at the top of a heap whose key the cumulative drift has
reached can have changed sides; they are popped, compared exactly with all entries, and
put in the heap of the entry found. All others are not looked at. Keys are rounded down
and drifts up, so rounding costs a comparison and never an assignment.

Between rounds the blocks (vectors as small integers, codes, heaps) are a written table in the
shared folder, and what leaves a block is the change of its entries' sums and counts: PARTS * ENTRIES *
(1 + part length) numbers, added up by Spark. All sums are integers, so results do not depend on
how rows are dealt to blocks. Nothing is shuffled but those sums and the errors by label.

Dropped: vectors that are null, empty, or hold null or non-finite components; and vectors whose length is not a
multiple of PARTS or differs from that of the smallest id kept. Null ids are kept and come last among the ids;
repeated ids are ordered by their vectors. With fewer than ENTRIES vectors codebooks have as many entries as there are. Components so
large that squared distances would not fit 64 bits (beyond some 10**4 at 64 components) are an error. An empty
table gives no rows. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalis.llm.arrowio import give_back
from thermalis.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Components are integers of this fraction.
SCALE = 4096
#: Vectors in a block; a heap's item holds the row in this many low bits.
ROW_BITS = 14
BLOCK = 1 << ROW_BITS
#: Keys and drifts are counted in this fraction of a component's unit.
FINE = 256
_FAR = 1 << 40


def usable(vector: Column) -> Column:
    """Whether a vector has components, and all of them finite numbers."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def quantised(values: np.ndarray) -> np.ndarray:
    """Integer components; refuses vectors whose exact distances would not fit 64 bits."""
    whole = np.floor(values * float(SCALE))
    if whole.size and float(np.abs(whole).max()) ** 2 * 4 * whole.shape[1] >= 2.0**62:
        raise OverflowError("components too large for exact distances in 64 bits")
    return whole.astype(np.int64)


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all ``parts`` to all ``entries``."""
    return ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the lowest nearest entry, a whole number of FINE units not above the slack) of each part."""
    far = squared(parts, entries)
    found = far.argmin(axis=1)
    if len(entries) == 1:
        return found, np.full(len(parts), _FAR, np.int64)
    two = np.partition(far, 1, axis=1)[:, :2]
    return found, np.floor((np.sqrt(two[:, 1]) - np.sqrt(two[:, 0])) * FINE).astype(np.int64) - 1


class Block:
    """Vectors with their codes and, for each part position and entry, a heap of packed (key, row)."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, heaps: list):
        self.vectors, self.codes, self.heaps = vectors, codes, heaps

    @classmethod
    def first(cls, vectors: np.ndarray, books: np.ndarray) -> tuple[Block, np.ndarray]:
        """Everything assigned by comparison, and the sums that this makes."""
        n, parts, entries = len(vectors), *books.shape[:2]
        block = cls(vectors, np.empty((parts, n), np.uint8), [])
        change = np.zeros((parts, entries, 1 + books.shape[2]), np.int64)
        for p in range(parts):
            own = block.part(p)
            found, slack = nearest(own, books[p])
            block.codes[p] = found
            items = (slack << ROW_BITS) | np.arange(n)
            for e in range(entries):
                heap = items[found == e].tolist()
                heapq.heapify(heap)
                block.heaps.append(heap)
            block.count(change, p, found, own, 1)
        return block, change

    def part(self, p: int, rows=slice(None)) -> np.ndarray:
        width = self.vectors.shape[1] // len(self.codes)
        return self.vectors[rows, p * width : (p + 1) * width].astype(np.int64)

    @staticmethod
    def count(change: np.ndarray, p: int, entry: np.ndarray, parts: np.ndarray, sign: int) -> None:
        np.add.at(change[p, :, 0], entry, sign)
        np.add.at(change[p, :, 1:], entry, sign * parts)

    def again(self, books: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, int]:
        """Pop and compare what the drift has reached; the change of sums, and how many parts that were."""
        parts, entries = books.shape[:2]
        change, popped = np.zeros((parts, entries, 1 + books.shape[2]), np.int64), 0
        for p in range(parts):
            rows = []
            for e in range(entries):
                heap, limit = self.heaps[p * entries + e], int(drift[p, e])
                if len(heap) and int(heap[0]) >> ROW_BITS <= limit:
                    heap = self.opened(p * entries + e)
                    while heap and heap[0] >> ROW_BITS <= limit:
                        rows.append(heapq.heappop(heap) & (BLOCK - 1))
            if not rows:
                continue
            popped += len(rows)
            rows = np.array(rows)
            own, old = self.part(p, rows), self.codes[p][rows].astype(np.int64)
            found, slack = nearest(own, books[p])
            items = ((slack + drift[p][found]) << ROW_BITS) | rows
            for e, item in zip(found.tolist(), items.tolist(), strict=True):
                heapq.heappush(self.opened(p * entries + e), item)
            moved = found != old
            self.codes[p][rows] = found
            self.count(change, p, old[moved], own[moved], -1)
            self.count(change, p, found[moved], own[moved], 1)
        return change, popped

    def opened(self, i: int) -> list:
        """A heap as a list; heaps that nothing touches stay arrays."""
        if not isinstance(self.heaps[i], list):
            self.heaps[i] = self.heaps[i].tolist()
        return self.heaps[i]

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distance of each vector to its entries, summed over parts."""
        return sum(((self.part(p) - books[p][self.codes[p]]) ** 2).sum(axis=1) for p in range(len(books)))

    # a block as cells of a table

    def cells(self) -> tuple[bytes, int, bytes, bytes, list[int]]:
        most = int(np.abs(self.vectors).max()) if self.vectors.size else 0
        kind = np.dtype("<i2") if most < 1 << 15 else np.dtype("<i4") if most < 1 << 31 else np.dtype("<i8")
        heaps = [np.array(h, "<i8") for h in self.heaps]
        return self.vectors.astype(kind).tobytes(), kind.itemsize, self.codes.tobytes(), b"".join(h.tobytes() for h in heaps), [len(h) for h in heaps]

    @classmethod
    def of(cls, row: dict, parts: int) -> Block:
        n = len(row["codes"]) // parts
        vectors = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(n, -1)
        items, ends = np.frombuffer(row["heaps"], "<i8"), np.cumsum(row["sizes"])
        return cls(vectors, np.frombuffer(row["codes"], np.uint8).reshape(parts, n).copy(), [items[b - s : b] for s, b in zip(row["sizes"], ends, strict=True)])


_STATE = ["vectors", "width", "codes", "heaps", "sizes", "change", "popped"]


def _state_kind(found: DataFrame):
    from pyspark.sql.types import ArrayType, StructField, StructType

    carried = [StructField(f.name, ArrayType(f.dataType)) for f in found.schema.fields[:2]]
    return StructType([*carried, *StructType.fromDDL("vectors binary, width int, codes binary, heaps binary, sizes array<int>, change array<long>, popped long").fields])


def _one(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """A whole column as one cell that holds a list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.cast(kind.value_type)).cast(kind)


def _written(block: Block, change: np.ndarray, popped: int, carried: list[pa.Array], arrow: pa.Schema) -> pa.RecordBatch:
    cells = [*block.cells(), change.ravel().tolist(), popped]
    return pa.RecordBatch.from_arrays([*carried, *[pa.array([c], f.type) for c, f in zip(cells, list(arrow)[2:], strict=True)]], schema=arrow)


def _totals(state: DataFrame, shape: tuple) -> tuple[np.ndarray, int]:
    """Changes of all blocks added up: as many numbers as the codebooks have, twice at most."""
    added = state.select(F.posexplode("change").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(math.prod(shape), np.int64)
    for r in added:
        out[r["at"]] = r["x"]
    return out.reshape(shape), state.agg(F.sum("popped")).first()[0] or 0


def _updated(books: np.ndarray, totals: np.ndarray) -> np.ndarray:
    out = books.copy()
    for p, e in np.argwhere(totals[:, :, 0] > 0):
        out[p, e] = totals[p, e, 1:] // totals[p, e, 0]
    return out


def _drifted(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each entry: how far it moved, and how far the others of its codebook did at most; whole FINE units, rounded up."""
    moved = np.sqrt(((after - before) ** 2).sum(axis=2).astype(np.float64))
    others = np.zeros_like(moved)
    for e in range(moved.shape[1]):
        rest = np.delete(moved, e, axis=1)
        others[:, e] = rest.max(axis=1) if rest.shape[1] else 0
    return np.where(moved + others > 0, np.ceil((moved + others) * FINE).astype(np.int64) + 1, 0)


class Codes:
    """``rows``: id, label, code and error of each vector; ``books``: the final entries by part and entry; ``compared``: parts compared with all entries in each pass."""

    def __init__(self, rows: DataFrame, books: np.ndarray, compared: list[int]):
        self.rows, self.books, self.compared = rows, books, compared

    def digest(self) -> str:
        """Of all components of the codebooks by part, entry and position, decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codebooks fitted to all vectors, and each vector's code (two hexadecimal digits a part) and squared error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    scratch = Scratch(df.sparkSession)
    found = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    found = found.where(usable(F.col("v")) & (F.size("v") % parts == 0))

    def smallest(rows: DataFrame) -> list:
        return rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()

    seeds = smallest(found)
    dims = len(seeds[0]["v"]) if seeds else parts
    if any(len(s["v"]) != dims for s in seeds):
        seeds = smallest(found.where(F.size("v") == dims))
    found = found.where(F.size("v") == dims)
    books = quantised(np.array([s["v"] for s in seeds], np.float64).reshape(len(seeds), dims)).reshape(-1, parts, dims // parts).transpose(1, 0, 2).copy()
    result = StructType(found.schema.fields[:2]).add("code", "string").add("error", "long")
    if not seeds:
        return Codes(df.sparkSession.createDataFrame([], result), books, [])
    shape = (parts, books.shape[1], 1 + dims // parts)
    kinds = _state_kind(found)
    arrow, result_arrow = to_arrow_schema(kinds), to_arrow_schema(result)

    def assign(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(start, BLOCK)
                vectors = quantised(rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                block, change = Block.first(vectors, books)
                yield _written(block, change, len(vectors) * parts, [_one(rows.column(i), arrow.field(i).type) for i in (0, 1)], arrow)
        give_back()

    def again(now, drift, last):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in _STATE if c != "change"}
                    block = Block.of(row, parts)
                    change, popped = block.again(now, drift)
                    carried = [batch.column(c).slice(i, 1) for c in (0, 1)]
                    if not last:
                        yield _written(block, change, popped, carried, arrow)
                        continue
                    table = np.array([f"{e:02x}" for e in range(shape[1])])
                    code = ["".join(c) for c in table[block.codes.T].tolist()]
                    cells = [*[c.flatten() for c in carried], pa.array(code), pa.array(block.errors(now))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, result_arrow, strict=True)], schema=result_arrow)
            give_back()

        return run

    state = scratch.save(found.mapInArrow(assign, kinds))
    totals, popped = _totals(state, shape)
    compared, drift = [popped], np.zeros(shape[:2], np.int64)
    for r in range(rounds):
        after = _updated(books, totals)
        drift, books = drift + _drifted(books, after), after
        if r < rounds - 1:
            following = scratch.save(state.mapInArrow(again(books, drift, False), kinds))
            scratch.drop(state)
            state = following
            change, popped = _totals(state, shape)
            totals += change
            compared.append(popped)
    rows = scratch.save(state.mapInArrow(again(books, drift, True), result))
    scratch.drop(state)
    return Codes(rows, books, compared)


def with_label_errors(codes: Codes, id_col: str = "vec_id") -> DataFrame:
    """id, code, error, ``label_error`` (summed over equal labels, nulls together) and the digest of the codebooks."""
    sums = codes.rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = codes.rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
