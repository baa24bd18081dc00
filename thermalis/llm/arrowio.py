"""Arrow plumbing shared by the per-row operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; one longer text forms a slice of its own.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice holds more than about ``limit`` bytes of ``column``."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Return memory that a finished task left unused; the worker process lives on and waits for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Apply ``make()(texts) -> list of columns`` to whole texts, without a shuffle.

    ``make`` runs once per task and loads what the task needs. Null texts count as
    empty. The id column is carried through under the first name of ``schema``.
    """

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield part.column("id"), work(texts)

    return map_columns(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), schema, run)


def map_columns(df: DataFrame, schema: str, run: Callable) -> DataFrame:
    """mapInArrow for generators of (id array, list of further columns), typed by ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)
    if "id" in df.columns:  # the id keeps the type it has in the input
        kinds.fields[0].dataType = df.schema["id"].dataType
    arrow = to_arrow_schema(kinds)

    def outer(batches):
        for ids, columns in run(batches):
            cells = [ids, *columns]
            arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cells, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        give_back()

    return df.mapInArrow(outer, kinds)
