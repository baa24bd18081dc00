"""Data frames in R's serialised form (.rds): ``spark.read.format("rds")`` and ``df.write.format("rds")``.

Every file is a partition; its columns become Arrow arrays whole. Understood are files in XDR form of versions 2 and 3 (plain, gzip, bzip2
or xz): data frames of logical, integer, double and character columns, factors (as their labels), dates, times, 64-bit
integers of class ``integer64``, and the compact forms that newer versions write. NA becomes null. Without a
schema the first file gives names and types; a given schema is matched by name, and names that a file lacks are null.

Writing: every task writes files of at most ``FILE_ROWS`` rows, moved in place by the commit. Whole numbers that a double
cannot hold become ``integer64``; nested columns are written as JSON text.
"""

from __future__ import annotations

import bz2
import datetime as dt
import gzip
import io
import json
import lzma
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType, IntegralType, LongType, StructType, TimestampType

from thermalis.sources.files import PartWriter, files_below, store_of

FILE_ROWS = 1 << 20
# Type codes of the serialised form.
NIL, SYMBOL, PAIRS, CHARS, LOGICAL, INTEGER, REAL, STRINGS, LIST = 0, 1, 2, 9, 10, 13, 14, 16, 19
COMPACT, REFERENCE, NIL_VALUE, GLOBAL, BASE, EMPTY = 238, 255, 254, 253, 241, 242
OBJECT, ATTRIBUTES, TAG = 0x100, 0x200, 0x400
UTF8, ASCII = 1 << 15, 1 << 18
# End of fixed values.
_NA_INT, _NA_REAL = -(1 << 31), 0x7FF00000000007A2
_NA_LONG = -(1 << 63)


class Value:
    """A vector or list with its attributes."""

    def __init__(self, kind: int, data, attributes: dict | None = None):
        self.kind, self.data, self.attributes = kind, data, attributes or {}

    def texts(self, name: str) -> list[str]:
        found = self.attributes.get(name)
        return list(found.data) if found is not None and found.kind == STRINGS else []


class Reader:
    """The value of an open file."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.seen = raw, 0, []
        if self.raw[:2] != b"X\n":
            raise ValueError("not in R's XDR form")
        self.at = 2
        version = self.ints(3)[0]
        if version == 3:
            self.skip(int(self.ints(1)[0]))
        elif version != 2:
            raise ValueError(f"serialised form of version {version}")

    def skip(self, n: int) -> bytes:
        self.at += n
        return self.raw[self.at - n : self.at]

    def ints(self, n: int) -> np.ndarray:
        return np.frombuffer(self.skip(4 * n), ">i4")

    def length(self) -> int:
        n = int(self.ints(1)[0])
        if n != -1:
            return n
        high, low = self.ints(2).tolist()
        return (high << 32) + (low & 0xFFFFFFFF)

    def chars(self) -> str | None:
        flags, n = self.ints(2).tolist()
        return None if n == -1 else self.skip(n).decode("latin-1" if flags >> 12 & 4 else "utf-8")

    def attributes(self) -> dict:
        """A pair list as a dictionary."""
        out = {}
        while True:
            flags = int(self.ints(1)[0])
            if flags & 0xFF in (NIL, NIL_VALUE):
                return out
            if flags & 0xFF != PAIRS:  # a pair may end with any value
                self.at -= 4
                out[len(out)] = self.value()
                return out
            if flags & ATTRIBUTES:
                self.value()
            tag = self.value() if flags & TAG else None
            out[tag.data if tag is not None else len(out)] = self.value()

    def value(self) -> Value | None:
        flags = int(self.ints(1)[0])
        kind = flags & 0xFF
        if kind in (NIL, NIL_VALUE, GLOBAL, BASE, EMPTY):
            return None
        if kind == REFERENCE:
            return self.seen[(flags >> 8 or int(self.ints(1)[0])) - 1]
        if kind == SYMBOL:
            self.seen.append(Value(SYMBOL, self.chars()))
            return self.seen[-1]
        if kind == PAIRS:
            self.at -= 4
            return Value(PAIRS, self.attributes())
        if kind == COMPACT:
            return self.compact()
        if kind not in (LOGICAL, INTEGER, REAL, STRINGS, LIST):
            raise ValueError(f"no data frame: type {kind} in it")
        n = self.length()
        if kind in (LOGICAL, INTEGER):
            data = self.ints(n)
        elif kind == REAL:
            data = np.frombuffer(self.skip(8 * n), ">f8")
        else:
            data = [self.chars() if kind == STRINGS else self.value() for _ in range(n)]
        return Value(kind, data, self.attributes() if flags & ATTRIBUTES else None)

    def compact(self) -> Value:
        """Sequences kept as (length, start, step), and wrapped vectors."""
        info, state, more = self.value(), self.value(), self.value()
        name = info.data[0].data
        if name in ("compact_intseq", "compact_realseq"):
            n, start, step = map(float, state.data)
            data = start + step * np.arange(int(n))
            return Value(INTEGER, data.astype(np.int64)) if name == "compact_intseq" else Value(REAL, data)
        if name.startswith("wrap_"):
            held = state.data[0] if state.kind in (LIST, PAIRS) else state
            return Value(held.kind, held.data, held.attributes | (more.data if more is not None and more.kind == PAIRS else {}))
        if name == "deferred_string":
            held = state.data[0]
            whole = held.kind == INTEGER
            return Value(STRINGS, [None if whole and x == _NA_INT else str(int(x)) if float(x).is_integer() else repr(float(x)) for x in held.data.tolist()])
        raise ValueError(f"compact form {name}")


def _column(v: Value) -> pa.Array:
    classes = v.texts("class")
    if v.kind == STRINGS:
        return pa.array(v.data, pa.string())
    if v.kind == LOGICAL:
        return pa.array(v.data != 0, pa.bool_(), mask=v.data == _NA_INT)
    if v.kind == INTEGER:
        missing = np.asarray(v.data == _NA_INT)
        if "factor" in classes:
            labels = pa.array(v.texts("levels"), pa.string())
            return labels.take(pa.array(np.where(missing, 1, v.data).astype(np.int64) - 1, mask=missing))
        numbers = pa.array(v.data.astype(np.int32), pa.int32(), mask=missing)
        return numbers.cast(pa.date32()) if "Date" in classes else numbers
    if v.kind != REAL:
        raise ValueError("a column that is no plain vector")
    bits = v.data.view(">i8").astype(np.int64)
    if "integer64" in classes:
        return pa.array(bits, pa.int64(), mask=bits == _NA_LONG)
    # what an arithmetic unit made of NA has its quiet bit set
    missing = (bits & ~(1 << 51)) == _NA_REAL
    data = v.data.astype(np.float64)
    if "Date" in classes or "POSIXct" in classes:
        missing |= ~np.isfinite(data)
        data = np.where(missing, 0, data)
        if "Date" in classes:
            return pa.array(np.floor(data).astype(np.int32), pa.int32(), mask=missing).cast(pa.date32())
        return pa.array(np.round(data * 1e6).astype(np.int64), pa.int64(), mask=missing).cast(pa.timestamp("us", "UTC"))
    return pa.array(data, pa.float64(), mask=missing)


def read_frame(path: str) -> pa.Table:
    """A file's data frame."""
    store, at = store_of(path)
    with store.open_input_file(at) as f:
        raw = f.read()
    for magic, opened in ((b"\x1f\x8b", gzip), (b"BZh", bz2), (b"\xfd7zXZ", lzma)):
        if raw.startswith(magic):
            raw = opened.decompress(raw)
    frame = Reader(raw).value()
    if frame is None or frame.kind != LIST or "data.frame" not in frame.texts("class"):
        raise ValueError(f"no data frame in {path}")
    return pa.Table.from_arrays([_column(c) for c in frame.data], names=frame.texts("names"))


class FilePart(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class RdsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.kinds, self.options = schema, options

    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for p in files_below(self.options["path"], ".rds")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        table, wanted = read_frame(partition.path), to_arrow_schema(self.kinds)
        columns = [table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in wanted]
        yield from pa.Table.from_arrays(columns, schema=wanted).to_batches(max_chunksize=65_536)


class _Writer:
    """Bytes of the serialised form."""

    def __init__(self, out):
        self.out, self.symbols = out, {}

    def ints(self, *x: int) -> None:
        self.out.write(struct.pack(f">{len(x)}i", *x))

    def chars(self, text: str | None) -> None:
        if text is None:
            self.ints(CHARS, -1)
            return
        raw = text.encode()
        self.ints(CHARS | (ASCII if raw.isascii() else UTF8), len(raw))
        self.out.write(raw)

    def strings(self, texts: list) -> None:
        self.ints(STRINGS, len(texts))
        for t in texts:
            self.chars(t)

    def attributes(self, found: dict) -> None:
        for name, put in found.items():
            self.ints(PAIRS | TAG)
            if name in self.symbols:
                self.ints(self.symbols[name] << 8 | REFERENCE)
            else:
                self.symbols[name] = len(self.symbols) + 1
                self.ints(SYMBOL)
                self.chars(name)
            put()
        self.ints(NIL_VALUE)

    def column(self, values: list, kind) -> None:
        if isinstance(kind, BooleanType):
            self.numbers(LOGICAL, np.array([_NA_INT if v is None else int(v) for v in values], ">i4"))
        elif isinstance(kind, IntegralType) and not isinstance(kind, LongType):
            self.numbers(INTEGER, np.array([_NA_INT if v is None else v for v in values], ">i4"))
        elif isinstance(kind, LongType) and any(v is not None and abs(v) > 1 << 53 for v in values):
            self.numbers(REAL, np.array([_NA_LONG if v is None else v for v in values], ">i8"), ["integer64"])
        elif isinstance(kind, LongType | DoubleType | FloatType):
            self.reals(values)
        elif isinstance(kind, DateType):
            self.reals([v and (v - dt.date(1970, 1, 1)).days for v in values], ["Date"])
        elif isinstance(kind, TimestampType):
            self.reals([v and v.timestamp() for v in values], ["POSIXct", "POSIXt"])
        else:
            self.strings([v if v is None or isinstance(v, str) else json.dumps(v.asDict(True) if hasattr(v, "asDict") else v, default=str, ensure_ascii=False) for v in values])

    def reals(self, values: list, classes: list[str] | None = None) -> None:
        data = np.array([0.0 if v is None else v for v in values], np.float64).view(np.int64)
        data[[v is None for v in values]] = _NA_REAL
        self.numbers(REAL, data.astype(">i8"), classes)

    def numbers(self, kind: int, data: np.ndarray, classes: list[str] | None = None) -> None:
        self.ints(kind | (OBJECT | ATTRIBUTES if classes else 0), len(data))
        self.out.write(data.tobytes())
        if classes:
            self.attributes({"class": lambda: self.strings(classes)})

    def frame(self, names: list[str], kinds: list, rows: list) -> None:
        self.out.write(b"X\n")
        self.ints(2, 0x00030000, 0x00020300)
        self.ints(LIST | OBJECT | ATTRIBUTES, len(names))
        for i, kind in enumerate(kinds):
            self.column([r[i] for r in rows], kind)
        self.attributes(
            {
                "names": lambda: self.strings(names),
                "class": lambda: self.strings(["data.frame"]),
                "row.names": lambda: self.numbers(INTEGER, np.array([_NA_INT, -len(rows)], ">i4")),
            }
        )


class RdsWriter(PartWriter):
    suffix = ".rds"

    def write_files(self, rows: Iterator) -> Iterator[list]:
        yield list(islice(rows, FILE_ROWS))
        while more := list(islice(rows, FILE_ROWS)):
            yield more

    def write_part(self, out, rows: list) -> None:
        buffer = io.BytesIO()
        _Writer(buffer).frame(self.names, [f.dataType for f in self.kinds], rows)
        out.write(gzip.compress(buffer.getvalue(), 6))


class RdsFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rds"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        files = files_below(self.options["path"], ".rds")
        if not files:
            raise ValueError(f"no .rds file in {self.options['path']}")
        return from_arrow_schema(read_frame(files[0]).schema)

    def reader(self, schema: StructType) -> RdsReader:
        return RdsReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RdsWriter:
        return RdsWriter(schema, dict(self.options), overwrite).begin()


def register(spark) -> None:
    """Make ``rds`` a format of this session."""
    spark.dataSource.register(RdsFiles)
