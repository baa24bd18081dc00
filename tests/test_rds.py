"""Data frames in R's serialised form, written and read back; bytes as R itself writes them."""

import bz2
import datetime as dt
import gzip
import lzma
import struct

import numpy as np
import pytest

from thermalis.sources import rds

SCHEMA = "a int, b long, c double, d string, e boolean, f date, g timestamp, h array<int>"


@pytest.fixture(autouse=True)
def _format(spark):
    rds.register(spark)


def test_round_trip(spark, tmp_path):
    moment = dt.datetime(2022, 5, 1, 12, 30, 15, 250000)
    rows = [(i, 1 << (i * 7), i / 7, f"é {i}" if i % 2 else "plain", i % 2 == 0, dt.date(1969, 12, 25) + dt.timedelta(days=i), moment, [i]) for i in range(9)] + [(None,) * 8]
    path = str(tmp_path / "frames")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.format("rds").mode("append").save(path)
    back = spark.read.format("rds").schema("d string, a int, b long, c double, e boolean, f date, g timestamp, h string, none int").load(path)
    got = sorted(((r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) for r in back.collect()), key=lambda r: (r[0] is None, r[0]))
    assert got == [(*r[:7], None if r[7] is None else f"[{r[7][0]}]") for r in rows]
    found = dict(spark.read.format("rds").load(path).dtypes)
    assert (found["a"], found["c"], found["d"], found["e"], found["f"], found["g"]) == ("int", "double", "string", "boolean", "date", "timestamp")


def test_long_parts_and_empty_tables(spark, tmp_path, monkeypatch):
    writer = rds.RdsWriter(spark.range(1).schema, {"path": "x"}, False)
    monkeypatch.setattr(rds, "FILE_ROWS", 4)
    assert [len(f) for f in writer.write_files(iter(range(10)))] == [4, 4, 2] and [len(f) for f in writer.write_files(iter([]))] == [0]
    path = str(tmp_path / "none")
    spark.createDataFrame([], "a int, b string").write.format("rds").mode("append").save(path)
    assert spark.read.format("rds").load(path).count() == 0 and spark.read.format("rds").load(path).columns == ["a", "b"]


def i4(*x):
    return struct.pack(f">{len(x)}i", *x)


def chars(t):
    return i4(rds.CHARS | rds.ASCII, len(t)) + t.encode()


def symbol(t):
    return i4(rds.SYMBOL) + chars(t)


def texts(*t):
    return i4(rds.STRINGS, len(t)) + b"".join(map(chars, t))


def frame_of_version_3():
    """list(k = compact 1:3, f = factor, x = wrapped doubles, s = deferred strings), with attributes that refer back."""
    end = i4(rds.NIL_VALUE)
    info = lambda name: i4(rds.PAIRS) + symbol(name) + i4(rds.PAIRS) + symbol("base") + i4(rds.PAIRS) + i4(rds.INTEGER, 1, 13) + end
    again = lambda name, base: i4(rds.PAIRS) + symbol(name) + i4(rds.PAIRS) + i4(base << 8 | rds.REFERENCE) + i4(rds.PAIRS) + i4(rds.INTEGER, 1, 14) + end
    compact = i4(rds.COMPACT) + info("compact_intseq") + i4(rds.REAL, 3) + struct.pack(">3d", 3, 1, 1) + end
    factor = i4(rds.INTEGER | rds.OBJECT | rds.ATTRIBUTES, 3, 2, -(1 << 31), 1) + i4(rds.PAIRS | rds.TAG) + symbol("levels") + texts("low", "high") + i4(rds.PAIRS | rds.TAG) + symbol("class") + texts("factor") + end
    wrapped = i4(rds.COMPACT) + again("wrap_real", 2) + i4(rds.LIST, 2) + i4(rds.REAL, 3) + struct.pack(">dqd", 1.5, 0x7FF00000000007A2, float("nan")) + i4(rds.INTEGER, 2, 0, 0) + end
    deferred = i4(rds.COMPACT) + again("deferred_string", 2) + i4(rds.PAIRS) + i4(rds.INTEGER, 3, 7, -(1 << 31), 9) + i4(rds.INTEGER, 1, 0) + end
    body = i4(rds.LIST | rds.OBJECT | rds.ATTRIBUTES, 4) + compact + factor + wrapped + deferred
    # class was the fourth symbol
    body += i4(rds.PAIRS | rds.TAG) + symbol("names") + texts("k", "f", "x", "s") + i4(rds.PAIRS | rds.TAG) + i4(4 << 8 | rds.REFERENCE) + texts("tbl_df", "tbl", "data.frame") + end
    return b"X\n" + i4(3, 0x00040301, 0x00030500, 5) + b"UTF-8" + body


@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, lzma.compress])
def test_forms_that_newer_versions_write(spark, tmp_path, pack):
    (tmp_path / "x.rds").write_bytes(pack(frame_of_version_3()))
    rows = spark.read.format("rds").load(str(tmp_path / "x.rds")).collect()
    assert [r.k for r in rows] == [1, 2, 3] and [r.f for r in rows] == ["high", None, "low"] and [r.s for r in rows] == ["7", None, "9"]
    assert rows[0].x == 1.5 and rows[1].x is None and np.isnan(rows[2].x)


def test_other_files_are_refused(tmp_path):
    for name, raw in (("text", b"hello"), ("vector", b"X\n" + i4(2, 0, 0) + i4(rds.INTEGER, 1, 5))):
        (tmp_path / f"{name}.rds").write_bytes(raw)
        with pytest.raises(ValueError):
            rds.read_frame(str(tmp_path / f"{name}.rds"))
