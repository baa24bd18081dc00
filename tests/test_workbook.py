"""Workbooks written, read back, aborted; files as other programs write them."""

import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from thermalis.sources import workbook

SCHEMA = "a long, b double, c string, d boolean, e date, f array<int>"


@pytest.fixture(autouse=True)
def _format(spark):
    workbook.register(spark)


def test_round_trip(spark, tmp_path):
    texts = ["plain", "", None, " blanks ", "<&\"'>", "line\nbreak\r\ttab", "\x01\x0b_x0041_", "é 语 \U0001f642", "_x", "12", "true"]
    rows = [(i if i != 3 else None, i / 3, t, i % 2 == 0, dt.date(2020, 1, 1 + i), [i]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = str(tmp_path / "book")
    df.write.format("workbook").mode("append").save(path)
    names = os.listdir(path)
    assert "_SUCCESS" in names and not any(n.startswith("_job") for n in names)
    back = spark.read.format("workbook").schema("c string, a long, b double, d boolean, e date, f string, missing int").load(path)
    got = sorted(((r.a, r.b, r.c, r.d, r.e, r.f) for r in back.collect()), key=lambda r: r[1])
    assert got == [(a, b, c, d, e, f"[{f[0]}]") for a, b, c, d, e, f in rows]
    assert back.where("missing is not null").count() == 0
    assert dict(spark.read.format("workbook").load(path).dtypes)["b"] == "double"
    df.limit(2).write.format("workbook").mode("overwrite").save(path)
    assert spark.read.format("workbook").load(path).count() == 2


def test_numbers_too_large_for_a_cell_stay_exact(spark, tmp_path):
    path = str(tmp_path / "book")
    values = [1 << 60, -(1 << 62), (1 << 53) + 1, 7]
    spark.createDataFrame([(v, float(v), float("nan"), 1e-300) for v in values], "a long, b double, c double, d double").write.format("workbook").mode("append").save(path)
    got = spark.read.format("workbook").schema("a long, b double, c string, d double").load(path).collect()
    assert sorted(r.a for r in got) == sorted(values) and {r.c for r in got} == {"nan"} and {r.d for r in got} == {1e-300}


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "book")
    df = spark.range(0, 100, 1, 4).withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")))
    with pytest.raises(Exception, match="broken"):
        df.write.format("workbook").mode("append").save(path)
    assert not [n for n in os.listdir(path) if not n.startswith(".")] if os.path.exists(path) else True


def test_sheets_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "empty")
    spark.createDataFrame([], "a long, b string").write.format("workbook").mode("append").save(path)
    assert spark.read.format("workbook").load(path).columns == ["a", "b"] and spark.read.format("workbook").load(path).count() == 0


def test_shared_strings_gaps_and_several_sheets(spark, tmp_path):
    m, r = workbook._MAIN, workbook._REL
    path = str(tmp_path / "other.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="one" sheetId="1" r:id="x1"/><sheet name="two" sheetId="2" r:id="x2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x1" Target="worksheets/a.xml"/><Relationship Id="x2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>x</t></rPh></si></sst>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="str"><v>n</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2.5</v></c></row><row r="3"><c r="C3" t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{m}"><sheetData><row><c t="s"><v>0</v></c></row><row><c t="b"><v>1</v></c></row></sheetData></worksheet>')
    one = spark.read.format("workbook").schema("name string, n double").load(path)
    assert [tuple(r) for r in one.collect()] == [("rich", 2.5), (None, None)]
    every = spark.read.format("workbook").option("sheets", "all").schema("name string, n double").load(path)
    assert every.rdd.getNumPartitions() == 2 and sorted(map(str, (r.name for r in every.collect()))) == ["None", "rich", "true"]
    assert [r.name for r in spark.read.format("workbook").option("sheet", "two").load(path).collect()] == [True]


def test_letters():
    assert [workbook._letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbook._column(workbook._letters(i) + "9") == i for i in range(20_000))
