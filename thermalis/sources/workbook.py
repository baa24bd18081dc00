"""Workbooks (.xlsx) as a data source: ``spark.read.format("workbook")`` and ``df.write.format("workbook")``.

Reading: a path, or a folder of workbooks; every file is a partition, or every sheet with option ``sheets`` = ``all`` (else the sheet
named by option ``sheet``, else the first). The first row holds the names. Without a schema, columns whose first ``SAMPLE`` values are all numbers are
doubles, all truth values booleans, others strings. Values are matched to a given schema by name; names that a sheet lacks are null.

Writing: every task writes workbooks of its own below a folder of the job, and the commit moves them in
place and adds ``_SUCCESS``; an aborted job removes its folder. Sheets hold at most ``SHEET_ROWS`` rows, so large
parts have several. Nested columns are written as JSON text, dates and times as ISO text; characters that XML cannot hold are
escaped as the format prescribes, so texts come back as they were (empty texts come back empty, nulls null).
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType, IntegralType, StringType, StructType, TimestampNTZType, TimestampType

from thermalis.sources.files import PartWriter, files_below, store_of

SHEET_ROWS, SAMPLE = 1_048_575, 100
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\r]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def _column(reference: str) -> int:
    """A1, B7, AA3, ... as 0, 1, 26, ..."""
    out = 0
    for c in re.match("[A-Z]+", reference)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def _letters(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


def _text(node) -> str:
    """All text runs of a string, without phonetic hints."""
    runs = [t.text or "" for child in node for t in ([child] if child.tag == f"{{{_MAIN}}}t" else child.findall(f"{{{_MAIN}}}t") if child.tag == f"{{{_MAIN}}}r" else [])]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(runs))


class Book:
    """An open workbook."""

    def __init__(self, path: str):
        store, at = store_of(path)
        self.file = store.open_input_file(at)
        self.zip = zipfile.ZipFile(self.file)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): place(targets[s.get(f"{{{_REL}}}id")]) for s in sheets}

    def __enter__(self) -> Book:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.file.close()

    def shared(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        out = []
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{{{_MAIN}}}si":
                    out.append(_text(node))
                    node.clear()
        return out

    def rows(self, sheet: str) -> Iterator[list]:
        """Rows of a sheet, one at a time: numbers, truth values, texts; empty and faulty cells are None."""
        shared = self.shared()
        with self.zip.open(self.sheets[sheet]) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{{{_MAIN}}}row":
                    continue
                row: list = []
                for cell in node.findall(f"{{{_MAIN}}}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(row)
                    row.extend([None] * (at + 1 - len(row)))
                    row[at] = self.value(cell, shared)
                yield row
                node.clear()

    @staticmethod
    def value(cell, shared: list[str]):
        kind, v, inline = cell.get("t", "n"), cell.findtext(f"{{{_MAIN}}}v"), cell.find(f"{{{_MAIN}}}is")
        if kind == "inlineStr":
            return _text(inline) if inline is not None else None
        if v is None or kind == "e":
            return None
        if kind == "s":
            return shared[int(v)]
        if kind == "b":
            return v == "1"
        if kind == "n":
            return int(v) if re.fullmatch(r"-?\d+", v) else float(v)
        return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), v)


def _fitted(value, kind):
    """A cell's value as a value of a Spark type; what does not fit is null."""
    if value is None or isinstance(kind, StringType):
        return value if value is None or isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
    try:
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}.get(str(value).strip().lower())
        if isinstance(kind, IntegralType):
            return int(value) if not isinstance(value, float) or value.is_integer() else None
        if isinstance(kind, DoubleType | FloatType):
            return float(value)
        if isinstance(kind, DateType | TimestampType | TimestampNTZType):
            moment = dt.datetime.fromisoformat(value.strip()) if isinstance(value, str) else dt.datetime(1899, 12, 30) + dt.timedelta(days=value)
            return moment.date() if isinstance(kind, DateType) else moment
    except (ValueError, OverflowError):
        return None
    raise TypeError(f"workbooks hold no {kind.simpleString()}")


class SheetPart(InputPartition):
    def __init__(self, path: str, sheet: str):
        super().__init__((path, sheet))
        self.path, self.sheet = path, sheet


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.kinds, self.options = schema, options

    def partitions(self) -> list[SheetPart]:
        out = []
        for path in files_below(self.options["path"], ".xlsx"):
            with Book(path) as book:
                names = list(book.sheets)
            chosen = names if self.options.get("sheets") == "all" else [self.options.get("sheet", names[0])]
            out += [SheetPart(path, n) for n in chosen]
        return out

    def read(self, partition: SheetPart) -> Iterator[tuple]:
        with Book(partition.path) as book:
            rows = book.rows(partition.sheet)
            at = {name: i for i, name in enumerate(next(rows, []))}
            places = [(at.get(f.name, math.inf), f.dataType) for f in self.kinds]
            for row in rows:
                yield tuple(_fitted(row[i], kind) if i < len(row) else None for i, kind in places)


class WorkbookWriter(PartWriter):
    suffix = ".xlsx"

    def _cell(self, value, at: str) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, int | float) and math.isfinite(value) and (not isinstance(value, int) or abs(value) < 1 << 53):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        if isinstance(value, dt.date):
            value = value.isoformat()
        elif isinstance(value, list | tuple | dict):
            value = json.dumps(value.asDict(True) if hasattr(value, "asDict") else value, default=str, ensure_ascii=False)
        text = _UNFIT.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value))
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    def _row(self, number: int, values) -> bytes:
        cells = "".join(self._cell(v, f"{_letters(i)}{number}") for i, v in enumerate(values))
        return f'<row r="{number}">{cells}</row>'.encode()

    def write_part(self, out, rows: Iterator) -> None:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            sheets, row = 0, next(rows, None)
            while row is not None or not sheets:
                sheets += 1
                with z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as f:
                    f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode() + self._row(1, self.names))
                    number = 1
                    while row is not None and number <= SHEET_ROWS:
                        number += 1
                        f.write(self._row(number, row))
                        row = next(rows, None)
                    f.write(b"</sheetData></worksheet>")
            self._frame(z, sheets)

    @staticmethod
    def _frame(z: zipfile.ZipFile, sheets: int) -> None:
        """The parts of a workbook beside its sheets."""
        head, each = '<?xml version="1.0" encoding="UTF-8"?>', range(1, sheets + 1)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in each)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{overrides}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="Sheet{i}" sheetId="{i}" r:id="rId{i}"/>' for i in each)
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in each)
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACK}/relationships">{links}</Relationships>')


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        """Names of the first sheet; types by its first rows."""
        files = files_below(self.options["path"], ".xlsx")
        if not files:
            raise ValueError(f"no workbook in {self.options['path']}")
        with Book(files[0]) as book:
            rows = book.rows(self.options.get("sheet", next(iter(book.sheets))))
            names, sample = next(rows, []), [r for r, _ in zip(rows, range(SAMPLE), strict=False)]
        out = StructType()
        for i, name in enumerate(names):
            values = [r[i] for r in sample if i < len(r) and r[i] is not None]
            truth, number = (bool(values) and all(isinstance(v, kind) for v in values) for kind in (bool, int | float))
            out.add(name, BooleanType() if truth else DoubleType() if number else StringType())
        return out

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, dict(self.options), overwrite).begin()


def register(spark) -> None:
    """Make ``workbook`` a format of this session."""
    spark.dataSource.register(Workbooks)
