"""Spreadsheet workbooks (.xlsx) as a Spark data source (SRC2-SRC4).

Reading: ``spark.read.format("workbook")`` plans one partition per workbook, sheet and range of
rows. A task finds its sheet through the ZIP directory and the workbook's list of sheets and streams
the sheet's XML, so no sheet is held whole; a range is skipped to, and reading stops behind it. A folder is read as all its workbooks.
Options: ``sheet`` (name, or number from 0; default 0), ``header`` (default true), ``rowsPerPartition``. With a schema, its
fields are found by the header's trimmed names (without a header: by position); a field the sheet lacks is an error and a
cell that does not fit its field is NULL. Without one every column is text.

Cells: shared, rich and inline strings, formula results, numbers, booleans, dates (by number format or ISO text, both
calendars) and empty cells; an error cell (#N/A, ...) is NULL. Rows and cells may lack their references. Rows without
any cell are skipped, as blank lines of a sheet are.

Writing: ``write_workbook`` takes a DataFrame per sheet. Each task writes workbooks of its own, of at most
``MAX_ROWS`` rows a sheet, under new names; the list of finished files is put in place last, so files of failed or
repeated tasks are never read.

The module needs nothing else of this package and is shipped to the workers by value. Paths are those ``pyarrow.fs``
reaches (local, HDFS, object stores).
"""

from __future__ import annotations

import datetime as dt
import json
import re
import sys
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "workbook"
MAX_ROWS = 1_048_576  # of a sheet, header included (the format's limit)
ROWS_PER_PARTITION = 100_000
BATCH_ROWS = 5_000
MANIFEST = "_workbooks.json"

# fixed values of the format: number formats that are dates or times, and the first days of its two calendars
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_EPOCH, _EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"

_CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_UNFIT = re.compile("_(?=x[0-9A-Fa-f]{4}_)|[\x00-\x08\x0b-\x1f\ufffe\uffff]")


def _fs(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[6:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def workbook_files(path: str) -> list[str]:
    """The workbook at ``path``, or those of the folder: the ones on its list, or all if it has none."""
    from pyarrow import fs

    system, name = _fs(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    if system.get_file_info(f"{name}/{MANIFEST}").type == fs.FileType.File:
        with system.open_input_file(f"{name}/{MANIFEST}") as f:
            found = json.loads(f.read())
    else:
        found = [i.base_name for i in system.get_file_info(fs.FileSelector(name)) if i.base_name.endswith(".xlsx") and i.base_name[0] not in "_.~"]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(found)]


class Workbook:
    """An open workbook: its sheets by the ZIP directory, their rows as streams."""

    def __init__(self, path: str):
        system, name = _fs(path)
        self.path, self.file = path, system.open_input_file(name)
        self.zip = zipfile.ZipFile(self.file)
        book = self._tree("xl/workbook.xml")
        places = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels")}
        self.sheets: dict[str, str] = {}
        for s in book.iter():
            if _tag(s) == "sheet":
                target = places[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
                self.sheets[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        self.epoch = _EPOCH_1904 if any(_tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter()) else _EPOCH
        self._strings: list[str] | None = None
        self._dated: list[bool] | None = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.zip.close()
        self.file.close()

    def _tree(self, member: str):
        with self.zip.open(member) as f:
            return ElementTree.parse(f).getroot()

    def sheet(self, which: str) -> str:
        """The member of a sheet by name, or by number from 0 where no sheet has that name."""
        if which in self.sheets:
            return self.sheets[which]
        if which.lstrip("-").isdigit() and 0 <= int(which) < len(self.sheets):
            return list(self.sheets.values())[int(which)]
        raise ValueError(f"{self.path} has no sheet {which!r}; it has {list(self.sheets)}")

    def strings(self) -> list[str]:
        """The shared strings, read when a cell first needs them."""
        if self._strings is None:
            self._strings = []
            if "xl/sharedStrings.xml" in self.zip.namelist():
                with self.zip.open("xl/sharedStrings.xml") as f:
                    for _, e in ElementTree.iterparse(f):
                        if _tag(e) == "si":
                            self._strings.append(_text(e))
                            e.clear()
        return self._strings

    def dated(self, style: int) -> bool:
        """Is the number format of a cell style one of dates?"""
        if self._dated is None:
            self._dated, own = [], {}
            if "xl/styles.xml" in self.zip.namelist():
                for e in self._tree("xl/styles.xml"):
                    if _tag(e) == "numFmts":
                        own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in e}
                    elif _tag(e) == "cellXfs":
                        self._dated = [_is_date(int(x.get("numFmtId", 0)), own) for x in e]
        return style < len(self._dated) and self._dated[style]

    def last_row(self, member: str) -> int | None:
        """The number of the last row by the sheet's own statement, or None."""
        with self.zip.open(member) as f:
            for _, e in ElementTree.iterparse(f, events=("start",)):
                if _tag(e) == "dimension":
                    m = re.search(r"(\d+)$", e.get("ref", ""))
                    return int(m[1]) if m else None
                if _tag(e) == "sheetData":
                    return None
        return None

    def rows(self, member: str, first: int = 1, last: int | None = None) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:
        """(row number, {column from 0: (kind, text)}) of rows ``first`` to ``last`` that have cells.
        Kinds: n number, d number of a date, i ISO date, s text, b boolean."""
        with self.zip.open(member) as f:
            number, data = 0, None
            for event, e in ElementTree.iterparse(f, events=("start", "end")):
                tag = _tag(e)
                if event == "start":
                    if tag == "sheetData":
                        data = e
                    continue
                if tag != "row":
                    continue
                number = int(e.get("r", number + 1))
                if last is not None and number > last:
                    return
                if number >= first:
                    cells = dict(self._cells(e))
                    if cells:
                        yield number, cells
                if data is not None:
                    data.clear()  # rows behind are not kept

    def _cells(self, row):
        at = -1
        for c in row:
            if _tag(c) != "c":
                continue
            place = re.match(r"[A-Z]+", c.get("r", ""))
            at = _column(place[0]) if place else at + 1
            kind, value = c.get("t", "n"), next((v.text for v in c if _tag(v) == "v"), None)
            if kind == "inlineStr":
                inline = next((v for v in c if _tag(v) == "is"), None)
                if inline is not None:
                    yield at, ("s", _text(inline))
            elif value is None or kind == "e":
                continue
            elif kind == "s":
                yield at, ("s", self.strings()[int(value)])
            elif kind == "str":
                yield at, ("s", _decoded(value))
            elif kind in "bd":
                yield at, ("b" if kind == "b" else "i", value)
            else:
                yield at, ("d" if self.dated(int(c.get("s", 0))) else "n", value)

    def header(self, member: str) -> tuple[int, list[str]]:
        """(its row number, trimmed names) of the first row that has cells; names that are missing or repeated get a number."""
        for number, cells in self.rows(member):
            names: list[str] = []
            for i in range(max(cells) + 1):
                name = _as_text(cells[i], self.epoch).strip() if i in cells else ""
                name, n = name or f"_c{i}", 1
                while (new := name if n == 1 else f"{name}.{n - 1}") in names:
                    n += 1
                names.append(new)
            return number, names
        return 0, []


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _decoded(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _text(e) -> str:
    """A string item: its text or its runs', without phonetic hints."""
    out = []
    for part in e:
        if _tag(part) == "t":
            out.append(part.text or "")
        elif _tag(part) == "r":
            out += [t.text or "" for t in part if _tag(t) == "t"]
    return _decoded("".join(out))


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def _letters(column: int) -> str:
    out, column = "", column + 1
    while column:
        column, r = divmod(column - 1, 26)
        out = chr(65 + r) + out
    return out


def _is_date(number: int, own: Mapping[int, str]) -> bool:
    if number not in own:
        return number in _DATE_FORMATS
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^]]*\]', "", own[number].lower())
    return re.search(r"[ymdhs]", bare) is not None and "general" not in bare


def _moment(text: str, epoch: dt.datetime) -> dt.datetime | None:
    """A serial number as a time, to the microsecond."""
    try:
        serial = Decimal(text)
        if epoch == _EPOCH and serial < 60:  # that calendar has a 29 February 1900
            serial += 1
        return epoch + dt.timedelta(microseconds=int((serial * 86_400_000_000).to_integral_value()))
    except (InvalidOperation, OverflowError, ValueError):
        return None


def _iso(text: str) -> dt.datetime | None:
    try:
        return dt.datetime.fromisoformat(text.strip()).replace(tzinfo=None)
    except ValueError:
        return None


def _as_text(cell: tuple[str, str], epoch: dt.datetime) -> str:
    kind, text = cell
    if kind == "b":
        return "true" if text == "1" else "false"
    if kind == "d" and (when := _moment(text, epoch)):
        return when.date().isoformat() if when.time() == dt.time() else when.isoformat(" ")
    return text


def _as_number(cell: tuple[str, str]) -> Decimal | None:
    kind, text = cell
    try:
        n = Decimal(text.strip())
        return n if n.is_finite() and kind != "i" else None
    except InvalidOperation:
        return None


def _as_time(cell: tuple[str, str], epoch: dt.datetime) -> dt.datetime | None:
    kind, text = cell
    return _moment(text, epoch) if kind in "nd" else _iso(text)


def _converter(kind: T.DataType):
    """cell, calendar -> value of a Spark type, None where it does not fit."""
    if isinstance(kind, T.StringType):
        return _as_text
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return lambda c, _: None if (n := _as_number(c)) is None else float(n)
    if isinstance(kind, T.IntegralType):
        bits = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}[kind.simpleString()]
        return lambda c, _: int(n) if (n := _as_number(c)) is not None and n == n.to_integral_value() and -(1 << bits) <= n < 1 << bits else None
    if isinstance(kind, T.DecimalType):
        unit = Decimal(1).scaleb(-kind.scale)

        def decimal(c, _):
            n = _as_number(c)
            n = None if n is None else n.quantize(unit) if n.adjusted() < kind.precision - kind.scale else None
            return n if n is not None and len(n.as_tuple().digits) <= kind.precision else None
        return decimal
    if isinstance(kind, T.BooleanType):
        words = {"1": True, "true": True, "0": False, "false": False}
        return lambda c, _: words.get(c[1].strip().lower())
    if isinstance(kind, T.DateType):
        return lambda c, e: None if (t := _as_time(c, e)) is None else t.date()
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return _as_time
    raise ValueError(f"a sheet has no cells of type {kind.simpleString()}")


@dataclass
class SheetRange(InputPartition):
    """Rows ``first`` to ``last`` of a sheet; ``columns``: the place of each field."""

    path: str
    member: str
    first: int
    last: int | None
    columns: list[int]


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _header(self) -> bool:
        return str(self.options.get("header", "true")).lower() == "true"

    def schema(self) -> T.StructType:
        files = workbook_files(self.options["path"])
        if not files:
            raise ValueError(f"no workbook in {self.options['path']}")
        with Workbook(files[0]) as book:
            member = book.sheet(self.options.get("sheet", "0"))
            if self._header():
                names = book.header(member)[1]
            else:
                names = [f"_c{i}" for i in range(max((max(cells) + 1 for _, cells in book.rows(member)), default=0))]
        return T.StructType([T.StructField(n, T.StringType()) for n in names or ["_c0"]])

    def reader(self, schema: T.StructType) -> "WorkbookReader":
        return WorkbookReader(schema, dict(self.options), self._header())

    def writer(self, schema: T.StructType, overwrite: bool) -> "WorkbookWriter":
        return WorkbookWriter(self.options["path"], overwrite)


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict, header: bool):
        self.fields, self.options, self.header = schema, options, header

    def partitions(self) -> list[SheetRange]:
        size = int(self.options.get("rowsperpartition", self.options.get("rowsPerPartition", ROWS_PER_PARTITION)))
        out = []
        for path in workbook_files(self.options["path"]):
            with Workbook(path) as book:
                member = book.sheet(self.options.get("sheet", "0"))
                columns, first = list(range(len(self.fields))), 1
                if self.header:
                    at, names = book.header(member)
                    missing = [f.name for f in self.fields if f.name not in names]
                    if missing and at:
                        raise ValueError(f"{path} has no column(s) {missing}; it has {names}")
                    columns, first = ([names.index(f.name) for f in self.fields] if at else []), at + 1
                last = book.last_row(member) or 0
                starts = list(range(first, max(last, first) + 1, size))
                # the last range is open: the stated end may be too small
                out += [SheetRange(path, member, a, b - 1 if b else None, columns) for a, b in zip(starts, [*starts[1:], None])]
        return out or [SheetRange("", "", 0, 0, [])]

    def read(self, partition: SheetRange):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.columns:
            return
        kind = to_arrow_schema(self.fields)
        convert = [(c, _converter(f.dataType)) for c, f in zip(partition.columns, self.fields)]
        with Workbook(partition.path) as book:
            held: list[list] = []
            for _, cells in book.rows(partition.member, partition.first, partition.last):
                held.append([to(cells[c], book.epoch) if c in cells else None for c, to in convert])
                if len(held) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), kind)], schema=kind)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), kind)], schema=kind)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WorkbookWriter(DataSourceWriter):
    """Rows (is a header, sheet, cells), where a cell is (kind, text): a task writes workbooks of its own."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> Written:
        system, base = _fs(self.path)
        system.create_dir(base, recursive=True)
        files: list[str] = []
        book, head = None, None
        try:
            for first, sheet, cells in iterator:
                if first:  # a header begins its sheet
                    head = cells
                    full = sheet in book.names if book is not None else True
                else:
                    full = book is None or book.rows >= MAX_ROWS
                if full:
                    if book is not None:
                        book.close()
                    files.append(f"part-{uuid.uuid4().hex}.xlsx")
                    book = BookOut(system.open_output_stream(f"{base}/{files[-1]}"))
                    if not first and head is not None:
                        book.row(sheet, head)
                book.row(sheet, cells)
        finally:
            if book is not None:
                book.close()
        return Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, base = _fs(self.path)
        system.create_dir(base, recursive=True)
        before = []
        if system.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_file(f"{base}/{MANIFEST}") as f:
                before = json.loads(f.read())
        new = [n for m in messages if m is not None for n in m.files]
        draft = f"{base}/_{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps(new if self.overwrite else before + new).encode())
        system.move(draft, f"{base}/{MANIFEST}")
        for name in before if self.overwrite else []:
            system.delete_file(f"{base}/{name}")

    def abort(self, messages) -> None:
        system, base = _fs(self.path)
        for m in messages:
            for name in m.files if m is not None else []:
                system.delete_file(f"{base}/{name}")


class BookOut:
    """A workbook written row by row, a sheet after the other."""

    def __init__(self, out):
        self.out, self.zip = out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self.names: list[str] = []
        self.part, self.rows = None, 0

    def _end_sheet(self) -> None:
        if self.part is not None:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()
            self.part = None

    def row(self, sheet: str, cells) -> None:
        if self.names[-1:] != [sheet]:
            self._end_sheet()
            self.names.append(sheet)
            self.rows = 0
            self.part = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
            self.part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self.rows += 1
        out = [f'<row r="{self.rows}">']
        for i, cell in enumerate(cells):
            if cell is None or cell[1] is None:
                continue
            kind, text = cell
            place = f'{_letters(i)}{self.rows}'
            if kind == "s":
                fit = escape(_UNFIT.sub(lambda m: f"_x{ord(m[0]):04X}_", text))
                out.append(f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{fit}</t></is></c>')
            else:
                out.append(f'<c r="{place}"{dict(b=" t=" + chr(34) + "b" + chr(34), d=" s=" + chr(34) + "1" + chr(34)).get(kind, "")}><v>{text}</v></c>')
        out.append("</row>")
        self.part.write("".join(out).encode("utf-8", "replace"))

    def close(self) -> None:
        if self.zip is None:
            return
        self._end_sheet()
        n = range(1, len(self.names) + 1)
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        parts = {
            "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
                             '<cellStyleXfs count="1"><xf numFmtId="0"/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>'
                               + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, self.names)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">'
                                          + "".join(f'<Relationship Id="rId{i}" Type="{_RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
                                          + f'<Relationship Id="rId0" Type="{_RELS}/styles" Target="styles.xml"/></Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                                   f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}styles+xml"/>'
                                   + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}worksheet+xml"/>' for i in n) + "</Types>",
        }
        for name, text in parts.items():
            self.zip.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
        self.zip.close()
        self.out.close()
        self.zip = None


def register(spark: SparkSession) -> None:
    """Make the format known to the session (once); the workers get this module by value."""
    from pyspark import cloudpickle

    if getattr(spark, "_tidemark_workbook", False):
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(WorkbookSource)
    spark._tidemark_workbook = True


def sheet_names(path: str) -> list[str]:
    """The sheets of a workbook (of the first one of a folder), in order."""
    files = workbook_files(path)
    if not files:
        return []
    with Workbook(files[0]) as book:
        return list(book.sheets)


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0, schema: T.StructType | str | None = None, header: bool = True,
                  rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """SRC2 / SRC3: one sheet, by name or number, of a workbook or of a folder of workbooks."""
    register(spark)
    reader = spark.read.format(FORMAT).option("sheet", str(sheet)).option("header", header).option("rowsPerPartition", rows_per_partition)
    return (reader if schema is None else reader.schema(schema)).load(path)


def read_workbook_sheets(spark: SparkSession, path: str, sheets: list[str] | None = None,
                         schema: Mapping[str, T.StructType | str] | None = None, header: bool = True) -> dict[str, DataFrame]:
    """SRC4: the named sheets (default: all) of one workbook, each with its schema if one is given."""
    return {s: read_workbook(spark, path, s, (schema or {}).get(s), header) for s in sheets or sheet_names(path)}


def _cell(field: T.StructField):
    """(kind, text) of a column's values; NULL stays an empty cell."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.BooleanType):
        tagged = F.lit("b"), c.cast("int").cast("string")
    elif isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType)):
        # days since the calendar's first, in exact decimals; the days before March 1900 count one less
        days = F.datediff(c.cast("date"), F.lit("1899-12-30").cast("date")).cast("decimal(10,0)")
        if not isinstance(kind, T.DateType):
            seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.date_part(F.lit("second"), c)
            days = days + (seconds.cast("decimal(12,6)") / F.lit(86_400).cast("decimal(5,0)")).cast("decimal(13,12)")
        tagged = F.lit("d"), F.when(days < 61, days - 1).otherwise(days).cast("decimal(24,12)").cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = F.coalesce(F.abs(c) < float("inf"), F.lit(False))  # no number cell holds the others
        return F.when(c.isNotNull(), F.struct(F.when(plain, "n").otherwise("s").alias("kind"), c.cast("string").alias("text")))
    elif isinstance(kind, T.NumericType):
        tagged = F.lit("n"), c.cast("string")
    else:
        tagged = F.lit("s"), c.cast("string")
    return F.when(c.isNotNull(), F.struct(tagged[0].alias("kind"), tagged[1].alias("text")))


def write_workbook(sheets: Mapping[str, DataFrame], path: str, files: int = 1, mode: str = "append") -> None:
    """Workbooks with a sheet per DataFrame, in a folder. ``files`` tasks write, each its share of every
    sheet with the header; rows keep their order within a file."""
    if not sheets:
        raise ValueError("no sheet to write")
    register(next(iter(sheets.values())).sparkSession)
    tagged = None
    for i, (name, df) in enumerate(sheets.items()):
        cells = F.array(*[_cell(f) for f in df.schema.fields])
        rows = df.select(F.lit(i).alias("at"), F.lit(name).alias("sheet"), F.monotonically_increasing_id().alias("pos"), cells.alias("cells"))
        head = F.array(*[F.struct(F.lit("s").alias("kind"), F.lit(c).alias("text")) for c in df.columns])
        heads = df.sparkSession.range(files).select(F.lit(i).alias("at"), F.lit(name).alias("sheet"), F.lit(-1).cast("long").alias("pos"),
                                                    head.alias("cells"), F.col("id").alias("file"))
        rows = heads.unionByName(rows.withColumn("file", F.pmod(F.xxhash64("pos"), F.lit(files))))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    # rows of a file go to one task in the order of sheet and place; a task ends a workbook where the next begins
    tagged = tagged.repartition(files, "file").sortWithinPartitions("file", "at", "pos")
    tagged.select((F.col("pos") < 0).alias("first"), "sheet", "cells").write.format(FORMAT).mode(mode).save(path)
