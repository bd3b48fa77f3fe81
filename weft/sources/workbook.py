"""Workbooks: read by tasks (cached values; XLSX here, ODS, XLSB and XLS by modules of their own), and XLSX written from pieces that tasks make."""

from __future__ import annotations

import contextlib
import datetime as dt
import decimal
import functools
import io
import itertools
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from urllib.parse import unquote
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.folding import EXACT, text
from weft.model import SourceTable
from weft.operators.merge import NUMBER, ROW
from weft.plans.headers import combine_header_rows, recommend_header
from weft.sources import stores
from weft.sources.binary_workbooks import BinaryWorkbook, LegacyWorkbook
from weft.sources.cells import number_of, rectangle, shows_date
from weft.sources.opendocument import OpenDocument

MAX_ROWS = 1_048_575
#: Rows among which the header is looked for.
HEADER_ROWS = 20
SHEET_NAME = "合并结果_{:03d}"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_TEXT, _V, _C, _ROW = (f"{{{_NS['m']}}}{x}" for x in ("t", "v", "c", "row"))
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class WorkbookError(ValueError):
    pass


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


class _Inflated:
    """A packed member, unpacked as it is read."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.unpack = memoryview(packed), 1, zlib.decompressobj(-15).decompress if packed[:1] == b"d" else bytes

    def __enter__(self) -> _Inflated:
        return self

    def __exit__(self, *_) -> None:
        pass

    def read(self, size: int = 1 << 16) -> bytes:
        out = b""
        while not out and self.at < len(self.packed):
            out, self.at = self.unpack(self.packed[self.at : self.at + size]), self.at + size
        return out


class _Parts:
    """Some members of a workbook, each packed, after a letter that tells how; read like a ZipFile."""

    def __init__(self, members: dict[str, bytes]):
        self.members = members

    def namelist(self) -> list[str]:
        return list(self.members)

    def read(self, name: str) -> bytes:
        return b"".join(iter(self.open(name).read, b""))

    def open(self, name: str) -> _Inflated:
        return _Inflated(self.members[name])


class Workbook:
    """sheet(name) gives the used rows of a sheet as lists of None, str, int, float, bool or datetime."""

    def __init__(self, path: str | _Parts):
        try:
            self.zip = path if isinstance(path, _Parts) else zipfile.ZipFile(path)
        except zipfile.BadZipFile as e:
            raise WorkbookError(f"{path}: not an XLSX workbook") from e
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.paths = {s.get("name"): "xl/" + rels[s.get(_REL)].lstrip("/").removeprefix("xl/") for s in book.find("m:sheets", _NS)}
        pr = book.find("m:workbookPr", _NS)
        self.late = pr is not None and pr.get("date1904") in ("1", "true")
        names = set(self.zip.namelist())
        self.shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        self.dates: list[bool | None] = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iterfind("m:numFmts/m:numFmt", _NS)}
            for xf in styles.iterfind("m:cellXfs/m:xf", _NS):
                k = int(xf.get("numFmtId", 0))
                self.dates.append(shows_date(k, own.get(k)))

    def _value(self, c: ET.Element):
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return "".join([t.text or "" for t in c.iter(_TEXT)])
        text = c.findtext(_V)
        if not text:
            return None
        if kind == "n":
            style = int(c.get("s", 0))
            date = style < len(self.dates) and self.dates[style]
            if date or date is None:
                return number_of(float(text), date, self.late)
            try:
                return int(text)
            except ValueError:
                return float(text)
        return self.shared[int(text)] if kind == "s" else text == "1" if kind == "b" else text

    def rows(self, name: str) -> Iterator[tuple[int, dict[int, object]]]:
        """(row, {column: value}) of each row that has values, as they are read."""
        with self.zip.open(self.paths[name]) as f:
            at = 0
            for _, row in ET.iterparse(f):
                if row.tag != _ROW:
                    continue
                at = int(row.get("r", at + 1))
                cells, column = {}, -1
                for c in row.iterfind(_C):
                    column = _column(c.get("r")) if c.get("r") else column + 1
                    value = self._value(c)
                    if value is not None:
                        cells[column] = value
                row.clear()
                if cells:
                    yield at, cells

    def sheet(self, name: str, limit: int | None = None) -> list[list]:
        return rectangle(dict(itertools.islice(self.rows(name), limit)))


def sheet_rows(book, name: str) -> Iterator[tuple[int, dict[int, object]]]:
    """Rows of any of the workbooks."""
    if isinstance(book, Workbook):
        return book.rows(name)
    return ((k, {i: v for i, v in enumerate(r) if v is not None}) for k, r in enumerate(book.sheet(name)))


#: Readers by extension.
READERS = {"ods": OpenDocument, "xlsb": BinaryWorkbook, "xls": LegacyWorkbook}


def opened(path: str) -> Workbook | OpenDocument | BinaryWorkbook | LegacyWorkbook:
    if not stores.is_stored(path):
        source = path
    else:
        with stores.opened(path) as f:
            source = io.BytesIO(f.read())
    return READERS.get(path.rpartition(".")[2].lower(), Workbook)(source)


def cell_text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d" if value.time() == dt.time(0) else "%Y-%m-%d %H:%M:%S")
    if isinstance(value, float):
        return text(value)
    return str(value)


def _described(book, path: str, name: str, header_row: int | None = None, header_rows: int = 1) -> SourceTable | None:
    """A sheet's table, if it is not empty. Rows are read one by one; only those that may be the header are held."""
    held, last = {}, None
    left, right, deepest = 1 << 30, -1, max(HEADER_ROWS, (header_row or 1) + 2)
    for at, cells in sheet_rows(book, name):
        if not cells:
            continue
        left, right, last = min(left, *cells), max(right, *cells), at
        if at < next(iter(held), at) + deepest:
            held[at] = cells
    if last is None:
        return None
    top = next(iter(held))
    total = last - top + 1
    rows = [[cell_text(held.get(top + r, {}).get(k)) for k in range(left, right + 1)] for r in range(min(total, deepest))]
    suggested = recommend_header(rows[:HEADER_ROWS]) + 1
    first, n = max(1, header_row or suggested), min(3, max(1, header_rows))
    if total < first + n - 1:
        raise WorkbookError(f"{path} {name}: too few rows for its header")
    headers = combine_header_rows(rows[first - 1 : first + n - 1])
    return SourceTable(path, name, tuple(headers), header_row=first, header_rows=n, suggested_header_row=suggested, estimated_rows=max(0, total - first - n + 1))


def scan(path: str, *, sheet: str | None = None, header_row: int | None = None, header_rows: int = 1) -> list[SourceTable]:
    """A table of each sheet that is not empty."""
    book = opened(path)
    found = (_described(book, path, name, header_row, header_rows) for name in ([sheet] if sheet else book.paths))
    return [t for t in found if t is not None]


#: Bytes of packed sheets that a task reads at a time; all else that they need comes with them.
BUNDLE = 1 << 18
_COMMON = ("xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml", "xl/styles.xml")


def _place(path: str) -> str:
    return path if stores.is_stored(path) else "file:" + os.path.abspath(path)


def _members(content: bytes, least: int) -> Iterator[dict[str, bytes]]:
    """An XLSX workbook as bundles of some sheets each, still packed, with the members that all need."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = {i.filename: i for i in z.infolist()}

        def packed(name: str) -> bytes:
            i = infos[name]
            if i.compress_type != zipfile.ZIP_DEFLATED or i.flag_bits & 1:
                return b"s" + z.read(name)
            start = i.header_offset + 30 + sum(struct.unpack_from("<HH", content, i.header_offset + 26))
            return b"d" + content[start : start + i.compress_size]

        common = {n: packed(n) for n in _COMMON if n in infos}
        most, bundle, size = max(least, 2 * sum(map(len, common.values()))), {}, 0
        for name in [n for n in infos if n.startswith("xl/") and n.endswith(".xml") and n not in _COMMON]:
            bundle[name] = packed(name)
            size += len(bundle[name])
            if size >= most:
                yield common | bundle
                bundle, size = {}, 0
        yield common | bundle


def _bundles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, part, names, members): the workbooks in pieces that tasks read side by side; one of another format than XLSX is one piece without names."""
    least = BUNDLE

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = content.as_py()
                xlsx = path.rpartition(".")[2].lower() not in READERS and zipfile.is_zipfile(io.BytesIO(whole))
                for k, members in enumerate(_members(whole, least) if xlsx else [{"": whole}]):
                    yield pa.record_batch([pa.array([path]), pa.array([k], pa.int32()), pa.array([list(members)], pa.list_(pa.string())), pa.array([list(members.values())], pa.list_(pa.binary()))], names=["path", "part", "names", "members"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return files.mapInArrow(task, "path string, part int, names array<string>, members array<binary>").repartition(many, "path", "part")


def _books(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object, list[str]]]:
    """(path, workbook, names of its sheets that are here) of each bundle."""
    for batch in batches:
        for n in range(batch.num_rows):
            path, _, names, members = (c[n].as_py() for c in batch.columns)
            if names == [""]:
                book = READERS.get(path.rpartition(".")[2].lower(), Workbook)(io.BytesIO(members[0]))
                yield path, book, list(book.paths)
            else:
                book = Workbook(_Parts(dict(zip(names, members))))
                yield path, book, [s for s, p in book.paths.items() if p in book.zip.members]


def scan_all(spark: SparkSession, paths: list[str]) -> list[SourceTable]:
    """Tables of all sheets, in order of path and sheet, found by tasks; a workbook that fails is an error."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, book, sheets in _books(batches):
            found = [t for t in (_described(book, path, name) for name in sheets) if t is not None]
            rows = [(path, t.sheet_name, list(t.headers), t.header_row, t.suggested_header_row, t.estimated_rows) for t in found]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()))], names=["path", "sheet", "headers", "first", "suggested", "n"])

    own = {_plain(_place(p)): p for p in paths}
    rows = _bundles(spark, [_place(p) for p in paths]).mapInArrow(task, "path string, sheet string, headers array<string>, first long, suggested long, n long").collect()  # a row a sheet
    tables = [SourceTable(own[_plain(r.path)], r.sheet, tuple(r.headers), header_row=r.first, suggested_header_row=r.suggested, estimated_rows=r.n) for r in rows]
    return sorted(tables, key=lambda t: (t.path.lower(), t.sheet_name.lower()))


def _plain(uri: str) -> str:
    return re.sub("^([A-Za-z][A-Za-z0-9+.-]+):/+", r"\1:/", unquote(uri))  # file:///x is file:/x


#: Kinds of cells in the files between, and the column types of the sets of them that keep a type; other sets become text.
_KINDS = {bool: "b", int: "i", float: "f", dt.datetime: "d", str: "s"}
_TYPES = {"b": T.BooleanType(), "i": T.LongType(), "f": T.DoubleType(), "fi": T.DoubleType(), "d": T.TimestampNTZType()}


def _coded(value) -> str | None:
    """A cell's kind and text."""
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 63:
        value = float(value)
    return None if value is None else _KINDS.get(type(value), "s") + cell_text(value)


class _Sheet:
    """A sheet's rows of a table of many sheets: a DataFrame that is made when it is asked for."""

    def __init__(self, family: DataFrame, number: int):
        self.family, self.number = family, number

    @functools.cached_property
    def frame(self) -> DataFrame:
        return self.family.filter(F.col(NUMBER) == self.number).drop(NUMBER)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.frame, name)


def read_all(spark: SparkSession, tables: list[SourceTable]) -> list[SourceTable]:
    """The tables with their rows. A column of one cell type keeps it; a mixed one becomes text, an empty one has no type.

    Every workbook is read once, its sheets by many tasks, row by row, into a table of coded cells in the shared folder; at the end of a sheet comes a row that tells where it begins and which kinds its
    columns hold. The tables are that table's rows.
    """
    wanted: dict[str, dict[str, list[tuple[int, int]]]] = {}
    for k, t in enumerate(tables):
        wanted.setdefault(_place(t.path), {}).setdefault(t.sheet_name, []).append((k, t.header_row + t.header_rows - 1))
    by_file = {_plain(p): v for p, v in wanted.items()}
    schema = pa.schema([("table", pa.int32()), ("r", pa.int64()), ("left", pa.int32()), ("cells", pa.list_(pa.string()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(x), f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for path, book, sheets in _books(batches):
            for sheet in sheets:
                for k, skipped in by_file[_plain(path)].get(sheet, ()):
                    out, top, at, left, kinds = [], None, None, 1 << 30, {}
                    for row, cells in sheet_rows(book, sheet):
                        if not cells:
                            continue
                        top = row if top is None else top
                        out += [(k, r, None, []) for r in range(row if at is None else at + 1, row) if r >= top + skipped]
                        at, left = row, min(left, *cells)
                        if row >= top + skipped:
                            coded = [_coded(cells.get(c)) for c in range(max(cells) + 1)]
                            for c, value in enumerate(coded):
                                if value is not None:
                                    kinds.setdefault(c, set()).add(value[0])
                            out.append((k, row, None, coded))
                        if len(out) >= 5000:
                            yield batch_of(out)
                            out = []
                    out.append((k, None, 0 if top is None else left, [str(0 if top is None else top + skipped), *[f"{c}:{''.join(sorted(x))}" for c, x in kinds.items()]]))
                    yield batch_of(out)

    columns = "table int, r long, left int, cells array<string>"
    held = stores.shared(spark, "cells")
    _bundles(spark, list(wanted)).mapInArrow(task, columns).write.parquet(held)
    coded = spark.read.schema(columns).parquet(held)
    told = {r.table: r for r in coded.filter("r is null").collect()}  # a row a sheet
    out, families = [], {}
    for k, t in enumerate(tables):
        left, (first, *kinds) = told[k].left, told[k].cells
        known = {int(c): x for c, _, x in (v.partition(":") for v in kinds)}
        types = tuple(known.get(left + c, "") for c in range(len(t.headers)))
        shape = (t.headers, left, int(first), types)
        if shape not in families:
            text = lambda c: F.substring(F.get("cells", F.lit(left + c)), 2, 1 << 30)  # noqa: B023, E731  used at once
            values = [(text(c).cast(_TYPES.get(kind, T.StringType())) if kind else F.lit(None)).alias(h) for c, (h, kind) in enumerate(zip(t.headers, types))]
            families[shape] = coded.filter(F.col("r").isNotNull()).select(*values, (F.col("r") - int(first)).alias(ROW), F.col("table").alias(NUMBER))
        family = families[shape]
        out.append(replace(t, frame=_Sheet(family, k), stable=True, family=(family, k)))
    return out


def read(spark: SparkSession, table: SourceTable) -> SourceTable:
    return read_all(spark, [table])[0]


_STYLES = (
    '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/>'
    '<numFmt numFmtId="165" formatCode="yyyy-mm-dd hh:mm:ss"/></numFmts><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill>'
    '<patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF2563EB"/></patternFill></fill></fills><borders count="2"><border/><border><left style="thin"/><right style="thin"/>'
    '<top style="thin"/><bottom style="thin"/></border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf fontId="1" fillId="2" borderId="1" applyFont="1" applyFill="1" applyBorder="1" applyAlignment="1">'
    '<alignment horizontal="center"/></xf><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="165" applyNumberFormat="1"/></cellXfs></styleSheet>'
)


def width_of(header: str) -> int:
    return min(32, max(12, sum(1 if ord(c) < 128 else 2 for c in header) + 4))


def _cell(value, style: int = 0) -> str:
    """A cell without its place: cells follow each other."""
    if isinstance(value, dict):  # a sum: number or text
        value = value["text"] if value["number"] is None else value["number"]
    if value is None or value == "":
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, dt.datetime):
        serial = (value.replace(microsecond=0) - dt.datetime(1899, 12, 30)).total_seconds() / 86400
        return f'<c s="{2 if serial == int(serial) else 3}"><v>{serial!r}</v></c>'
    if isinstance(value, dt.date):
        return _cell(dt.datetime(value.year, value.month, value.day))
    if isinstance(value, decimal.Decimal) and value == value.to_integral_value() and abs(value) >= EXACT:
        value = format(value, "f").partition(".")[0]
    if not isinstance(value, str):
        with contextlib.suppress(TypeError, ValueError):  # of other types, such as lists, the text
            number = float(value)
            if number == number and abs(number) != float("inf") and (isinstance(value, float) or int(number) == value):
                return f"<c><v>{int(value) if number == int(number) and abs(number) < 1e15 else repr(number)}</v></c>"
        value = str(value)
    shown = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", value)
    return f'<c{f' s="{style}"' if style else ""} t="inlineStr"><is><t xml:space="preserve">{escape(shown)}</t></is></c>'


def _row(values: Iterable, style: int = 0) -> str:
    return f"<row>{''.join(_cell(v, style) for v in values)}</row>"


def _top(headers: list[str]) -> str:
    cols = "".join(f'<col min="{k}" max="{k}" width="{width_of(h)}" customWidth="1"/>' for k, h in enumerate(headers, 1))
    return (
        '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        f"<cols>{cols}</cols><sheetData>{_row(headers, 1)}"
    )


#: Rows that a task turns into XML and compresses at a time.
CHUNK_ROWS = 2000


def _chunks(df: DataFrame, most: int) -> DataFrame:
    """(part, seq, n, xml): rows of df as compressed XML, `most` rows a piece; pieces do not depend on where they come to stand."""
    plain = [F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema.fields]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                text = "".join(map(_row, zip(*[c.to_pylist() for c in piece.columns])))
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([piece.num_rows], pa.int32()), pa.array([zlib.compress(text.encode(), 6)], pa.binary())], names=["part", "seq", "n", "xml"])
                seq += 1

    return df.select(*plain).mapInArrow(task, "part int, seq int, n int, xml binary")


def write(df: DataFrame, path: str, *, max_rows: int = MAX_ROWS, overwrite: bool = False, told: Callable[[int, int], None] | None = None) -> tuple[int, int]:
    """Write df's rows in order as one workbook, a new sheet after max_rows rows; (rows, sheets).

    Tasks turn rows into pieces of XML, which are kept in the shared folder; when all are there, the driver puts them into the one file that a workbook is, piece by piece. It appears
    under its name only when it is whole, on any store. told(rows written, rows in all) is called after each piece.
    """
    if not path.lower().endswith(".xlsx"):
        raise WorkbookError("the output must end in .xlsx")
    if stores.exists(path) and not overwrite:
        raise WorkbookError(f"{path} exists")
    if len(df.columns) > 16_384:
        raise WorkbookError("more than 16384 columns")
    spark, temporary = df.sparkSession, f"{path}.part"
    held = stores.shared(spark, "sheets")
    n = sheets = in_sheet = 0
    try:
        _chunks(df, min(CHUNK_ROWS, max_rows)).write.parquet(held)
        chunks = spark.read.schema("part int, seq int, n int, xml binary").parquet(held)
        total = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        top, end = _top(df.columns).encode(), b"</sheetData></worksheet>"
        with stores.created(temporary) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            f = None

            def begin() -> None:
                nonlocal f, sheets, in_sheet
                if f is not None:
                    f.write(end)
                    f.close()
                sheets, in_sheet = sheets + 1, 0
                f = z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True)
                f.write(top)

            begin()
            for chunk in chunks.orderBy("part", "seq").toLocalIterator():
                xml, left = zlib.decompress(chunk.xml), chunk.n
                while left:
                    if in_sheet == max_rows:
                        begin()
                    if left <= max_rows - in_sheet:
                        here, some, xml = xml, left, b""
                    else:  # the piece goes on in the next sheet
                        some = max_rows - in_sheet
                        cut = [m.end() for m in itertools.islice(re.finditer(b"</row>", xml), some)][-1]
                        here, xml = xml[:cut], xml[cut:]
                    f.write(here)
                    left, n, in_sheet = left - some, n + some, in_sheet + some
                if told:
                    told(n, total)
            f.write(end)
            f.close()
            every = range(1, sheets + 1)
            head = '<?xml version="1.0" encoding="UTF-8"?>'
            rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            pack = "http://schemas.openxmlformats.org/package/2006"
            z.writestr("xl/styles.xml", _STYLES)
            z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS["m"]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{SHEET_NAME.format(k)}" sheetId="{k}" r:id="rId{k}"/>' for k in every) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in every) + f'<Relationship Id="rId{sheets + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
            z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in every) + "</Types>")
        stores.moved(temporary, path)
    finally:
        stores.deleted(temporary)
        stores.deleted(held)
    return n, sheets
