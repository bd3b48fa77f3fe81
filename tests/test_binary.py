"""Binary workbooks written byte by byte, read back."""

import datetime as dt
import struct
import zipfile

import pytest

from weft.model import MergeOptions
from weft.operators.merge import merge
from weft.sources import discovery
from weft.sources.binary_workbooks import BinaryWorkbook, LegacyWorkbook

REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def wide(text):
    return struct.pack("<I", len(text)) + text.encode("utf-16-le")


def record(kind, data=b""):
    head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
    size, out = len(data), b""
    while True:
        out += bytes([size & 0x7F | (0x80 if size > 127 else 0)])
        size >>= 7
        if not size:
            return head + out + data


def xlsb(path):
    cell = lambda column, style, data: struct.pack("<II", column, style) + data
    sheet = b"".join([
        record(0, struct.pack("<I", 2)), record(7, cell(1, 0, struct.pack("<I", 0))), record(6, cell(2, 0, wide("when"))), record(8, cell(3, 0, wide("日本" * 100))), record(6, cell(4, 0, wide("e"))), record(6, cell(5, 0, wide("b"))),
        record(0, struct.pack("<I", 3)), record(2, cell(1, 0, struct.pack("<I", (-7 << 2) & 0xFFFFFFFF | 2))), record(5, cell(2, 1, struct.pack("<d", 45000.25))), record(2, cell(3, 0, struct.pack("<I", 1234 << 2 | 3))),
        record(3, cell(4, 0, bytes([7]))), record(4, cell(5, 0, bytes([1]))),
        record(0, struct.pack("<I", 5)), record(9, cell(1, 0, struct.pack("<d", 2.5))), record(1, cell(2, 0, b"")), record(10, cell(5, 0, bytes([0]))),
    ])
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.bin", record(153, struct.pack("<III", 0, 0, 0)) + record(156, struct.pack("<II", 0, 1) + wide("rId1") + wide("Data")))
        z.writestr("xl/_rels/workbook.bin.rels", f'<Relationships xmlns="{REL}"><Relationship Id="rId1" Target="worksheets/sheet1.bin"/></Relationships>')
        z.writestr("xl/sharedStrings.bin", record(159, struct.pack("<II", 1, 1)) + record(19, b"\0" + wide("id")))
        z.writestr("xl/styles.bin", record(44, struct.pack("<H", 170) + wide("yyyy/mm")) + record(47, struct.pack("<HH", 0, 14)) + record(617) + record(47, struct.pack("<HH", 0, 0)) + record(47, struct.pack("<HH", 0, 170)) + record(618))
        z.writestr("xl/worksheets/sheet1.bin", sheet)


def test_xlsb(spark, tmp_path):
    xlsb(tmp_path / "a.xlsb")
    rows = BinaryWorkbook(str(tmp_path / "a.xlsb")).sheet("Data")
    assert rows == [["id", "when", "日本" * 100, "e", "b"], [-7, dt.datetime(2023, 3, 15, 6), 12.34, "#DIV/0!", True], [None] * 5, [2.5, None, None, None, False]]
    tables, warnings = discovery.scan([str(tmp_path / "a.xlsb")])
    assert [(t.sheet_name, t.estimated_rows) for t in tables] == [("Data", 3)] and not warnings
    got = merge([discovery.load(spark, t) for t in tables], MergeOptions()).collect()
    assert [(r.id, r.b) for r in got] == [(-7.0, True), (None, None), (2.5, False)]


def biff(kind, data=b""):
    return struct.pack("<HH", kind, len(data)) + data


def compound(stream, small=False):
    """A compound file with one stream, in sectors of 512 bytes or small ones of 64."""
    sectors = [b"", b""]  # allocation table, directory
    table = [0xFFFFFFFD, 0xFFFFFFFE]

    def put(data):
        first = len(sectors)
        for at in range(0, len(data), 512):
            sectors.append(data[at : at + 512].ljust(512, b"\0"))
            table.append(len(sectors) if at + 512 < len(data) else 0xFFFFFFFE)
        return first

    entry = lambda name, kind, start, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind)).ljust(116, b"\0") + struct.pack("<IQ", start, size)
    count = -(-len(stream) // 64)
    if small:
        root = entry("Root Entry", 5, put(stream), len(stream))
        first_small = put(struct.pack(f"<{count}I", *[*range(1, count), 0xFFFFFFFE]).ljust(512, b"\xff"))
        book = entry("Workbook", 2, 0, len(stream))
    else:
        root, first_small, book = entry("Root Entry", 5, 0xFFFFFFFE, 0), 0xFFFFFFFE, entry("Workbook", 2, put(stream), len(stream))
    sectors[0] = struct.pack("<128I", *table, *[0xFFFFFFFF] * (128 - len(table)))
    sectors[1] = (root + book).ljust(512, b"\0")
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<III", 0, 1, 1) + struct.pack("<I", 0)
    head += struct.pack("<5I", 4096, first_small, 1 if small else 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head.ljust(512, b"\0") + b"".join(sectors)


def xls(path, late=False, small=False):
    narrow = lambda t: struct.pack("<HB", len(t), 0) + t.encode("latin-1")
    far = "wörld" * 10
    # the third text is cut in two: the rest comes in a continuation, as wide letters
    table = struct.pack("<II", 4, 4) + narrow("id") + struct.pack("<HBHI", 4, 1 | 4 | 8, 1, 3) + "日本ab".encode("utf-16-le") + b"\0" * 4 + b"ext" + struct.pack("<HB", len(far), 0) + far[:20].encode("latin-1")
    shared = biff(0xFC, table) + biff(0x3C, b"\1" + far[20:].encode("utf-16-le") + narrow("when"))
    cell = lambda row, column, style, data=b"": struct.pack("<3H", row, column, style) + data
    sheet = b"".join([
        biff(0x809, b"\0" * 16), *[biff(0xFD, cell(0, k, 0, struct.pack("<I", s))) for k, s in enumerate((0, 3, 1, 2))], biff(0x204, cell(0, 4, 0, narrow("label"))),
        biff(0xBD, struct.pack("<HH", 1, 0) + struct.pack("<HI", 0, 5 << 2 | 2) + struct.pack("<HI", 1, 45000 << 2 | 2) + struct.pack("<H", 1)), biff(0x27E, cell(1, 2, 0, struct.pack("<I", 250 << 2 | 3))),
        biff(0x06, cell(1, 3, 0, b"\0" * 6 + b"\xff\xff" + b"\0" * 8)), biff(0x207, narrow("made")), biff(0x205, cell(1, 4, 0, bytes([42, 1]))),
        biff(0x809, b"\0" * 16), biff(0x203, cell(9, 9, 0, struct.pack("<d", 1.0))), biff(0x0A),  # a chart inside
        biff(0x203, cell(2, 0, 0, struct.pack("<d", 0.1))), biff(0x06, cell(2, 1, 1, struct.pack("<d", 45001.5) + b"\0" * 8)), biff(0x205, cell(2, 2, 0, bytes([1, 0]))), biff(0x06, cell(2, 3, 0, b"\1\0\1\0\0\0\xff\xff" + b"\0" * 8)),
        biff(0x0A),
    ])
    bound = lambda start: biff(0x85, struct.pack("<IBB", start, 0, 0) + bytes([5, 0]) + b"Data1") + biff(0x85, struct.pack("<IBB", 0, 0, 2) + bytes([5, 0]) + b"Chart")
    heads = lambda start: biff(0x809, b"\0" * 16) + biff(0x22, struct.pack("<H", late)) + biff(0x41E, struct.pack("<H", 170) + narrow('"y"0.0')) + biff(0xE0, struct.pack("<HH", 0, 170).ljust(20, b"\0")) + biff(0xE0, struct.pack("<HH", 0, 22).ljust(20, b"\0")) + bound(start) + shared + biff(0x0A)
    stream = heads(len(heads(0))) + sheet
    path.write_bytes(compound(stream if small else stream.ljust(5000, b"\0"), small))
    return far


@pytest.mark.parametrize("late, small", [(False, False), (True, False), (False, True)])
def test_xls(spark, tmp_path, late, small):
    far = xls(tmp_path / "a.xls", late, small)
    book = LegacyWorkbook(str(tmp_path / "a.xls"))
    assert list(book.paths) == ["Data1"]
    day = dt.datetime(2027, 3, 16) if late else dt.datetime(2023, 3, 15)
    assert book.sheet("Data1") == [["id", "when", "日本ab", far, "label"], [5, day, 2.5, "made", "#N/A"], [0.1, day + dt.timedelta(1.5), True, True, None]]
    assert book.sheet("Data1", 1) == [["id", "when", "日本ab", far, "label"]]
    tables, warnings = discovery.scan([str(tmp_path / "a.xls")])
    assert [(t.sheet_name, t.estimated_rows) for t in tables] == [("Data1", 2)] and not warnings
    assert [r.id for r in merge([discovery.load(spark, t) for t in tables], MergeOptions()).collect()] == [5.0, 0.1]


def test_broken_ones_are_warnings(tmp_path):
    (tmp_path / "ok.csv").write_text("a,b\n1,2\n")
    xls(tmp_path / "cut.xls")
    (tmp_path / "cut.xls").write_bytes((tmp_path / "cut.xls").read_bytes()[:1200])
    (tmp_path / "text.xls").write_text("no workbook")
    (tmp_path / "text.xlsb").write_text("no workbook")
    tables, warnings = discovery.scan(discovery.collect(str(tmp_path)))
    assert [t.file_name for t in tables] == ["ok.csv"] and len(warnings) == 3
