"""Readers of binary workbooks with the standard library: XLSB (records in a zip file) and XLS (BIFF8 records in a compound file). Cached values only."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from weft.sources.cells import ERRORS, number_of, rectangle, shows_date


def _rk(raw: int) -> float:
    """A number of 30 bits: whole or the upper half of a double, and perhaps in hundredths."""
    value = float((raw - (1 << 32) if raw >> 31 else raw) >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


class _Cells:
    """A sheet's cells as they come."""

    def __init__(self, limit: int | None):
        self.rows: dict[int, dict[int, object]] = {}
        self.limit = limit

    def put(self, row: int, column: int, value) -> None:
        if value is not None and value != "":
            self.rows.setdefault(row, {})[column] = value

    @property
    def full(self) -> bool:
        return self.limit is not None and len(self.rows) > self.limit

    def all(self) -> list[list]:
        kept = sorted(self.rows)[: self.limit]
        return rectangle({r: self.rows[r] for r in kept})


def _wide(data: bytes, at: int) -> tuple[str, int]:
    """A text with its length in front, and where it ends."""
    n = struct.unpack_from("<I", data, at)[0]
    if n == 0xFFFFFFFF:
        return "", at + 4
    return data[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


class BinaryWorkbook:
    """XLSB. sheet(name) gives the used rows as lists of None, str, int, float, bool or datetime."""

    def __init__(self, path):
        try:
            self.zip = zipfile.ZipFile(path)
            links = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.bin.rels"))}
        except (zipfile.BadZipFile, KeyError) as e:
            raise ValueError(f"{path}: not an XLSB workbook") from e
        self.paths, self.late, self.shared, self.dates = {}, False, [], []
        for kind, data in self._records("xl/workbook.bin"):
            if kind == 153:
                self.late = bool(data[0] & 1)
            elif kind == 156:
                link, at = _wide(data, 8)
                self.paths[_wide(data, at)[0]] = "xl/" + links[link].lstrip("/").removeprefix("xl/")
        names = set(self.zip.namelist())
        if "xl/sharedStrings.bin" in names:
            self.shared = [_wide(data, 1)[0] for kind, data in self._records("xl/sharedStrings.bin") if kind == 19]
        if "xl/styles.bin" in names:
            own, inside = {}, False
            for kind, data in self._records("xl/styles.bin"):
                if kind == 44:
                    own[struct.unpack_from("<H", data)[0]] = _wide(data, 2)[0]
                elif kind in (617, 618):
                    inside = kind == 617
                elif kind == 47 and inside:
                    number = struct.unpack_from("<H", data, 2)[0]
                    self.dates.append(shows_date(number, own.get(number)))

    def _records(self, name: str) -> Iterator[tuple[int, bytes]]:
        data = self.zip.read(name)
        at = 0

        def varying(most: int) -> int:
            nonlocal at
            value = 0
            for k in range(most):
                byte = data[at]
                at += 1
                value |= (byte & 0x7F) << 7 * k
                if not byte & 0x80:
                    break
            return value

        while at < len(data):
            kind, size = varying(2), varying(4)
            yield kind, data[at : at + size]
            at += size

    def sheet(self, name: str, limit: int | None = None) -> list[list]:
        cells, row = _Cells(limit), 0
        for kind, data in self._records(self.paths[name]):
            if kind == 0:
                row = struct.unpack_from("<I", data)[0]
                if cells.full:
                    break
            elif 2 <= kind <= 11:
                column, style = struct.unpack_from("<II", data)
                cells.put(row, column, self._value(kind, data, style & 0xFFFFFF))
        return cells.all()

    def _value(self, kind: int, data: bytes, style: int):
        if kind in (2, 5, 9):
            value = _rk(struct.unpack_from("<I", data, 8)[0]) if kind == 2 else struct.unpack_from("<d", data, 8)[0]
            return number_of(value, style < len(self.dates) and self.dates[style], self.late)
        if kind in (3, 11):
            return ERRORS.get(data[8], "#N/A")
        if kind in (4, 10):
            return bool(data[8])
        return self.shared[struct.unpack_from("<I", data, 8)[0]] if kind == 7 else _wide(data, 8)[0]


class _Compound:
    """A compound file: streams by name."""

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
            raise ValueError("not a compound file")
        self.data, self.size = data, 1 << struct.unpack_from("<H", data, 30)[0]
        small = 1 << struct.unpack_from("<H", data, 32)[0]
        n_fat, directory = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        cut, first_small, _, more, _ = struct.unpack_from("<5I", data, 56)
        tables = list(struct.unpack_from("<109I", data, 76))
        while more < 0xFFFFFFFA:
            block = struct.unpack_from(f"<{self.size // 4}I", data, (more + 1) * self.size)
            tables += block[:-1]
            more = block[-1]
        self.next = [x for t in tables[:n_fat] if t < 0xFFFFFFFA for x in struct.unpack_from(f"<{self.size // 4}I", data, (t + 1) * self.size)]
        entries = self._chain(directory)
        self.streams: dict[str, bytes] = {}
        found = []
        for at in range(0, len(entries) - 127, 128):
            length, kind = struct.unpack_from("<HB", entries, at + 64)
            start, size = struct.unpack_from("<IQ", entries, at + 116)
            if kind == 5:
                root = self._chain(start)
            elif kind == 2:
                found.append((entries[at : at + length - 2].decode("utf-16-le"), start, size & 0xFFFFFFFF))
        mini = self._chain(first_small)
        after = struct.unpack(f"<{len(mini) // 4}I", mini)
        for name, start, size in found:
            if size >= cut:
                self.streams[name] = self._chain(start)[:size]
                continue
            parts = []
            while start < 0xFFFFFFFA and len(parts) * small < size:
                parts.append(root[start * small : (start + 1) * small])
                start = after[start]
            self.streams[name] = b"".join(parts)[:size]

    def _chain(self, sector: int) -> bytes:
        out, seen = [], set()
        while sector < 0xFFFFFFFA and sector not in seen:
            seen.add(sector)
            out.append(self.data[(sector + 1) * self.size : (sector + 2) * self.size])
            sector = self.next[sector]
        return b"".join(out)


class _Parts:
    """A record's data and its continuations, read on; a text that goes on in one begins there with a byte that tells its width."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def raw(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            got = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if self.at >= len(self.parts[self.k]) and n:
                self.k, self.at = self.k + 1, 0
        return out

    def number(self, kind: str) -> int:
        return struct.unpack(kind, self.raw(struct.calcsize(kind)))[0]

    def letters(self, n: int, wide: bool) -> str:
        out = ""
        while n and self.k < len(self.parts):
            left = len(self.parts[self.k]) - self.at
            if not left:
                self.k, self.at = self.k + 1, 0
                wide = bool(self.raw(1)[0] & 1) if self.k < len(self.parts) else wide
                continue
            take = min(n, left // 2 if wide else left)
            if not take:
                break
            raw = self.raw(take * (2 if wide else 1))
            out, n = out + raw.decode("utf-16-le" if wide else "latin-1", "replace"), n - take
        return out

    def text(self, count: str = "<H") -> str:
        """With its length, flags and what follows them."""
        n, flags = self.number(count), self.number("<B")
        runs = self.number("<H") if flags & 8 else 0
        more = self.number("<I") if flags & 4 else 0
        out = self.letters(n, bool(flags & 1))
        self.raw(4 * runs + more)
        return out


class LegacyWorkbook:
    """XLS as written since 1997. sheet(name) as of BinaryWorkbook."""

    def __init__(self, path):
        if hasattr(path, "read"):
            data = path.read()
        else:
            with open(path, "rb") as f:
                data = f.read()
        try:
            streams = _Compound(data).streams
            self.data = streams.get("Workbook") or streams["Book"]
        except (ValueError, KeyError, IndexError, struct.error) as e:
            raise ValueError(f"{path}: not an XLS workbook") from e
        self.paths, self.late, self.shared, own, self.dates = {}, False, [], {}, []
        for kind, parts in self._records(0):
            r = _Parts(parts)
            if kind == 0x2F:
                raise ValueError(f"{path}: the workbook is encrypted")
            if kind == 0x22:
                self.late = r.number("<H") == 1
            elif kind == 0x85:
                start, _, sort = r.number("<I"), r.number("<B"), r.number("<B")
                if sort == 0:
                    n, wide = r.number("<B"), r.number("<B")
                    self.paths[r.letters(n, bool(wide & 1))] = start
            elif kind == 0xFC:
                r.number("<I")
                self.shared = [r.text() for _ in range(r.number("<I"))]
            elif kind == 0x41E:
                number = r.number("<H")
                own[number] = r.text()
            elif kind == 0xE0:
                r.number("<H")
                number = r.number("<H")
                self.dates.append(shows_date(number, own.get(number)))

    def _records(self, at: int) -> Iterator[tuple[int, list[bytes]]]:
        """Records of the part of the stream that begins here, up to its end, each with its continuations."""
        depth = 0
        while at + 4 <= len(self.data):
            kind, size = struct.unpack_from("<HH", self.data, at)
            parts = [self.data[at + 4 : at + 4 + size]]
            at += 4 + size
            while at + 4 <= len(self.data) and struct.unpack_from("<H", self.data, at)[0] == 0x3C:
                size = struct.unpack_from("<H", self.data, at + 2)[0]
                parts.append(self.data[at + 4 : at + 4 + size])
                at += 4 + size
            if kind == 0x809:
                depth += 1
            elif kind == 0x0A:
                depth -= 1
                if depth <= 0:
                    return
            elif depth == 1:
                yield kind, parts

    def sheet(self, name: str, limit: int | None = None) -> list[list]:
        cells, waiting = _Cells(limit), None
        for kind, parts in self._records(self.paths[name]):
            if kind == 0x207 and waiting:
                cells.put(*waiting, _Parts(parts).text())
                waiting = None
            if kind not in (0xFD, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x204, 0xD6):
                continue
            data = b"".join(parts)
            row, column, style = struct.unpack_from("<3H", data)
            if cells.full and row not in cells.rows:
                break
            date = lambda s: s < len(self.dates) and self.dates[s]
            if kind == 0xFD:
                cells.put(row, column, self.shared[struct.unpack_from("<I", data, 6)[0]])
            elif kind == 0x203:
                cells.put(row, column, number_of(struct.unpack_from("<d", data, 6)[0], date(style), self.late))
            elif kind == 0x27E:
                cells.put(row, column, number_of(_rk(struct.unpack_from("<I", data, 6)[0]), date(style), self.late))
            elif kind == 0xBD:
                for k, at in enumerate(range(4, len(data) - 2, 6)):
                    style, raw = struct.unpack_from("<HI", data, at)
                    cells.put(row, column + k, number_of(_rk(raw), date(style), self.late))
            elif kind == 0x205:
                cells.put(row, column, ERRORS.get(data[6], "#N/A") if data[7] else bool(data[6]))
            elif kind in (0x204, 0xD6):
                r = _Parts([parts[0][6:], *parts[1:]])
                n, flags = r.number("<H"), r.number("<B")
                cells.put(row, column, r.letters(n, bool(flags & 1)))
            elif data[12:14] == b"\xff\xff":  # a formula's result that is no number
                if data[6] == 0:
                    waiting = (row, column)
                else:
                    cells.put(row, column, {1: bool(data[8]), 2: ERRORS.get(data[8], "#N/A")}.get(data[6]))
            else:
                cells.put(row, column, number_of(struct.unpack_from("<d", data, 6)[0], date(style), self.late))
        return cells.all()
