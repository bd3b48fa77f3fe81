"""OpenDocument spreadsheets with the standard library: a reader of stored values."""

from __future__ import annotations

import datetime as dt
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from weft.sources.cells import rectangle

_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


class OpenDocument:
    """sheet(name) gives the used rows of a sheet as lists of None, str, int, float, bool or datetime."""

    def __init__(self, path: str):
        try:
            self.zip = zipfile.ZipFile(path)
            self.names = [e.get(f"{_TABLE}name") for _, e in self._events("start") if e.tag == f"{_TABLE}table"]
        except (zipfile.BadZipFile, KeyError) as e:
            raise ValueError(f"{path}: not an OpenDocument spreadsheet") from e
        self.paths = dict.fromkeys(self.names)

    def _events(self, *kinds: str) -> Iterator[tuple[str, ET.Element]]:
        with self.zip.open("content.xml") as f:
            yield from ET.iterparse(f, kinds)

    def sheet(self, name: str, limit: int | None = None) -> list[list]:
        rows: dict[int, dict[int, object]] = {}
        at, here = 0, False
        for kind, e in self._events("start", "end"):
            if e.tag == f"{_TABLE}table":
                here = kind == "start" and e.get(f"{_TABLE}name") == name
            elif here and kind == "end" and e.tag == f"{_TABLE}table-row":
                cells = self._cells(e)
                times = int(e.get(f"{_TABLE}number-rows-repeated", 1))
                if cells:
                    rows |= dict.fromkeys(range(at, at + times), cells)
                at += times
                e.clear()
                if limit and len(rows) >= limit:
                    break
        return rectangle(rows)

    @staticmethod
    def _cells(row: ET.Element) -> dict[int, object]:
        out: dict[int, object] = {}
        at = 0
        for c in row:
            if c.tag not in (f"{_TABLE}table-cell", f"{_TABLE}covered-table-cell"):
                continue
            times, value = int(c.get(f"{_TABLE}number-columns-repeated", 1)), _value(c)
            if value is not None:
                out |= dict.fromkeys(range(at, at + times), value)
            at += times
        return out


def _shown(c: ET.Element) -> str:
    return "\n".join("".join(p.itertext()) for p in c.iterfind(f"{_TEXT}p"))


def _value(c: ET.Element):
    kind = c.get(f"{_OFFICE}value-type")
    if kind in ("float", "percentage", "currency"):
        number = float(c.get(f"{_OFFICE}value"))
        return int(number) if number == int(number) and abs(number) < 1 << 53 else number
    if kind == "boolean":
        return c.get(f"{_OFFICE}boolean-value") == "true"
    if kind == "date":
        return dt.datetime.fromisoformat(c.get(f"{_OFFICE}date-value")).replace(microsecond=0, tzinfo=None)
    if kind == "time":
        return c.get(f"{_OFFICE}time-value")
    return (c.get(f"{_OFFICE}string-value") or _shown(c) or None) if kind == "string" else None
