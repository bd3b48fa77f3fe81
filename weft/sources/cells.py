"""What the workbook readers share: serial dates, number formats that show dates, used ranges."""

from __future__ import annotations

import datetime as dt
import re

from weft.functions.folding import text

#: Built-in number formats that show a date or time.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 47}
#: The built-in format of a duration, [h]:mm:ss.
DURATION_FORMAT = 46
#: Error codes of binary workbooks (fixed values).
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


def date_of(serial: float, late: bool) -> dt.datetime:
    """late: days count from 1904."""
    base = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)
    return base + dt.timedelta(seconds=int(round(serial * 86400)))


def shows_date(number: int, code: str | None) -> bool | None:
    """Whether a number format does: a built-in one, or one of the workbook's own with a letter for a part of a date outside of quotes and brackets. None: a duration."""
    if shows_duration(number, code):
        return None
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code or "")
    return number in DATE_FORMATS or bool(re.search("[ymdhs]", bare, re.IGNORECASE))


def shows_duration(number: int, code: str | None) -> bool:
    """Whether a number format does: hours, minutes or seconds in brackets, which count on beyond a day."""
    return number == DURATION_FORMAT or re.search(r"\[(h+|m+|s+)\]", re.sub(r'"[^"]*"|\\.', "", code or ""), re.IGNORECASE) is not None


def number_of(value: float, date: bool | None, late: bool):
    """A stored number as date, whole number or double; of a duration (date: None) the number's text."""
    if date is None:
        return text(float(value))
    if date:
        return date_of(value, late)
    return int(value) if value == value and abs(value) < 1 << 53 and value == int(value) else value


def rectangle(rows: dict[int, dict[int, object]]) -> list[list]:
    """The used range of {row: {column: value}}, empty cells as None."""
    if not rows:
        return []
    left, right = min(min(c) for c in rows.values()), max(max(c) for c in rows.values())
    return [[rows.get(r, {}).get(k) for k in range(left, right + 1)] for r in range(min(rows), max(rows) + 1)]
