"""Adding up cells one by one, in tasks: whole numbers exactly, others as doubles."""

from __future__ import annotations

import decimal
import re

from weft.functions.text import INTEGER, NUMBER

_INTEGER, _NUMBER = re.compile(INTEGER), re.compile(NUMBER)
#: Sums below it are numbers, larger whole ones are texts.
EXACT = 1e14
_WIDEST = 1 << 127


def text(value: str | float | None) -> str:
    """A double in plain digits."""
    if not isinstance(value, float):
        return value or ""
    if value != value or value in (float("inf"), float("-inf")):
        return "NaN" if value != value else "inf" if value > 0 else "-inf"
    out = format(decimal.Decimal(repr(value)), "f")
    return out.rstrip("0").rstrip(".") if "." in out else out


def _whole(value: str) -> int | None:
    if not _INTEGER.fullmatch(value):
        value = value.strip()
        if not _INTEGER.fullmatch(value):
            return None
    out = int(value)
    return out if -_WIDEST <= out < _WIDEST else None


def _number(value: str) -> float:
    """0 for what is no number."""
    bare = value.replace(",", "")
    return float(bare) if _NUMBER.fullmatch(bare) else 0.0


def _started(value: str) -> int | float:
    found = _whole(value)
    return _number(value) if found is None else found


def plus(one: int | float, two: str) -> int | float:
    """one: an exact whole sum, or a double, which is a whole number too if its digits are."""
    b = _whole(two)
    if b is not None:
        if isinstance(one, int):
            return one + b
        if one.is_integer() and abs(one) < _WIDEST:
            return int(one) + b
    return float(one) + _number(two)


def added(so_far: str | int | float | None, sum_of_wholes: str | None, values) -> str | int | float:
    """The sum so far (None: nothing yet; a text: one cell) with a block of values (an Arrow list), whose exact sum is known if all are whole."""
    texts = values.as_py()
    if so_far is None:
        if len(texts) == 1:
            return texts[0]
        if sum_of_wholes is not None:
            return int(sum_of_wholes)
        so_far = texts.pop(0)
    if isinstance(so_far, str):
        so_far = _started(so_far)
    if sum_of_wholes is not None and len(texts) > 1 and (isinstance(so_far, int) or so_far.is_integer() and abs(so_far) < _WIDEST):
        return int(so_far) + int(sum_of_wholes)
    for value in texts:
        so_far = plus(so_far, value)
    return so_far


def cell(so_far: str | int | float) -> str | float:
    """The cell of a sum: a text if it is one cell's, or whole and too long for a number to keep its digits."""
    return so_far if not isinstance(so_far, int) else float(so_far) if abs(so_far) < EXACT else str(so_far)
