"""Column expressions for the text semantics of merges. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\x1f"
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def trimmed(c: Column) -> Column:
    """Trim of Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(text: Column) -> Column:
    """A number's text (digits, point, perhaps an exponent) without exponent: its digits moved to their places."""
    exponent = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
    mantissa = F.ltrim(F.substring_index(text, "E", 1), F.lit("-"))
    parts = F.struct(
        F.when(F.startswith(text, F.lit("-")), "-").otherwise("").alias("sign"),
        F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0+$", "").alias("digits"),
        (F.char_length(F.substring_index(mantissa, ".", 1)) + exponent).alias("point"),
    )
    return _let(
        parts,
        lambda x: F.concat(
            x.sign,
            F.when(x.point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -x.point), x.digits))
            .when(x.point >= F.char_length(x.digits), F.rpad(x.digits, x.point, "0"))
            .otherwise(F.concat(F.substr(x.digits, F.lit(1), x.point), F.lit("."), F.substr(x.digits, x.point + 1))),
        ),
    )


def double_text(c: Column) -> Column:
    """The shortest digits that give the double back, without exponent or trailing point. Java 17 now and then writes more digits than are needed."""
    text = c.cast("string")

    def shortest(x: Column) -> Column:
        shorter = [F.regexp_replace(F.format_string(f"%.{n}e", x), r"e\+?", "E") for n in (14, 15, 16)]
        return F.coalesce(*[F.when(t.cast("double") == x, t) for t in shorter], x.cast("string"))

    return (
        F.when(F.isnan(c), "NaN")
        .when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when(F.char_length(text) >= 17, _let(_let(c, shortest), _placed))
        .when(F.contains(text, F.lit("E")), _let(text, _placed))
        .otherwise(F.regexp_replace(text, r"\.0$", ""))
    )


def as_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return double_text(c.cast("string").cast("double") if isinstance(kind, T.FloatType) else c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        midnight = (F.hour(c) == 0) & (F.minute(c) == 0) & (F.second(c) == 0)
        return F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return c.cast("string")


def is_empty(c: Column, kind: T.DataType) -> Column:
    return F.coalesce(c, F.lit("")) == "" if isinstance(kind, T.StringType) else c.isNull()


def transformed(c: Column, kind: T.DataType, operation: str) -> Column:
    """Any operation makes text of any type."""
    if operation == "None":
        return c
    text = trimmed(as_text(c, kind))
    return {"Trim": text, "Uppercase": F.upper(text), "Lowercase": F.lower(text)}[operation]


def row_key(columns: list[Column], kinds: list[T.DataType]) -> Column:
    """Key text: values as text, joined by U+001F; empty equals empty."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(as_text(c, k), F.lit("")) for c, k in zip(columns, kinds)])


def integer_of(c: Column) -> Column:
    text = trimmed(c)
    return F.when(F.regexp_like(text, F.lit(INTEGER)), text.try_cast(T.DecimalType(38, 0)))


def number_of(c: Column) -> Column:
    """Thousands commas dropped; no trim."""
    text = F.replace(c, F.lit(","), F.lit(""))
    return F.when(F.regexp_like(text, F.lit(NUMBER.replace("$", r"\z"))), text.try_cast(T.DoubleType()))
