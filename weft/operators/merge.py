"""The five merge shapes as lazy DataFrame plans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import folding
from weft.functions.text import SEPARATOR, as_text, integer_of, is_empty, number_of, row_key, transformed
from weft.model import MergeOptions, SourceTable
from weft.plans.headers import OutputPlan, aggregates_of, header_key, key_places, output_plan, sources_of

MAX_COLUMNS = 16_384
TABLE, ROW, KEY, BLOCK, N, NUMBER = "__t", "__r", "__key", "__b", "__n", "__k"
#: Places of a block of arrivals (a power of two), and the bound of sums that stay numbers.
BLOCK_BITS, EXACT = 8, 1e14


class MergeError(ValueError):
    pass


def from_df(df: DataFrame, name: str, sheet: str = "CSV", *, order: str | None = None, columns: list[str] | None = None) -> SourceTable:
    """A source of any DataFrame. order: a column of unique values that gives the rows' order (default: as they are read)."""
    columns = columns or [c for c in df.columns if not c.startswith("__")]
    ordinal = F.col(order) if order else F.monotonically_increasing_id()
    return SourceTable(name, sheet, tuple(columns), kind="DataFrame", frame=df.select(*[F.col(f"`{c}`") for c in columns], ordinal.alias(ROW)), stable=order is not None)


def _common_type(kinds: list[T.DataType]) -> T.DataType:
    return kinds[0] if kinds and all(k == kinds[0] for k in kinds) else T.StringType()


def _alike(tables: list[SourceTable]) -> list[list[int]]:
    """Places of the tables that may be read as one: sheets of one shape with the same mappings."""
    groups: dict[object, list[int]] = {}
    for k, t in enumerate(tables):
        groups.setdefault((id(t.family[0]), t.headers, t.mappings) if t.family else k, []).append(k)
    return list(groups.values())


def project(tables: list[SourceTable], places: list[int], plan: OutputPlan, mode: str) -> tuple[DataFrame, list[T.DataType | None]]:
    """Planned columns c0.. (absent ones missing), lineage and order, of one table or of some alike; of several sources of a column the first non-empty wins."""
    table = tables[places[0]]
    if len(places) == 1:
        frame, told = table.frame, lambda values: F.lit(values[0])
    else:
        numbers = [tables[k].family[1] for k in places]
        row = numbers == list(range(numbers[0], numbers[0] + len(numbers)))  # as of a whole workbook: no list of thousands of numbers in the plan
        frame = table.family[0].filter(F.col(NUMBER).between(numbers[0], numbers[-1]) if row else F.col(NUMBER).isin(numbers))
        at = dict(zip(numbers, range(len(numbers))))

        def told(values: list) -> Column:
            """A table's own value, by its number."""
            if row and isinstance(values[0], int) and values == list(range(values[0], values[0] + len(values))):
                return F.col(NUMBER) + F.lit(values[0] - numbers[0])
            return F.lit(values[0]) if len(set(values)) == 1 else F.get(F.array(*[F.lit(values[at.get(n, 0)]) for n in range(max(numbers) + 1)]), F.col(NUMBER))

    kinds = {f.name: f.dataType for f in frame.schema.fields}
    change = {}
    for m in table.mappings:
        change.setdefault(m.source_index, m.transform)
    columns: list[Column] = [told(places).alias(TABLE), F.col(ROW)]
    types: list[T.DataType | None] = [None] * len(plan.headers)
    for place, sources in sources_of(table, plan, mode).items():
        parts = []
        for s in sources:
            name, operation = table.headers[s], change.get(s, "None")
            kind = T.StringType() if operation != "None" else kinds[name]
            parts.append((transformed(F.col(f"`{name}`"), kinds[name], operation), kind))
        kind = _common_type([k for _, k in parts])
        if len(parts) > 1:
            cells = [c if k == kind else as_text(c, k) for c, k in parts]
            value = F.coalesce(*[F.when(~is_empty(c, kind), c) for c in cells])
        else:
            value = parts[0][0]
        types[place] = kind
        columns.append((place, value))
    for place, values in ((plan.file_at, [tables[k].file_name for k in places]), (plan.sheet_at, [tables[k].sheet_name for k in places])):
        if place is not None:
            columns = [c for c in columns if not (isinstance(c, tuple) and c[0] == place)]
            columns.append((place, told(values)))
            types[place] = T.StringType()
    return frame.select(*[c[1].alias(f"c{c[0]}") if isinstance(c, tuple) else c for c in columns]), types


def _aligned(tables: list[SourceTable], plan: OutputPlan, mode: str) -> tuple[list[DataFrame], list[T.DataType]]:
    projected = [project(tables, places, plan, mode) for places in _alike(tables)]
    known = lambda kind: kind is not None and not isinstance(kind, T.NullType)  # noqa: E731  an empty column of a sheet takes any type
    kinds = [_common_type([types[p] for _, types in projected if known(types[p])]) for p in range(len(plan.headers))]
    frames = []
    for frame, types in projected:
        cells = [
            (F.lit(None).cast(kind) if not known(own) else F.col(f"c{p}") if own == kind else as_text(F.col(f"c{p}"), own)).alias(f"c{p}") for p, (own, kind) in enumerate(zip(types, kinds))
        ]
        frames.append(frame.select(TABLE, ROW, *cells))
    return frames, kinds


def _filtered(df: DataFrame, plan: OutputPlan, kinds: list[T.DataType], options: MergeOptions) -> DataFrame:
    place = next((k for k, h in enumerate(plan.headers) if header_key(h) == header_key(options.filter_column)), None)
    if not options.filter_text or place is None:
        return df
    found = F.contains(F.lower(F.coalesce(as_text(F.col(f"c{place}"), kinds[place]), F.lit(""))), F.lower(F.lit(options.filter_text)))
    return df.filter(~found if options.filter_exclude else found)


def _key(places: list[int], kinds: list[T.DataType]) -> Column:
    return row_key([F.col(f"c{p}") for p in places], [kinds[p] for p in places])


def _ordered(values: Column, *, of: str = "v") -> Column:
    """The field of collected (table, place, value) structs, in order."""
    return F.transform(F.array_sort(F.collect_list(values)), lambda x: x[of])


@dataclass(frozen=True)
class _State:
    """What a block of a group's rows keeps of a column: one expression to make it and one to put the blocks' states together."""

    name: str
    made: Column
    joined: Callable[[Column], Column]


def _first(place: int, kind: T.DataType) -> _State:
    """The first non-empty cell, with its place."""
    c = F.col(f"c{place}")
    return _State(f"first{place}", F.min(F.when(~is_empty(c, kind), F.struct(TABLE, ROW, c.alias("v")))), F.min)


def _in_order(name: str, made: Column) -> _State:
    """A value a block, later an array of them in order of the blocks."""
    return _State(name, made, lambda c: _ordered(F.when(c.isNotNull(), F.struct(TABLE, BLOCK, c.alias("v")))))


def _states(place: int, kind: T.DataType, operation: str, separator: str, exact_fold: bool, cells: bool) -> tuple[list[_State], Column]:
    """The states of a column, and the result from them. A group of one row keeps its cell, as text."""
    c = F.col(f"c{place}")
    text, single = as_text(c, kind), F.col(N) == 1
    one = _State(f"one{place}", F.first(text), F.first)
    if operation == "First":
        return [_first(place, kind)], F.col(f"first{place}.v")
    full = F.coalesce(text, F.lit("")) != ""
    if operation == "TextJoin":
        held = _ordered(F.when(full, F.struct(TABLE, ROW, text.alias("v"))))
        state = _in_order(f"texts{place}", F.when(F.count_if(full) > 0, F.array_join(held, separator)))
        return [one, state], F.when(single, F.col(one.name)).otherwise(F.array_join(state.name, separator))
    if operation == "UniqueJoin" and not exact_fold:
        state = _in_order(f"texts{place}", F.array_distinct(_ordered(F.when(full, F.struct(TABLE, ROW, text.alias("v"))))))
        return [one, state], F.when(single, F.col(one.name)).otherwise(F.array_join(F.array_distinct(F.flatten(state.name)), separator))
    if operation == "UniqueJoin":  # a value that holds the separator counts wherever it stands, another one once
        value = F.coalesce(text, F.lit(""))
        held = F.transform(F.array_sort(F.collect_list(F.struct(TABLE, ROW, value.alias("v")))), lambda x: F.struct(x.v.alias("v"), F.when(F.contains(x.v, F.lit(separator)), F.struct(x[TABLE], x[ROW])).alias("at")))
        state = _in_order(f"texts{place}", F.array_distinct(held))
        last = _State(f"last{place}", F.max(F.struct(TABLE, ROW, value.alias("v"))), F.max)
        step, parts = _and_unique(separator)
        values = F.transform(F.flatten(state.name), lambda x: x.v)
        folded = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), step)
        whole = F.when(F.contains(F.col(f"{last.name}.v"), F.lit(separator)), folded).otherwise(F.array_join(parts(folded), separator))
        return [one, state, last], F.when(single, F.col(one.name)).otherwise(whole)
    count = _State(f"count{place}", F.count(c), F.sum)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        exact = T.DecimalType(38, kind.scale if isinstance(kind, T.DecimalType) else 0)  # the column's own scale; null beyond 38 digits
        total = _State(f"sum{place}", F.try_sum(c.cast(exact)).cast(exact), lambda x: F.try_sum(x).cast(exact))
        value = F.when(single | (F.col(count.name) > 0), F.col(total.name)).otherwise(F.lit(0).cast(exact))
        return [count, total], _cell(value.cast("double"), as_text(value, exact), (F.abs(value) < EXACT) | (single & (value.cast("double").cast(exact) == value))) if cells else value
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        total = _State(f"sum{place}", F.sum(c.cast("double")), F.sum)
        value = F.when(single | (F.col(count.name) > 0), F.col(total.name)).otherwise(F.lit(0.0))
        return [count, total], _cell(value, as_text(value, T.DoubleType()), single | (F.abs(value) < EXACT) | (F.rint(value) != value) | F.isnan(value)) if cells else value
    whole = integer_of(text)
    states = [one, _State(f"whole{place}", F.try_sum(whole), lambda x: F.try_sum(x)), _State(f"wholes{place}", F.count(whole), F.sum), _State(f"sum{place}", F.sum(F.coalesce(number_of(text), F.lit(0.0))), F.sum)]
    all_whole = (F.col(f"wholes{place}") == F.col(N)) & F.col(f"whole{place}").isNotNull()
    rounded = F.col(f"sum{place}")
    if cells:
        value = F.when(all_whole, F.col(f"whole{place}").cast("double")).otherwise(rounded)
        exact = F.when(single, F.col(one.name)).otherwise(F.col(f"whole{place}").cast("decimal(38,0)").cast("string"))
        return states, _cell(value, exact, ~single & (~all_whole | (F.abs(value) < EXACT)))
    return states, F.when(single, F.col(one.name)).when(all_whole, F.col(f"whole{place}").cast("decimal(38,0)").cast("string")).otherwise(as_text(rounded, T.DoubleType()))


def _cell(number: Column, text: Column, is_number: Column) -> Column:
    """A cell that is a number or a text, for the workbook writer."""
    return F.struct(F.when(is_number, number).alias("number"), F.when(~is_number, text).alias("text"))


def _and_unique(separator: str):
    """The parts so far, cut at the separator, and the next value unless it is one of them; and the cut."""
    parts = lambda a: F.filter(F.split(a, re.escape(separator)) if separator else F.split(a, ""), lambda x: x != "")
    return lambda a, b: F.array_join(F.when((b == "") | F.array_contains(parts(a), b), parts(a)).otherwise(F.concat(parts(a), F.array(b))), separator), parts


def _block(rows: DataFrame) -> Column:
    """Neighbours in order of arrival, BLOCK_ROWS places at most, where places are whole numbers; else a table is one block."""
    kind = rows.schema[ROW].dataType
    return F.shiftright(F.col(ROW).cast("long"), BLOCK_BITS) if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else F.lit(0).cast("long")


def _consolidated(rows: DataFrame, kinds: list[T.DataType], operations: list[str], separator: str, exact_fold: bool, cells: bool) -> DataFrame:
    """A row a key. Operations that need no order take one aggregation. Texts in order are put together block by block first, so that
    the rows of a hot key come from many tasks."""
    folds = [p for p, (k, op) in enumerate(zip(kinds, operations)) if exact_fold and op == "Sum" and isinstance(k, T.StringType)]
    made = {p: _states(p, k, op, separator, exact_fold, cells) for p, (k, op) in enumerate(zip(kinds, operations)) if p not in folds}
    states = [_State(N, F.count("*"), F.sum), *[s for found, _ in made.values() for s in found]]
    if any(op in ("TextJoin", "UniqueJoin") for op in operations):
        blocks = rows.withColumn(BLOCK, _block(rows)).groupBy(KEY, TABLE, BLOCK).agg(*[s.made.alias(s.name) for s in states])
        grouped = blocks.groupBy(KEY).agg(*[s.joined(F.col(s.name)).alias(s.name) for s in states])
    else:
        grouped = rows.groupBy(KEY).agg(*[s.made.alias(s.name) for s in states])
    out = grouped.select(KEY, *[value.alias(f"c{p}") for p, (_, value) in made.items()])
    return out.join(_folded(rows, folds, cells), KEY) if folds else out


def _folded(rows: DataFrame, places: list[int], cells: bool) -> DataFrame:
    """(key, sums): text added value by value in order of arrival, as spreadsheets are added up by hand.

    Whole numbers add exactly, so a block of them is one number while the sum so far is whole; otherwise doubles are rounded step by step. Blocks stream
    through a task sorted by key and place: it holds a block at a time, never a group.
    """
    text = lambda p: F.coalesce(F.col(f"c{p}"), F.lit(""))
    held = [
        x
        for p in places
        for x in (
            F.when(F.bool_and(integer_of(text(p)).isNotNull()), F.try_sum(integer_of(text(p))).cast("decimal(38,0)").cast("string")).alias(f"whole{p}"),
            _ordered(F.struct(TABLE, ROW, text(p).alias("v"))).alias(f"texts{p}"),
        )
    ]
    blocks = rows.withColumn(BLOCK, _block(rows)).groupBy(KEY, TABLE, BLOCK).agg(*held)
    kind = "struct<number: double, text: string>" if cells else "string"
    schema = f"{KEY} string, {', '.join(f'c{p} {kind}' for p in places)}"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: str, sums: list) -> pa.RecordBatch:
            sums = list(map(folding.cell, sums))
            if cells:
                made = [pa.array([{"number": x, "text": None} if isinstance(x, float) else {"number": None, "text": x}], pa.struct([("number", pa.float64()), ("text", pa.string())])) for x in sums]
            else:
                made = [pa.array([folding.text(x)], pa.string()) for x in sums]
            return pa.record_batch([pa.array([key], pa.string()), *made], names=[KEY, *[f"c{p}" for p in places]])

        now, sums = None, []
        for batch in batches:
            columns = batch.columns
            for k, key in enumerate(columns[0].to_pylist()):
                if key != now and now is not None:
                    yield row(now, sums)
                if key != now:
                    now, sums = key, [None] * len(places)
                for i in range(len(places)):
                    sums[i] = folding.added(sums[i], columns[1 + 2 * i][k].as_py(), columns[2 + 2 * i][k])
        if now is not None:
            yield row(now, sums)

    return blocks.repartition(KEY).sortWithinPartitions(KEY, TABLE, BLOCK).drop(TABLE, BLOCK).mapInArrow(task, schema)


def _named(df: DataFrame, plan: OutputPlan) -> DataFrame:
    return df.select(*[F.col(f"c{k}").alias(h) for k, h in enumerate(plan.headers)])


def by_workbook(tables: list[SourceTable]) -> list[SourceTable]:
    """Sheets of one workbook together, where its first one stands."""
    paths = list(dict.fromkeys(t.path for t in tables if t.kind == "Workbook"))
    first = {p: next(k for k, t in enumerate(tables) if t.path == p) for p in paths}
    return [t for _, t in sorted(enumerate(tables), key=lambda x: (first.get(x[1].path, x[0]) if x[1].kind == "Workbook" else x[0], x[0]))]


def merge(tables: list[SourceTable], options: MergeOptions, *, ordered: bool | None = None, exact_fold: bool = False, cells: bool = False) -> DataFrame:
    """The merged table.

    ordered: appended rows in order of arrival, others sorted by key (None: only the others; False: none, which saves a global sort).
    exact_fold: Sum of text and UniqueJoin value by value in order of arrival, as spreadsheets are added up by hand: doubles are rounded at each step, and a
    value that holds the separator is cut.
    cells: columns of Sum are structs (number, text), one of them null, so that a workbook gets numbers, and texts where a number would lose digits.
    """
    on = [t for t in tables if t.enabled]
    if options.mode not in ("Consolidate", "Join"):
        on = by_workbook(on)
    if not on:
        raise MergeError("no table is enabled")
    plan = output_plan(tables, options)
    if not plan.headers:
        raise MergeError("there are no output columns")
    if len(plan.headers) > MAX_COLUMNS:
        raise MergeError(f"more than {MAX_COLUMNS} columns")
    places = key_places(plan, options.key_columns)
    frames, kinds = _aligned(on, plan, options.mode)
    if options.mode not in ("Consolidate", "Join"):
        rows = _filtered(reduce(DataFrame.unionByName, frames), plan, kinds, options)
        if options.deduplicate:
            rows = _deduplicated(rows, places or list(range(len(plan.headers))), kinds)
        return _named(rows.orderBy(TABLE, ROW) if ordered else rows, plan)
    if not places:
        raise MergeError("no valid key column")
    if options.mode == "Consolidate":
        rows = _filtered(reduce(DataFrame.unionByName, frames), plan, kinds, options).withColumn(KEY, _key(places, kinds))
        operations = aggregates_of(on, plan)
        grouped = _consolidated(rows, kinds, operations, options.text_join_separator, exact_fold, cells)
        return _named(grouped if ordered is False else grouped.orderBy(KEY), plan)
    joined = _joined(frames, len(on), plan, kinds, places, options.join_kind)
    joined = _filtered(joined, plan, kinds, options)
    return _named(joined if ordered is False else joined.orderBy(KEY), plan)


def _deduplicated(rows: DataFrame, places: list[int], kinds: list[T.DataType]) -> DataFrame:
    """First arrival of each key. A partial minimum before the shuffle, so that a hot key is one row a task.

    Rows that are compared whole need no first one: they are grouped by their cells, in hash tables (empty equals empty). Times, whose text is shorter than
    their value, are the exception.
    """
    columns = [c for c in rows.columns if c not in (TABLE, ROW)]
    if len(places) == len(columns) and not any(isinstance(k, (T.TimestampType, T.TimestampNTZType)) for k in kinds):
        cells = [F.col(c) for c in columns]
        shown = [F.coalesce(c, F.lit("")) if isinstance(k, T.StringType) else c.cast("string") if isinstance(k, (T.DoubleType, T.FloatType)) else c for c, k in zip(cells, kinds)]
        missing = [F.bool_and(c.isNull()).alias(f"no{c_}") for c, c_, k in zip(cells, columns, kinds) if isinstance(k, T.StringType)]
        once = rows.groupBy(*[x.alias(c) for x, c in zip(shown, columns)]).agg(F.lit(True).alias("__one"), *missing)
        back = [F.when(~F.col(f"no{c}"), F.col(c)) if isinstance(k, T.StringType) else F.col(c).cast(k) for c, k in zip(columns, kinds)]
        return once.select(F.lit(0).alias(TABLE), F.lit(0).alias(ROW), *[x.alias(c) for x, c in zip(back, columns)])
    kept = rows.withColumn(KEY, _key(places, kinds)).groupBy(KEY).agg(F.min(F.struct(TABLE, ROW, *columns)).alias("m"))
    return kept.select("m.*")


def _joined(frames: list[DataFrame], many: int, plan: OutputPlan, kinds: list[T.DataType], places: list[int], kind: str) -> DataFrame:
    """All tables at once: a row a key with, per column, the first non-empty cell by table and row; which tables have the key tells whether it stays."""
    rows = reduce(DataFrame.unionByName, frames).withColumn(KEY, _key(places, kinds))
    bits = [F.bit_or(F.element_at(F.array(*[F.lit(1 << max(0, t - k) if k <= t < k + 63 else 0).cast("long") for t in range(many)]), F.col(TABLE) + 1)).alias(f"has{k}") for k in range(0, many, 63)]
    firsts = [_first(p, k) for p, k in enumerate(kinds)]
    grouped = rows.groupBy(KEY).agg(*bits, *[s.made.alias(s.name) for s in firsts])
    if kind == "Inner":
        grouped = grouped.filter(reduce(Column.__and__, [F.col(f"has{k}") == (1 << min(63, many - k)) - 1 for k in range(0, many, 63)]))
    elif kind == "Left":
        grouped = grouped.filter(F.col("has0").bitwiseAND(F.lit(1)) == 1)
    return grouped.select(KEY, *[F.col(f"{s.name}.v").alias(f"c{p}") for p, s in enumerate(firsts)])


def preview(tables: list[SourceTable], options: MergeOptions, n: int = 30, *, faithful: bool = True) -> DataFrame:
    """The first rows as text. faithful=False: quickly, of each table in turn, without transforms, filter, deduplication, aggregation or join; of several
    sources of a column the last one counts, empty or not."""
    if faithful:
        merged = merge(tables, options, ordered=True)
        return merged.limit(n).select(*[as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in merged.schema.fields])
    plan = output_plan(tables, options)
    parts = []
    for k, table in enumerate(t for t in tables if t.enabled):
        kinds = {f.name: f.dataType for f in table.frame.schema.fields}
        cells = {p: F.coalesce(as_text(F.col(f"`{table.headers[s[-1]]}`"), kinds[table.headers[s[-1]]]), F.lit("")) for p, s in sources_of(table, plan, options.mode).items()}
        cells |= {p: F.lit(v) for p, v in ((plan.file_at, table.file_name), (plan.sheet_at, table.sheet_name)) if p is not None}
        parts.append(table.frame.orderBy(ROW).limit(n).select(F.lit(k).alias(TABLE), ROW, *[cells.get(p, F.lit("")).alias(f"c{p}") for p in range(len(plan.headers))]))
    return _named(reduce(DataFrame.unionByName, parts).orderBy(TABLE, ROW).limit(n), plan)


def sheets(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """df with sheet (from 1) and row_in_sheet (from 1), `limit` rows a sheet in the given order.

    Rows are range-partitioned and numbered in their partition; the partitions' counts, one number each, give the offsets.
    """
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that rows and counts are dealt alike
    parts = df.repartitionByRange(many, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33))
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    at = F.col("__before") + F.col("__i")
    return parts.join(F.broadcast(before), "__p").withColumns({"sheet": F.floor(at / limit) + 1, "row_in_sheet": at % limit + 1}).drop("__p", "__i", "__before")


__all__ = ["MergeError", "SEPARATOR", "by_workbook", "from_df", "merge", "preview", "sheets"]
