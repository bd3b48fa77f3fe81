"""Delimited text: delimiter and header inference on a byte sample, whole reads by Spark, UTF-8 or GBK field by field."""

from __future__ import annotations

import csv
import functools
import io
import itertools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.model import SourceTable
from weft.operators.merge import ROW
from weft.plans.headers import combine_header_rows, recommend_header
from weft.sources import stores

SAMPLE_BYTES, SAMPLE_RECORDS, HEADER_RECORDS, QUALITY_RECORDS = 256 * 1024, 30, 24, 50
#: A smaller file is one task anyway.
SPLIT_BYTES = 32 * 1024 * 1024
#: Rows of larger files are estimated by the records in so many ranges of so many bytes, spread over the whole file.
EXACT_COUNT_BYTES, RANGES, RANGE_BYTES = 64 * 1024 * 1024, 64, 64 * 1024
DELIMITERS = (",", "\t", ";", "|")


csv.field_size_limit(1 << 30)


class ScanError(ValueError):
    pass


def decode(field: bytes) -> tuple[str, bool]:
    """Text of a field and whether bytes were lost."""
    field = field.removeprefix(b"\xef\xbb\xbf")
    for name in ("utf-8", "gbk"):
        try:
            return field.decode(name), False
        except UnicodeDecodeError:
            pass
    return field.decode("gbk", "replace"), True


def head(path: str, size: int = SAMPLE_BYTES) -> bytes:
    with stores.opened(path) as f:
        return f.read(size)


def _reader(path: str, delimiter: str) -> Iterator[list[str]]:
    """Records of a file, bytes as Latin-1."""
    with stores.opened(path) as f:
        yield from csv.reader(io.TextIOWrapper(f, encoding="latin-1", newline=""), delimiter=delimiter)


def records(data: bytes, delimiter: str, limit: int) -> list[list[bytes]]:
    out = []
    for row in csv.reader(io.StringIO(data.decode("latin-1"), newline=""), delimiter=delimiter):
        if row:
            out.append([c.encode("latin-1") for c in row])
            if len(out) == limit:
                break
    return out


def detect_delimiter(path: str, data: bytes) -> str:
    """Of the four candidates the one whose records agree most on a large width; the earlier on ties."""
    if path.lower().endswith(".tsv"):
        return "\t"
    best, best_score = ",", None
    for delimiter in DELIMITERS:
        found = records(data, delimiter, SAMPLE_RECORDS)
        widths = Counter(map(len, found))
        if not widths:
            continue
        most = max(widths.values())
        width = next(len(r) for r in reversed(found) if widths[len(r)] == most)  # of widths as frequent the one seen last
        score = most * 100 + width * 50 - sum(widths.values()) - (10_000 if width == 1 else 0)
        if best_score is None or score > best_score:
            best, best_score = delimiter, score
    return best


def scan(path: str, *, delimiter: str | None = None, header_row: int | None = None, header_rows: int = 1, spark: SparkSession | None = None) -> tuple[SourceTable, list[str]]:
    """One table with its header, and warnings. With a session, tasks count the rows, exactly for any size."""
    data = head(path)
    delimiter = delimiter or detect_delimiter(path, data)
    rows = [[decode(c)[0] for c in r] for r in records(data, delimiter, HEADER_RECORDS)]
    suggested = recommend_header(rows) + 1
    header_row, header_rows = max(1, header_row or suggested), min(3, max(1, header_rows))
    last = header_row + header_rows - 1
    if last > len(rows):  # a header further down than the sample
        rows = [[decode(c.encode("latin-1"))[0] for c in r] for r in itertools.islice(filter(None, _reader(path, delimiter)), last)]
    if len(rows) < last:
        raise ScanError(f"{path}: too few rows for its header")
    broken = any(decode(c)[1] for r in records(data, delimiter, QUALITY_RECORDS) for c in r)
    warnings = [f"{path}: some text could not be decoded"] if broken else []
    return (
        SourceTable(
            path, "CSV", tuple(combine_header_rows(rows[header_row - 1 : last])), kind={"Csv": {"delimiter": ord(delimiter)}}, header_row=header_row,
            header_rows=header_rows, suggested_header_row=suggested, estimated_rows=count_rows(spark, path, delimiter, last) if spark else estimate_rows(path, delimiter, last)[0],
        ),
        warnings,
    )


def estimate_rows(path: str, delimiter: str, skipped: int) -> tuple[int, float]:
    """(rows, standard error): exact for small files; else by the records a byte in ranges over the whole file, each with its own start state."""
    size = stores.size(path)
    if size <= EXACT_COUNT_BYTES:
        return max(0, sum(1 for r in _reader(path, delimiter) if r) - skipped), 0.0
    width = Counter(len(r) for r in records(head(path), delimiter, SAMPLE_RECORDS)).most_common(1)[0][0]
    counted = []
    with stores.opened(path) as f:
        for k in range(RANGES):
            start = max(0, size - RANGE_BYTES) * k // (RANGES - 1)
            f.seek(start)
            lines = f.read(RANGE_BYTES).split(b"\n")
            counted.append(_records_in(lines[:-1] if start == 0 else lines[1:-1], delimiter, width, known=start == 0))
    n, read = map(sum, zip(*counted))
    rate = n / max(1, read)
    spread = sum((r - rate * b) ** 2 for r, b in counted) / (RANGES * (RANGES - 1))
    return max(0, round(size * rate) - skipped), size * spread**0.5 / max(1, read / RANGES)


def _records_in(lines: Sequence[bytes], delimiter: str, width: int, known: bool) -> tuple[int, int]:
    """(records, bytes) of whole lines from the middle of a file: whether they begin inside quotes is judged by how many records have the usual width."""
    best = (-1, 0, 0)
    for state in (0,) if known else (0, 1):
        whole, held, usual, n, read, inside = [], [], 0, 0, 0, state == 1
        for line in lines:
            if b'"' in line:
                state = 0 if _closing(delimiter)[state].fullmatch(line) else 1
            held.append(line)
            if state == 0:
                if not inside:  # the first record of this state began before the range
                    whole.append(b"\n".join(held))
                    read += sum(map(len, held)) + len(held)
                inside, held = False, []
        for row in records(b"\n".join(whole), delimiter, 1 << 60):
            n, usual = n + 1, usual + (len(row) == width)
        best = max(best, (usual, n, read), key=lambda x: x[0])
    return best[1:]


def _decoded(raw: Column) -> Column:
    """Text of a field's bytes."""
    bare = F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.substring(raw, 4, 2**31 - 1)).otherwise(raw)
    return F.when(F.is_valid_utf8(bare.cast("string")), bare.cast("string")).otherwise(F.decode(bare, "GBK"))


# Reading in splits. A line is a function from the state at its start (0: a record begins, 1: inside quotes) to that at its end, and so is a split of many lines.


@functools.cache
def _closing(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    """Of lines (bytes) that end outside quotes: those that begin a record, and those that begin inside quotes."""
    ends = re.escape(delimiter) + "\r"
    field = rf'(?:"(?:[^"]++|"")*+"[^{ends}]*+|[^"{ends}][^{ends}]*+|)'
    more = rf"(?:[{ends}]{field})*+"
    return re.compile((field + more).encode("latin-1")), re.compile(rf'(?:[^"]++|"")*+"[^{ends}]*+{more}'.encode("latin-1"))


def _bytes_of(text: str) -> int:
    """Of a size in Spark's settings, as 128MB or 134217728b."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, split): a file's lines, in the same splits whenever they are read. By itself Spark cuts a file for each pass anew, by the settings and the executors that there are then;
    so its scan is of a session of its own, whose settings stay."""
    most, least = (_bytes_of(spark.conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes"))
    tasks = int(spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism)
    own = spark.newSession()
    known = own.conf.getAll
    for k, v in spark.conf.getAll.items():
        if known.get(k) != v and own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(min(most, max(least, -(-stores.size(path) // tasks)))))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    lines = own.read.option("lineSep", "\n").text(path).select("value", F.spark_partition_id().alias("split"))  # of this file, whatever the task's number (in a union the task's is another)
    none = spark.range(1).filter("false").select(F.lit("").alias("value"), F.lit(0).alias("split"))  # goes when the plan is optimized; what follows is of the caller's session
    return none.unionByName(lines)


def _split_states(lines: DataFrame, delimiter: str) -> tuple[list[int], list[int], bool]:
    """For each split the state at its start and the split in which the record open there began; and whether any record goes over a line's end. The last values hold for all splits that follow.

    Every split is read for both states at once; one small row a split comes to the driver, which puts the functions together in order.
    """
    schema = pa.schema([("split", pa.int32()), *[(f"{c}{k}", pa.int32()) for k in (0, 1) for c in ("end", "wraps", "closes")]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, wraps, closes, split = [0, 1], [0, 1], [1, 0], None
        for batch in filter(len, batches):
            split = batch.column(1)[0].as_py()
            for line in batch.column(0).to_pylist():
                for k in (0, 1):
                    state[k] = 0 if _closing(delimiter)[state[k]].fullmatch(line) else 1
                    wraps[k] |= state[k]
                    closes[k] |= 1 - state[k]
        if split is None:
            return
        found = {"split": split} | {f"{c}{k}": x[k] for k in (0, 1) for c, x in (("end", state), ("wraps", wraps), ("closes", closes))}
        yield pa.record_batch([pa.array([found[f.name]], f.type) for f in schema], schema=schema)

    quoted = lines.filter(F.contains("value", F.lit('"'))).select(F.col("value").cast("binary"), "split")  # other lines change no state
    found = quoted.mapInArrow(task, "split int, end0 int, wraps0 int, closes0 int, end1 int, wraps1 int, closes1 int").collect()  # a row a split
    told = {r["split"]: r for r in found}
    state, begun, starts, opened, wrapped = 0, 0, [], [], False
    for split in range(max(told, default=-1) + 1):
        starts.append(state)
        opened.append(begun)
        if (r := told.get(split)) is None:
            continue
        wrapped = wrapped or bool(r[f"wraps{state}"])
        if r[f"closes{state}"]:
            begun = split
        state = r[f"end{state}"]
    return [*starts, state], [*opened, begun], wrapped


def _split_records(lines: DataFrame, delimiter: str, width: int, starts: list[int], opened: list[int], nulls: bool = False) -> DataFrame:
    """(__r, c0, c1, ..) with fields as bytes: records that lie in one split from there; the others put together from the pieces at the splits' ends. nulls: empty fields without quotes are null."""
    lines = lines.select(F.col("value").cast("binary"), "split")
    quoting = csv.QUOTE_NOTNULL if nulls else csv.QUOTE_MINIMAL
    end = len(starts) - 1
    fields = [(ROW, pa.int64()), *[(f"c{k}", pa.binary()) for k in range(width)]]
    columns = ", ".join([f"{ROW} long", *[f"c{k} binary" for k in range(width)]])

    def table(rows: list[list[str | None]], places: Sequence[int]) -> pa.RecordBatch:
        cells = [pa.array([r[k].encode("latin-1") if k < len(r) and r[k] is not None else None for r in rows], pa.binary()) for k in range(width)]
        return pa.record_batch([pa.array(places, pa.int64()), *cells], schema=pa.schema(fields))

    def parsed(text: bytes) -> list[list[str | None]]:
        return [r for r in csv.reader(io.StringIO(text.decode("latin-1"), newline=""), delimiter=delimiter, quoting=quoting) if r]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        state = None
        for batch in filter(len, batches):
            ready = []
            if state is None:
                split = batch.column(1)[0].as_py()
                state = starts[min(split, end)]
                skipping, held, n = state == 1, [], split << 33
            for line in batch.column(0).to_pylist():
                if b'"' in line:
                    state = 0 if _closing(delimiter)[state].fullmatch(line) else 1
                if not skipping:
                    held.append(line)
                if state == 0:
                    ready += held
                    held.clear()
                    skipping = False
            rows = parsed(b"\n".join(ready))
            yield table(rows, range(n, n + len(rows)))
            n += len(rows)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, out = None, [], []
        for batch in filter(len, batches):
            if state is None:
                split = batch.column(1)[0].as_py()
                state, ends_open = starts[min(split, end)], starts[min(split + 1, end)] == 1
                reading = state == 1
                owner = opened[min(split, end)] if reading else split
            if not reading and not ends_open:  # the rest has whole records only, one of which may lie over two batches
                held = []
                continue
            for line in batch.column(0).to_pylist():
                if b'"' in line:
                    state = 0 if _closing(delimiter)[state].fullmatch(line) else 1
                held.append(line)
                if state == 0:
                    if reading:
                        out.append((owner, b"\n".join(held)))
                    held, reading, owner = [], False, split
        if held:
            out.append((owner, b"\n".join(held)))
        if not out:
            return
        yield pa.record_batch([pa.array([o for o, _ in out], pa.int32()), pa.array([split] * len(out), pa.int32()), pa.array([t for _, t in out], pa.binary())], names=["owner", "split", "text"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for owner, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = parsed(b"\n".join(t["text"] for t in texts))
                last = (owner + 1 << 33) - 1  # after the split's own records
                yield table(rows, range(last + 1 - len(rows), last + 1))

    over = lines.mapInArrow(pieces, "owner int, split int, text binary").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("split", "text"))).alias("texts"))  # a record a group
    return lines.mapInArrow(whole, columns).unionByName(over.mapInArrow(joined, columns))


def count_rows(spark: SparkSession, path: str, delimiter: str, skipped: int) -> int:
    """Records of a file of any size, counted in its splits."""
    lines = _lines(spark, path)
    starts, opened, _ = _split_states(lines, delimiter)
    return max(0, _split_records(lines, delimiter, 0, starts, opened).count() - skipped)


def read(spark: SparkSession, table: SourceTable, *, split_bytes: int | None = None, nulls: bool = False) -> SourceTable:
    """The table with its rows: text only, ragged rows filled up or cut. Larger files are read in splits, whatever their fields hold; of a quote that never closes the file's last line end is lost.
    nulls: empty fields are null without quotes and empty texts within quotes. Else all are null where Spark reads the file, and empty texts where records go over lines' ends in splits."""
    width, delimiter = len(table.headers), chr(table.kind["Csv"]["delimiter"])
    small = stores.size(table.path) <= (split_bytes or SPLIT_BYTES)
    lines = None if small else _lines(spark, table.path)
    starts, opened, wrapped = ([], [], False) if small else _split_states(lines, delimiter)
    skipped = table.header_row + table.header_rows - 1
    if wrapped:
        raw = _split_records(lines, delimiter, width, starts, opened, nulls)
        return replace(table, frame=raw.filter(F.col(ROW) >= skipped).select(*[_decoded(F.col(f"c{k}")).alias(h) for k, h in enumerate(table.headers)], ROW), stable=True)
    legacy = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}
    before = {k: spark.conf.get(k, None) for k in legacy}
    for k, v in legacy.items():
        spark.conf.set(k, v)
    try:
        schema = ", ".join(f"c{k} string" for k in range(width))
        raw = spark.read.csv(table.path, schema=schema, sep=delimiter, encoding="ISO-8859-1", header=False, quote='"', escape='"', multiLine=small, inferSchema=False, mode="PERMISSIVE", nullValue="\u0100" if nulls else None)  # no letter of Latin-1
        frame = raw.withColumn(ROW, F.monotonically_increasing_id()).filter(F.col(ROW) >= skipped)
        frame = frame.select(*[_decoded(F.encode(F.col(f"c{k}"), "ISO-8859-1")).alias(h) for k, h in enumerate(table.headers)], ROW)
        frame.schema  # noqa: B018  resolved while the settings hold
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return replace(table, frame=frame, stable=True)


def check_widths(table: SourceTable, limit: int = 10_000) -> str | None:
    """A message if the first records do not all have one width."""
    width = None
    for n, row in enumerate(itertools.islice(_reader(table.path, chr(table.kind["Csv"]["delimiter"])), limit)):
        if row and width is not None and len(row) != width:
            return f"record {n + 1} has {len(row)} fields instead of {width}"
        if row:
            width = len(row)
    return None


def csv_frame(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, scan(path)[0]).frame
