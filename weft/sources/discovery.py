"""Finding and scanning files: the list of sources of a job."""

from __future__ import annotations

import os
import tempfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import as_text
from weft.model import MergeOptions, SourceTable, load_scheme, save_scheme
from weft.operators.merge import ROW
from weft.sources import delimited, stores, workbook

EXTENSIONS = ("csv", "tsv", "xlsx", "xlsm", "xls", "xlsb", "ods")
#: Files scanned at a time.
WORKERS = 4


def supported(path: str) -> bool:
    name = os.path.basename(path)
    return not name.startswith("~$") and name.rpartition(".")[2].lower() in EXTENSIONS and "." in name


def collect(folder: str) -> list[str]:
    """The supported files below a local folder or one of a store."""
    return sorted(filter(supported, stores.files(folder)), key=str.lower)


def scan_file(path: str, **header) -> tuple[list[SourceTable], list[str]]:
    kind = path.rpartition(".")[2].lower()
    if kind in ("csv", "tsv"):
        table, warnings = delimited.scan(path, **header)
        return [table], warnings
    return workbook.scan(path, **header), []


def scan(paths: list[str]) -> tuple[list[SourceTable], list[str]]:
    """Tables in order of path and sheet, and warnings; a file that fails is a warning, unless nothing is left."""
    chosen = sorted({p for p in paths if supported(p)})
    if not chosen:
        raise ValueError("no supported file")

    def one(path: str) -> tuple[list[SourceTable], list[str]]:
        try:
            return scan_file(path)
        except Exception as e:  # whatever one file holds must not lose the others
            return [], [f"{path}: {e}"]

    with ThreadPoolExecutor(max(1, min(WORKERS, os.cpu_count() or 1, len(chosen)))) as pool:
        found = list(pool.map(one, chosen))
    tables, warnings = [t for ts, _ in found for t in ts], [w for _, ws in found for w in ws]
    if not tables and warnings:
        raise ValueError("; ".join(warnings))
    return sorted(tables, key=lambda t: (t.path.lower(), t.sheet_name.lower())), sorted(warnings)


def scan_stored(spark: SparkSession, folder: str) -> tuple[list[SourceTable], list[str]]:
    """Like scan, of all files below a folder of any store that Spark reads. Tasks scan workbooks and small delimited files, whose bytes they need whole;
    of larger delimited files, whatever their size, only a sample is fetched."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    chosen = files.filter(~name.startswith("~$") & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*EXTENSIONS) & F.contains(name, F.lit(".")))
    sampled = F.lower(name).rlike(r"\.(csv|tsv)$") & (F.col("length") > delimited.EXACT_COUNT_BYTES)

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with tempfile.TemporaryDirectory() as own:  # the task's own copy of one file
                    local = os.path.join(own, path.rsplit("/", 1)[-1])
                    with open(local, "wb") as f:
                        f.write(content.as_py())
                    try:
                        tables, warnings = scan_file(local)
                    except Exception as e:  # whatever one file holds must not lose the others
                        tables, warnings = [], [f"{local}: {e}"]
                job = save_scheme("", [replace(t, path=path) for t in tables], MergeOptions())
                yield pa.record_batch([pa.array([job]), pa.array([[w.replace(local, path) for w in warnings]], pa.list_(pa.string()))], names=["job", "warnings"])

    rows = chosen.filter(~sampled).select("path", "content").mapInArrow(task, "job string, warnings array<string>").collect()  # a line a file
    tables, warnings = [t for r in rows for t in load_scheme(r.job)[1]], [w for r in rows for w in r.warnings]
    if large := [r.path for r in chosen.filter(sampled).select("path").collect()]:
        more, said = scan(large)
        tables, warnings = tables + more, warnings + said
    if not tables:
        raise ValueError("; ".join(warnings) or "no supported file")
    return sorted(tables, key=lambda t: (t.path.lower(), t.sheet_name.lower())), sorted(warnings)


def load_all(spark: SparkSession, tables: list[SourceTable]) -> list[SourceTable]:
    """The tables with their rows; workbooks are read together, each once."""
    books = [t for t in tables if t.frame is None and not isinstance(t.kind, dict)]
    read = iter(workbook.read_all(spark, books) if books else ())
    return [t if t.frame is not None else delimited.read(spark, t) if isinstance(t.kind, dict) else next(read) for t in tables]


def load(spark: SparkSession, table: SourceTable) -> SourceTable:
    return load_all(spark, [table])[0]


def with_header(table: SourceTable, header_row: int, header_rows: int = 1) -> SourceTable:
    """The table with another header; mappings of columns whose names remain are kept."""
    if isinstance(table.kind, dict):
        new = delimited.scan(table.path, delimiter=chr(table.kind["Csv"]["delimiter"]), header_row=header_row, header_rows=header_rows)[0]
    else:
        new = workbook.scan(table.path, sheet=table.sheet_name, header_row=header_row, header_rows=header_rows)[0]
    old = {m.source_name: m for m in table.mappings}
    mappings = tuple(replace(old[m.source_name], source_index=m.source_index) if m.source_name in old else m for m in new.mappings)
    return replace(new, enabled=table.enabled, suggested_header_row=table.suggested_header_row, mappings=mappings)


def appended(existing: list[SourceTable], incoming: list[SourceTable]) -> list[SourceTable]:
    known = {(t.path, t.sheet_name) for t in existing}
    return sorted([*existing, *[t for t in incoming if (t.path, t.sheet_name) not in known]], key=lambda t: (t.path.lower(), t.sheet_name.lower()))


def preview(spark: SparkSession, table: SourceTable, n: int = 30) -> DataFrame:
    """The first rows of a source as text, before any mapping."""
    frame = load(spark, table).frame
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    return frame.orderBy(ROW).limit(n).select(*[as_text(F.col(f"`{h}`"), kinds[h]).alias(h) for h in table.headers])


def search(tables: list[SourceTable], text: str) -> list[SourceTable]:
    return [t for t in tables if text.lower() in f"{t.path} {t.sheet_name}".lower()]


def set_field(tables: list[SourceTable], source_name: str, **changes) -> list[SourceTable]:
    """Change a column's mapping in every enabled table that has it."""
    name = source_name.strip()
    return [replace(t, mappings=tuple(replace(m, **changes) if m.source_name.strip() == name else m for m in t.mappings)) if t.enabled else t for t in tables]


def field_groups(tables: list[SourceTable]) -> list[dict]:
    """Columns by name over the enabled tables, most frequent first; a setting that differs between tables is None."""
    groups: dict[str, list] = {}
    for t in tables:
        if t.enabled:
            for m in t.mappings:
                groups.setdefault(m.source_name.strip(), []).append((t.display_name, m))
    same = lambda values: next(iter(values)) if len(values) == 1 else None
    out = [
        {"name": n, "count": len(ms), "tables": [t for t, _ in ms], **{k: same({getattr(m, k) for _, m in ms}) for k in ("target_name", "enabled", "transform")}} for n, ms in groups.items()
    ]
    return sorted(out, key=lambda g: (-g["count"], g["name"]))
