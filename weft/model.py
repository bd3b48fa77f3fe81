"""Declarative merge jobs: sources with column mappings, and options. Field names follow the saved job format."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

MODES = ("Union", "Intersection", "Manual", "Consolidate", "Join")
TRANSFORMS = ("None", "Trim", "Uppercase", "Lowercase")
AGGREGATES = ("First", "Sum", "UniqueJoin", "TextJoin")
JOINS = ("Left", "Inner", "Full")
SOURCE_FILE, SOURCE_SHEET = "来源文件", "来源工作表"
FORMAT_VERSION = 1


@dataclass(frozen=True)
class ColumnMapping:
    source_index: int
    source_name: str
    target_name: str
    enabled: bool = True
    transform: str = "None"
    aggregate: str = "First"


@dataclass(frozen=True)
class SourceTable:
    path: str
    sheet_name: str
    headers: tuple[str, ...]
    kind: Any = "Workbook"
    header_row: int = 1
    header_rows: int = 1
    suggested_header_row: int = 1
    estimated_rows: int = 0
    enabled: bool = True
    mappings: tuple[ColumnMapping, ...] = ()
    frame: Any = field(default=None, compare=False, repr=False)
    #: Whether the frame's rows have the same place whenever they are read
    stable: bool = field(default=False, compare=False, repr=False)
    #: A frame of several tables of one shape, whose rows have this table's number in column __k; and the number
    family: Any = field(default=None, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "headers", tuple(self.headers))
        if not self.mappings:
            object.__setattr__(self, "mappings", tuple(ColumnMapping(i, h, h) for i, h in enumerate(self.headers)))

    @property
    def file_name(self) -> str:
        return self.path.replace("\\", "/").rsplit("/", 1)[-1]

    @property
    def display_name(self) -> str:
        return f"{self.file_name}  /  {self.sheet_name}"

    def with_mapping(self, source_name: str, **changes: Any) -> SourceTable:
        return replace(self, mappings=tuple(replace(m, **changes) if m.source_name == source_name else m for m in self.mappings))


@dataclass(frozen=True)
class MergeOptions:
    mode: str = "Union"
    include_source_file: bool = False
    include_source_sheet: bool = False
    output_order: tuple[str, ...] = ()
    deduplicate: bool = False
    key_columns: tuple[str, ...] = ()
    join_kind: str = "Left"
    text_join_separator: str = "；"
    filter_column: str = ""
    filter_text: str = ""
    filter_exclude: bool = False

    def __post_init__(self):
        if self.mode not in MODES or self.join_kind not in JOINS:
            raise ValueError(f"unknown mode or join: {self.mode}, {self.join_kind}")


def save_scheme(name: str, tables: list[SourceTable], options: MergeOptions) -> str:
    rows = [{k: v for k, v in asdict(replace(t, frame=None, family=None)).items() if k not in ("frame", "stable", "family")} for t in tables]
    return json.dumps({"format_version": FORMAT_VERSION, "name": name, "tables": rows, "options": asdict(options)}, ensure_ascii=False, indent=2)


def load_scheme(text: str) -> tuple[str, list[SourceTable], MergeOptions]:
    """Missing fields take their defaults; newer formats and impossible headers are refused."""
    data = json.loads(text)
    if data.get("format_version", FORMAT_VERSION) > FORMAT_VERSION:
        raise ValueError("the job was saved by a newer version")
    tables = []
    for row in data.get("tables", ()):
        row = {**row, "headers": tuple(row.get("headers", ())), "mappings": tuple(ColumnMapping(**m) for m in row.get("mappings", ()))}
        if row.get("header_row", 1) < 1 or not 1 <= row.get("header_rows", 1) <= 3:
            raise ValueError("表头设置无效")
        tables.append(SourceTable(**row))
    options = {k: tuple(v) if isinstance(v, list) else v for k, v in data.get("options", {}).items()}
    return data.get("name", ""), tables, MergeOptions(**options)
