"""Edits of the list of sources. Every function returns a new list; sources are known by (path, sheet name)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from weft.model import ColumnMapping, SourceTable
from weft.plans.headers import common_keys, header_key, suggest_mappings
from weft.sources.discovery import with_header


def _where(tables: list[SourceTable], change: Callable[[SourceTable], SourceTable], path: str | None, sheet: str | None) -> list[SourceTable]:
    chosen = lambda t: (path is None or t.path == path) and (sheet is None or t.sheet_name == sheet)
    return [change(t) if chosen(t) else t for t in tables]


def set_enabled(tables: list[SourceTable], enabled: bool, *, path: str | None = None, sheet: str | None = None) -> list[SourceTable]:
    """Of one source, of a whole workbook, or of all."""
    return _where(tables, lambda t: replace(t, enabled=enabled), path, sheet)


def toggle(tables: list[SourceTable], path: str, sheet: str) -> list[SourceTable]:
    return _where(tables, lambda t: replace(t, enabled=not t.enabled), path, sheet)


def removed(tables: list[SourceTable], path: str, sheet: str | None = None) -> list[SourceTable]:
    return [t for t in tables if t.path != path or sheet not in (None, t.sheet_name)]


def grouped(tables: list[SourceTable]) -> dict[str, list[SourceTable]]:
    """Sources by path, in the order of the list."""
    out: dict[str, list[SourceTable]] = {}
    for t in tables:
        out.setdefault(t.path, []).append(t)
    return out


def reload_all(tables: list[SourceTable], header_row: int, header_rows: int = 1, *, path: str | None = None) -> tuple[list[SourceTable], list[str]]:
    """Sources scanned again with another header, and warnings; one that fails stays as it was."""
    out, warnings = [], []
    for t in tables:
        if path not in (None, t.path):
            out.append(t)
            continue
        try:
            out.append(with_header(t, header_row, header_rows))
        except Exception as e:  # whatever one file holds must not lose the others
            out.append(t)
            warnings.append(f"{t.display_name}: {e}")
    return out, warnings


def apply_group_header(tables: list[SourceTable], path: str) -> tuple[list[SourceTable], list[str]]:
    """The header of a workbook's first source for all of its sources."""
    first = next((t for t in tables if t.path == path), None)
    return reload_all(tables, first.header_row, first.header_rows, path=path) if first else (tables, [])


def _mapped(table: SourceTable, change: Callable[[ColumnMapping], ColumnMapping]) -> SourceTable:
    return replace(table, mappings=tuple(change(m) for m in table.mappings))


def reset_mapping(table: SourceTable) -> SourceTable:
    """Every column under its own name, enabled, unchanged, the first value of a group."""
    return _mapped(table, lambda m: ColumnMapping(m.source_index, m.source_name, m.source_name))


def apply_suggestions(tables: list[SourceTable]) -> list[SourceTable]:
    """Suggested names as targets, in disabled sources too."""
    found = suggest_mappings(tables)
    return [_mapped(t, lambda m: replace(m, target_name=found.get(m.source_name, m.target_name))) for t in tables]


def reset_field(tables: list[SourceTable], name: str) -> list[SourceTable]:
    """A column of all enabled sources under its own name, enabled and unchanged; its aggregate stays."""
    key = name.strip()
    reset = lambda m: replace(m, target_name=m.source_name, enabled=True, transform="None") if m.source_name.strip() == key else m
    return [_mapped(t, reset) if t.enabled else t for t in tables]


@dataclass(frozen=True)
class MappingRow:
    mapping: ColumnMapping
    suggestion: str = ""


def mapping_rows(tables: list[SourceTable], table: SourceTable, *, hide_common: bool = False, differing: bool = False, text: str = "") -> list[MappingRow]:
    """The mappings of a table. hide_common: without columns of every source; differing: renamed or suggested ones only; text: part of a name."""
    shared, found, needle = common_keys(tables), suggest_mappings(tables), text.lower()
    rows = [MappingRow(m, found.get(m.source_name, "")) for m in table.mappings]
    if hide_common:
        rows = [r for r in rows if header_key(r.mapping.source_name) not in shared]
    if differing:
        rows = [r for r in rows if r.suggestion or header_key(r.mapping.source_name) != header_key(r.mapping.target_name)]
    return [r for r in rows if needle in r.mapping.source_name.lower() or needle in r.mapping.target_name.lower()]


def filter_groups(groups: Iterable[dict], *, shared_only: bool = False, text: str = "") -> list[dict]:
    """Of discovery.field_groups: those of two sources or more, and those whose name or target holds the text."""
    needle = text.lower()
    return [g for g in groups if (not shared_only or g["count"] >= 2) and (needle in g["name"].lower() or needle in (g["target_name"] or "").lower())]


def move_column(order: list[str], place: int, step: int) -> list[str]:
    """The output order with a column swapped with the one `step` places on, at most to an end."""
    out = list(order)
    if 0 <= place < len(out):
        other = min(max(place + step, 0), len(out) - 1)
        out[place], out[other] = out[other], out[place]
    return out


def split_names(text: str) -> list[str]:
    """Names between commas, ASCII or fullwidth; blank ones are dropped."""
    return [x.strip() for x in re.split("[,，]", text) if x.strip()]
