"""Header names: normalising, comparing, planning of output columns. Metadata only, on the driver; many names are compared by Spark."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import SparkSession

from weft.model import SOURCE_FILE, SOURCE_SHEET, MergeOptions, SourceTable
from weft.operators import similar_names

SUGGEST, WARN, WARN_PAIRS = 0.62, 0.72, 8


def header_key(name: str) -> str:
    return name.strip().lower()


def normalize_headers(values) -> list[str]:
    out: list[str] = []
    used: set[str] = set()
    for k, value in enumerate(values, 1):
        base = (value or "").removeprefix("﻿").strip() or f"未命名列{k}"
        name, n = base, 2
        while header_key(name) in used:
            name, n = f"{base}_{n}", n + 1
        used.add(header_key(name))
        out.append(name)
    return out


def combine_header_rows(rows: list[list[str]]) -> list[str]:
    width = max((len(r) for r in rows), default=0)
    parts = [[r[i].strip() for r in rows if i < len(r) and r[i].strip()] for i in range(width)]
    return normalize_headers([" / ".join(dict.fromkeys(p)) for p in parts])


def recommend_header(rows: list[list[str]]) -> int:
    """Index of the row that looks most like a header, among the first 20: full, distinct, with letters, as wide as the next one, and early."""
    rows = rows[:20]
    widest = max((len(r) for r in rows), default=0)

    def score(k: int) -> int:
        filled = [c.strip() for c in rows[k] if c.strip()]
        letters = sum(any(ch.isalpha() for ch in c) for c in rows[k])
        as_wide = len(rows[k]) > 1 and k + 1 < len(rows) and len(rows[k + 1]) == len(rows[k])
        return len(filled) * 20 // max(1, widest) + 4 * len({c.lower() for c in filled}) + 3 * letters + 8 * as_wide - k

    return max(range(len(rows)), key=score, default=0)


def distinct_headers(names) -> list[str]:
    seen: dict[str, str] = {}
    for name in names:
        seen.setdefault(header_key(name), name)
    return list(seen.values())


def common_keys(tables: list[SourceTable]) -> set[str]:
    own = [{header_key(h) for h in t.headers} for t in tables if t.enabled]
    return set.intersection(*own) if len(own) > 1 else set()


@dataclass(frozen=True)
class OutputPlan:
    headers: tuple[str, ...]
    file_at: int | None = None
    sheet_at: int | None = None


def output_plan(tables: list[SourceTable], options: MergeOptions) -> OutputPlan:
    on = [t for t in tables if t.enabled]
    if options.mode == "Manual":
        names = distinct_headers(m.target_name.strip() for t in on for m in t.mappings if m.enabled and m.target_name.strip())
    elif options.mode == "Intersection":
        others = [{header_key(h) for h in t.headers} for t in on[1:]]
        names = [h for h in (on[0].headers if on else ()) if all(header_key(h) in o for o in others)]
    else:
        names = distinct_headers(h for t in on for h in t.headers)
    extra = {}
    for base, wanted in ((SOURCE_FILE, options.include_source_file), (SOURCE_SHEET, options.include_source_sheet)):
        if wanted:
            name, n, used = base, 2, {header_key(x) for x in names}
            while header_key(name) in used:
                name, n = f"_{base}{n}", n + 1
            names.append(name)
            extra[base] = name
    place = {header_key(x): k for k, x in enumerate(options.output_order)}
    names = sorted(names, key=lambda x: place.get(header_key(x), len(place) + len(names)))
    at = {base: names.index(name) for base, name in extra.items()}
    return OutputPlan(tuple(names), at.get(SOURCE_FILE), at.get(SOURCE_SHEET))


def sources_of(table: SourceTable, plan: OutputPlan, mode: str) -> dict[int, list[int]]:
    """Output place to the source places that feed it, in order."""
    place = {header_key(h): k for k, h in enumerate(plan.headers)}
    out: dict[int, list[int]] = {}
    if mode == "Manual":
        pairs = [(m.source_index, m.target_name.strip()) for m in table.mappings if m.enabled and m.target_name.strip()]
    else:
        pairs = list(enumerate(table.headers))
    for source, name in pairs:
        if (k := place.get(header_key(name))) is not None:
            out.setdefault(k, []).append(source)
    return out


def key_places(plan: OutputPlan, names) -> list[int]:
    """In output order; unknown names are ignored."""
    wanted = {header_key(n) for n in names}
    return [k for k, h in enumerate(plan.headers) if header_key(h) in wanted]


def aggregates_of(tables: list[SourceTable], plan: OutputPlan) -> list[str]:
    first: dict[str, str] = {}
    for table in tables:
        for m in table.mappings:
            first.setdefault(header_key(m.target_name), m.aggregate)
    return [first.get(header_key(h), "First") for h in plan.headers]


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def likeness(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1 - levenshtein(a, b) / longest if longest else 1.0


def suggest_mappings(tables: list[SourceTable]) -> dict[str, str]:
    """Headers of one table only, to the most alike header of two or more; ties to the first seen."""
    on = [t for t in tables if t.enabled]
    count: dict[str, int] = {}
    shown: dict[str, str] = {}
    for table in on:
        for key in dict.fromkeys(header_key(h) for h in table.headers):
            count[key] = count.get(key, 0) + 1
        for h in table.headers:
            shown.setdefault(header_key(h), h)
    shared = [k for k, n in count.items() if n > 1]
    lone = list(dict.fromkeys(header_key(h) for t in on for h in t.headers if shared and header_key(h) not in set(shared)))
    if len(lone) + len(shared) > similar_names.LOCAL and (spark := SparkSession.getActiveSession()):
        best = similar_names.best_of(spark, lone, shared, SUGGEST)
    else:
        best = {}
        for key in lone:
            score, place = max((likeness(key, s), -i) for i, s in enumerate(shared))
            if score >= SUGGEST:
                best[key] = shared[-place]
    return {h: shown[best[header_key(h)]] for t in on for h in t.headers if header_key(h) in best}


def similar_pairs(tables: list[SourceTable]) -> list[tuple[str, str, float]]:
    """The first WARN_PAIRS pairs of alike names, in order of the names. Many names are joined by Spark."""
    keys = list(dict.fromkeys(header_key(h) for t in tables if t.enabled for h in t.headers))
    if len(keys) > similar_names.LOCAL and (spark := SparkSession.getActiveSession()):
        return [(keys[a], keys[b], score) for a, b, score in similar_names.first_pairs(spark, keys, WARN, WARN_PAIRS)]
    close = ((a, b, likeness(a, b)) for i, a in enumerate(keys) for b in keys[i + 1 :] if abs(len(a) - len(b)) <= (1 - WARN) * max(len(a), len(b)) + 1e-9)
    return list(itertools.islice((x for x in close if WARN <= x[2] < 1), WARN_PAIRS))
