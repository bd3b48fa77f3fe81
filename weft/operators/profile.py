"""Checks before a merge: capacity, missing and empty columns, mixed types, similar names, broken files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import NUMBER, as_text, trimmed
from weft.model import MergeOptions, SourceTable
from weft.plans.headers import header_key, output_plan, similar_pairs
from weft.sources import delimited, discovery, stores
from weft.sources.workbook import MAX_ROWS

LEVELS = {"Info": 0, "Warning": 1, "Error": 2}
SAMPLE = 100


def _cells(table: SourceTable, sample: int) -> DataFrame:
    """(key, v): cells of the first rows as trimmed text."""
    fields = {f.name: f.dataType for f in table.frame.schema.fields}
    cells = [F.struct(F.lit(header_key(h)).alias("key"), trimmed(as_text(F.col(f"`{h}`"), fields[h])).alias("v")) for h in table.headers]
    return table.frame.orderBy("__r").limit(sample).select(F.explode(F.array(*cells)).alias("x")).select("x.*").filter("coalesce(v, '') <> ''")


def _kinds(cells: DataFrame) -> DataFrame:
    kind = F.when(F.regexp_like("v", F.lit(NUMBER)), "数字").when(F.lower("v").isin("true", "false", "是", "否"), "布尔").otherwise("文本")
    return cells.groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n"))


def cell_kinds(table: SourceTable, sample: int = SAMPLE) -> DataFrame:
    """(key, kind, n) of non-empty values among the first rows: 数字, 布尔 or 文本."""
    return _kinds(_cells(table, sample))


def _sampled(spark: SparkSession, tables: list[SourceTable]) -> tuple[dict[str, set[str]], list[tuple[SourceTable, str]]]:
    """Kinds of the values of each column, over the first rows of all tables, and the tables that cannot be read with the reason. Tables that are
    not loaded yet are read here. One job for all, and one a table only if that fails."""
    cells, failed = [], []
    for t in tables:
        try:
            cells.append((t, _cells(discovery.load(spark, t), SAMPLE)))
        except Exception as e:  # told as an issue of this table
            failed.append((t, str(e).partition("\n")[0]))
    found: dict[str, set[str]] = {}

    def collect(some: list[DataFrame]) -> None:
        for r in _kinds(reduce(DataFrame.unionByName, some)).collect():
            found.setdefault(r.key, set()).add(r.kind)

    try:
        if cells:
            collect([c for _, c in cells])
    except Exception:  # some file is broken further down
        for t, c in cells:
            try:
                collect([c])
            except Exception as e:
                failed.append((t, str(e).partition("\n")[0]))
    return found, failed


def preflight(spark: SparkSession, tables: list[SourceTable], options: MergeOptions) -> DataFrame:
    """(level, title, detail), errors first. Files of any store are looked up, and sampled if they are not loaded; tables without frame and file are only planned."""
    found: list[tuple[str, str, str]] = []
    put = lambda *x: found.append(x)
    on = [t for t in tables if t.enabled]
    if not on:
        put("Error", "没有启用的表", "")
    plan = output_plan(tables, options)
    if on and not plan.headers:
        put("Error", "没有输出字段", "")
    if len(plan.headers) > 16_384:
        put("Error", "字段过多", str(len(plan.headers)))
    rows = sum(t.estimated_rows for t in on)
    files = {t.path: stores.exists(t.path) for t in on if t.kind != "DataFrame"}
    size = sum(stores.size(t.path) for t in on if files.get(t.path))
    put("Info", "数据规模", f"{rows} rows, {size} bytes")
    put("Info", "工作表数量", str(max(1, -(-rows // MAX_ROWS))))
    union = list(dict.fromkeys(header_key(h) for t in on for h in t.headers))
    for t in on:
        if not files.get(t.path, True):
            put("Error", "文件不存在", t.display_name)
            continue
        absent = len(set(union) - {header_key(h) for h in t.headers})
        if absent:
            put("Warning", "字段不一致", f"{t.display_name}: {absent}")
        blank = sum(h.startswith("未命名列") for h in t.headers)
        if blank:
            put("Warning", "空表头", f"{t.display_name}: {blank}")
        if isinstance(t.kind, dict) and (wrong := delimited.check_widths(t)):
            put("Error", "文件结构错误", f"{t.display_name}: {wrong}")
    readable = [t for t in on if t.frame is not None or t.path in files]
    kinds, failed = _sampled(spark, readable)
    for t, reason in failed:
        put("Error", "无法抽样读取", f"{t.display_name}: {reason}")
    for key in union if readable else ():
        if len(kinds.get(key, ())) > 1:
            put("Warning", "字段类型混合", f"{key}: {', '.join(sorted(kinds[key]))}")
        if key not in kinds:
            put("Warning", "字段全空", key)
    for a, b, score in similar_pairs(tables):
        put("Warning", "字段名相似", f"{a} / {b}: {score:.2f}")
    if options.mode in ("Consolidate", "Join") and not options.key_columns:
        put("Error", "缺少关键字段", options.mode)
    if options.filter_text.strip() and not options.filter_column.strip():
        put("Warning", "未选择筛选字段", options.filter_text)
    elif options.filter_text.strip() and header_key(options.filter_column) not in {header_key(h) for h in plan.headers}:
        put("Error", "筛选字段不存在", options.filter_column)
    ranked = sorted(found, key=lambda x: -LEVELS[x[0]])
    return spark.createDataFrame([(k, *x) for k, x in enumerate(ranked)], "seq int, level string, title string, detail string").orderBy("seq").drop("seq")


def report(issues: DataFrame) -> str:
    return "\n\n".join(f"[{r.level}] {r.title}\n{r.detail}" for r in issues.collect())
