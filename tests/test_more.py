"""Edge cases of sources, aggregates and runs that the registered queries do not show."""

import csv
import datetime as dt
import decimal
import io
import random
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from weft import settings
from weft.functions import edits
from weft.model import MergeOptions, SourceTable
from weft.operators.merge import by_workbook, from_df, merge
from weft.operators import similar_names
from weft.operators.profile import preflight
from weft.operators.run import Run
from weft.plans import headers
from weft.plans.headers import recommend_header
from weft.sources import catalog, cells, delimited, discovery, stores, workbook

ODS = """<?xml version="1.0" encoding="UTF-8"?><office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"
 xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><office:body><office:spreadsheet><table:table table:name="One"><table:table-row><table:table-cell office:value-type="string"><text:p>id</text:p></table:table-cell>
<table:table-cell office:value-type="string"><text:p>when</text:p></table:table-cell><table:table-cell office:value-type="string"><text:p>ok</text:p></table:table-cell></table:table-row>
<table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="float" office:value="7"/><table:table-cell office:value-type="date" office:date-value="2024-05-06"/>
<table:table-cell office:value-type="boolean" office:boolean-value="true"/><table:table-cell table:number-columns-repeated="1000"/></table:table-row>
<table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="1000"/></table:table-row></table:table>
<table:table table:name="Empty"/></office:spreadsheet></office:body></office:document-content>"""


def test_open_document(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.ods", "w") as z:
        z.writestr("content.xml", ODS)
    tables, warnings = discovery.scan([str(tmp_path / "a.ods")])
    assert [(t.sheet_name, t.headers, t.estimated_rows) for t in tables] == [("One", ("id", "when", "ok"), 2)] and not warnings
    rows = merge([discovery.load(spark, t) for t in tables], MergeOptions()).collect()
    assert [(r.id, str(r.when), r.ok) for r in rows] == [(7, "2024-05-06 00:00:00", True)] * 2


def test_one_bad_file_stops_nothing(tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "long.csv").write_text("a,b\n" + "x" * 200_000 + ",2\n")
    for name in ("bad.xlsx", "bad.ods"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/workbook.xml", "<not closed")
    tables, warnings = discovery.scan(discovery.collect(str(tmp_path)))
    assert [t.file_name for t in tables] == ["a.csv", "long.csv"] and len(warnings) == 2


def test_scan_by_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "~$b.csv").write_text("k,v\n1,2\n")
    (tmp_path / "bad.xlsx").write_text("no workbook")
    workbook.write(spark.createDataFrame([(3, "x")], "k int, v string"), str(tmp_path / "sub" / "b.xlsx"))
    with zipfile.ZipFile(tmp_path / "sub" / "c.ODS", "w") as z:
        z.writestr("content.xml", ODS)
    tables, warnings = discovery.scan_stored(spark, f"file://{tmp_path}")
    assert [(t.file_name, t.sheet_name, t.headers) for t in tables] == [("a.csv", "CSV", ("k", "v")), ("b.xlsx", "合并结果_001", ("k", "v")), ("c.ODS", "One", ("id", "when", "ok"))]
    assert len(warnings) == 1 and warnings[0].startswith(f"file:{tmp_path}/bad.xlsx")
    rows = merge([discovery.load(spark, t) for t in tables[:2]], MergeOptions()).collect()
    assert sorted((r.k, r.v) for r in rows) == [("1", "2"), ("3", "x")]
    again = discovery.with_header(tables[0], 2)  # on a stored path
    assert again.headers == ("1", "2") and discovery.with_header(tables[1], 1).headers == ("k", "v") and delimited.check_widths(again) is None
    monkeypatch.setattr(delimited, "EXACT_COUNT_BYTES", 1)  # every delimited file counts as large
    assert [t.file_name for t in discovery.scan_stored(spark, f"file://{tmp_path}")[0]] == ["a.csv", "b.xlsx", "c.ODS"]


def test_headers(tmp_path):
    assert recommend_header([["a", "a2", ""], ["2024-01-01", "10:00", "x-1"]]) == 0 and recommend_header([]) == 0
    (tmp_path / "deep.csv").write_text("".join(f"r{k},v\n" for k in range(31)))
    assert delimited.scan(str(tmp_path / "deep.csv"), header_row=30)[0].headers == ("r29", "v")
    with pytest.raises(delimited.ScanError):
        delimited.scan(str(tmp_path / "deep.csv"), header_row=32)
    assert delimited.detect_delimiter("x.csv", b"a,b,c\nd,e,f\ng,h\ni,j\n") == ","


@pytest.fixture
def small_splits(spark, monkeypatch):
    monkeypatch.setattr(delimited, "SPLIT_BYTES", 10)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, size)
    spark.conf.set(key, before)


def test_large_files_are_split(spark, tmp_path, small_splits):
    path = tmp_path / "plain.csv"
    path.write_text("title\nk,v\n" + "".join(f'{k},"x ""{k}"" y"\n' for k in range(60_000)))
    small_splits("100k")
    t = delimited.read(spark, delimited.scan(str(path))[0])
    rows = t.frame.orderBy("__r").collect()
    assert t.frame.rdd.getNumPartitions() > 3 and [(r.k, r.v) for r in rows] == [(str(k), f'x "{k}" y') for k in range(60_000)]


@pytest.mark.parametrize("size", ["5k", "50k"])
@pytest.mark.parametrize("delimiter, end", [(",", "\n"), ("|", "\r\n")])
def test_records_over_line_ends_are_read_in_splits(spark, tmp_path, small_splits, size, delimiter, end):
    """Quotes that open, close, stand inside fields or never close; records over many splits; equal to csv.reader's."""
    rng = random.Random(size + delimiter)
    fields = ["x", "", '5" pipe', '"a"', '"a' + delimiter + 'b"', '"line' + end + 'two ""q""' + end + '"', '"' + end * 3 + '"', '"tail"more"x', 'é"', '"' + (("y" * 37 + "\n") * 200) + '"', '" ""' + end + '"" "', "lone\rturn"]
    lines = [delimiter.join(rng.choices(fields, weights=[9, 3, 1, 3, 2, 2, 1, 1, 1, 0.3, 1, 0.2], k=rng.randint(1, 4))) for _ in range(500)]
    for name, tail in (("closed.csv", ""), ("open.csv", 'z' + delimiter + '"never' + end + "closed" + end + "x")):
        path = tmp_path / name
        path.write_bytes(("k" + delimiter + "v" + delimiter + "w" + end + end.join(lines) + end + tail).encode())
        want = [r for r in csv.reader(open(path, newline="", encoding="utf-8"), delimiter=delimiter) if r][1:]
        small_splits(size)
        t = delimited.read(spark, delimited.scan(str(path), delimiter=delimiter, header_row=1)[0])
        assert len(t.headers) == 3 and t.frame.rdd.getNumPartitions() > 3
        rows = t.frame.orderBy("__r").collect()
        assert [tuple(r)[:3] for r in rows] == [tuple((r + [None] * 3)[:3]) for r in want]


def test_split_records_over_batches_and_in_unions(spark, tmp_path, small_splits):
    """A record that lies over two batches of a split is not taken for one over two splits; in a union a file's splits keep their numbers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    paths = []
    for name in "ab":
        paths.append(tmp_path / f"{name}.csv")
        paths[-1].write_text("k,v\n" + "".join(f'{name}{k},"one\ntwo {k}\nthree"\n' for k in range(3000)))
    small_splits("20k")
    spark.conf.set(key, "50")
    try:
        tables = [delimited.read(spark, delimited.scan(str(p))[0]) for p in paths]
        both = tables[0].frame.unionByName(tables[1].frame).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.k, r.v) for r in both) == sorted((f"{n}{k}", f"one\ntwo {k}\nthree") for n in "ab" for k in range(3000))


def test_splits_stay_when_settings_change(spark, tmp_path, small_splits):
    """Rows are those of the splits whose states were found, though Spark would cut the file otherwise by the time they are read."""
    path = tmp_path / "a.csv"
    path.write_text("k,v\n" + "".join(f'{k},"one\ntwo {k}\nthree"\n' for k in range(3000)))
    for before, after in (("20k", "50k"), ("50k", "20k")):
        small_splits(before)
        frame = delimited.read(spark, delimited.scan(str(path))[0]).frame
        small_splits(after)
        assert [(r.k, r.v) for r in frame.orderBy("__r").collect()] == [(str(k), f"one\ntwo {k}\nthree") for k in range(3000)]
        assert frame.sparkSession is spark


@pytest.mark.parametrize("n, filler", [(300, 20), (9000, 300)])
def test_quoted_lines_of_odd_texts(spark, tmp_path, n, filler):
    """Null, empty and marked texts, in small files and in splits: equal to the query's SQL."""
    import duckdb
    from weft.plans.catalogue import ORACLES, QUERIES

    odd = [None, "", "\r", "\ufeff", "\ufeff\ufeffx", '"', '""', "\n", " ", "\t a ", ",", "\\", "a\n\nb", '\ufeff"a\n"', "NULL", "\x00", "\x85"]
    rows = [(k, odd[k % len(odd)] if k % 3 else f"line {k}\n" + "x" * filler, [None, "", "src", "\ufeffs"][k % 4]) for k in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["csv_quoted_lines"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["csv_quoted_lines"]).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_rows_are_counted_by_tasks(spark, tmp_path, monkeypatch):
    """Exact where an estimate would not be; text of a store is fetched by blocks, not by a reader's few KB."""
    path = tmp_path / "long.csv"
    path.write_text("k,v\n" + "".join(f'{k},"{"x" * (k % 977)}\n"\n' if k % 3 else f"{k},\n\n" for k in range(20_000)))
    monkeypatch.setattr(delimited, "EXACT_COUNT_BYTES", 1000)
    monkeypatch.setattr(delimited, "RANGES", 8)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        assert delimited.scan(f"file:{path}", spark=spark)[0].estimated_rows == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    fetched = []
    with stores.opened(f"file:{path}") as f:
        stream, f.raw.stream = f.raw.stream, type("Counted", (), {"readNBytes": lambda _, n: fetched.append(n) or stream.readNBytes(n), "close": lambda _: stream.close()})()
        assert len(io.TextIOWrapper(f, encoding="latin-1", newline="").readlines()) > 20_000
    assert len(fetched) <= path.stat().st_size // stores.BLOCK + 2


def test_estimate_of_rows(spark, tmp_path, monkeypatch):
    """Rows whose length changes half-way, some over line ends, on a local path and a stored one."""
    path = tmp_path / "big.csv"
    with open(path, "w") as f:
        f.write("k,v\n")
        for k in range(90_000):
            f.write(f'{k},"{"x" * 20}"\n' if k < 60_000 else f'{k},"{"long text " * 9}\nand ""more"""\n')
    monkeypatch.setattr(delimited, "EXACT_COUNT_BYTES", 1000)
    for where in (str(path), f"file:{path}"):
        rows, error = delimited.estimate_rows(where, ",", 1)
        assert abs(rows - 90_000) < 1_800 and error < 9_000
        assert abs(delimited.scan(where)[0].estimated_rows - 90_000) < 1_800


def _sum(spark, values, kind, **more):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], f"k int, o long, v {kind}")
    return merge([from_df(df, "x.csv", order="o", columns=["k", "v"]).with_mapping("v", aggregate="Sum")], MergeOptions("Consolidate", key_columns=("k",)), **more).first().v


def test_sums(spark):
    d = decimal.Decimal
    assert _sum(spark, [d("1.50"), d("2.25")], "decimal(10,2)") == d("3.75") and _sum(spark, [d("1.50")], "decimal(10,2)") == d("1.50")
    assert _sum(spark, [None, None], "decimal(10,2)") == 0 and _sum(spark, [None], "decimal(10,2)") is None
    assert _sum(spark, [d(10) ** 37 * 9] * 3, "decimal(38,0)") is None
    fold = lambda *v: _sum(spark, v, "string", exact_fold=True)
    assert fold("1,234") == "1,234" and fold("9007199254740993", "") == "9007199254740992" and fold("9007199254740992", "1") == "9007199254740993"
    assert fold("1.5", "2.5", "3") == "7" and fold("", "") == "0" and fold("abc", " 1.5") == "0" and fold(" 5", "+6") == "11"


def test_unique_join_cuts_at_the_separator(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(["a|b", "b", "", "c|a", "c"])], "k int, o long, v string")
    t = from_df(df, "x.csv", order="o", columns=["k", "v"]).with_mapping("v", aggregate="UniqueJoin")
    options = MergeOptions("Consolidate", key_columns=("k",), text_join_separator="|")
    assert merge([t], options, exact_fold=True).first().v == "a|b|c|a"  # the last c is a part of the value put in before
    assert merge([t], options).first().v == "a|b|b|c|a|c"


def test_catalog():
    a, b = SourceTable("w.xlsx", "A", ("x",)), SourceTable("w.xlsx", "B", ("x",))
    c = SourceTable("c.csv", "CSV", ("x",), kind={"Csv": {"delimiter": 44}})
    assert by_workbook([b, c, a]) == [b, a, c] and by_workbook([c, a]) == [c, a]
    again, warnings = catalog.reload_all([a], 1)
    assert again == [a] and len(warnings) == 1
    assert catalog.apply_group_header([c], "none") == ([c], [])


def test_settings(tmp_path):
    path = str(tmp_path / "new" / "settings.json")
    assert settings.Settings.load(path) == settings.Settings()
    kept = settings.Settings("folder", ["a"], [])
    kept.save(path)
    assert settings.Settings.load(path) == kept
    items = []
    for k in range(10):
        items = settings.remember(items, str(k))
    assert items == [str(k) for k in range(9, 1, -1)] and settings.remember(items, "5")[:2] == ["5", "9"]
    settings.log(str(tmp_path / "logs" / "x.log"), "done")
    assert (tmp_path / "logs" / "x.log").read_text().endswith("] done\n")


def test_run(spark, tmp_path):
    seen = []
    run = Run(spark.range(100).select(F.col("id").alias("x")), lambda df: workbook.write(df, str(tmp_path / "a.xlsx")), seen.append)
    out = run.wait(60)
    assert (out.state, out.result) == ("finished", (100, 1)) and seen == [out] and run.progress()[0] > 0
    seen_rows = []
    run = Run(spark.range(0, 9000, 1, 3), lambda df, told: workbook.write(df, str(tmp_path / "rows.xlsx"), told=lambda *x: (told(*x), seen_rows.append(run.rows()))))
    assert run.wait(60).state == "finished" and seen_rows == sorted(seen_rows) and len(seen_rows) > 3 and run.rows() == seen_rows[-1] == (9000, 9000)
    stopped = []
    run = Run(spark.range(0, 9000, 1, 3), lambda df, told: workbook.write(df, str(tmp_path / "stopped.xlsx"), told=lambda *x: (stopped or run.cancel(), stopped.append(x), told(*x))))
    assert run.wait(60).state == "cancelled" and not (tmp_path / "stopped.xlsx").exists() and len(stopped) == 1
    assert Run(spark.range(3), lambda df: 1 / 0).wait(60).state == "failed"
    slow = spark.range(8).repartition(8).select(F.expr("reduce(sequence(1, 200000000), 0L, (a, x) -> a + x)").alias("x"))
    run = Run(slow, lambda df: workbook.write(df, str(tmp_path / "b.xlsx")))
    run.wait(2)
    run.cancel()
    assert run.wait(60).state == "cancelled" and not (tmp_path / "b.xlsx").exists()


def _fold(values):
    """Cells added up one by one, by the definition: whole numbers exactly, others as doubles; a whole sum of 1e14 and more is a text."""
    plain = lambda x: x if isinstance(x, str) else format(decimal.Decimal(repr(x)), "f").removesuffix(".0")
    whole = lambda x: int(plain(x).strip()) if re.fullmatch(r"[+-]?[0-9]+", plain(x).strip()) else None
    double = lambda x: float(x.replace(",", "")) if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", x.replace(",", "")) else 0.0
    now = values[0]
    for v in values[1:]:
        if whole(now) is not None and whole(v) is not None:
            total = whole(now) + whole(v)
            now = float(total) if abs(total) < 1e14 else str(total)
        else:
            now = (now if isinstance(now, float) else double(now)) + double(v)
    return now


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_folds_are_composed_of_blocks(spark, monkeypatch, bits):
    """Sums and unique texts value by value, with groups over many blocks and a hot key."""
    monkeypatch.setattr("weft.operators.merge.BLOCK_BITS", bits)
    rng = random.Random(bits)
    kinds = [lambda: str(rng.randint(-50, 50)), lambda: f"{rng.uniform(-9, 9):.2f}", lambda: f" {rng.randint(0, 9)}", lambda: "", lambda: "x|y", lambda: "1,250", lambda: str(10**14 + rng.randint(0, 99)), lambda: "1e3", lambda: "0.5", lambda: "a||b"]
    groups = {"whole": (1, 0, 0, 0, 0, 0, 0, 0, 0, 0), "large": (3, 0, 0, 0, 0, 0, 2, 0, 0, 0), "late": (9, 0, 0, 0, 0, 0, 0, 0, 0, 0), "mixed": (5, 3, 1, 1, 1, 1, 1, 1, 4, 1), "halves": (3, 0, 0, 0, 0, 0, 0, 0, 3, 0), "one": (0, 0, 1, 0, 0, 0, 0, 0, 0, 0), "empty": (0, 0, 0, 1, 0, 0, 0, 0, 0, 0)}
    values = {k: [f() for f in rng.choices(kinds, w, k=1 if k == "one" else 2 if k == "empty" else 150 if k != "mixed" else 2500)] for k, w in groups.items()}
    values["late"] += ["0.1", "7", "0.9", "3"]
    rows = [(k, v) for k, vs in values.items() for v in vs]
    order = list(range(len(rows)))
    rng.shuffle(order)  # which rows lie between a group's own
    queues = {k: iter(vs) for k, vs in values.items()}
    arrivals = [(i, rows[j][0], next(queues[rows[j][0]])) for i, j in enumerate(order)]
    first, second = ([(i, k, v, v, v) for i, k, v in arrivals if (i < len(rows) // 2) == half] for half in (True, False))
    made = []
    for name, part in (("a.csv", first), ("b.csv", second)):
        t = from_df(spark.createDataFrame(part, "o long, k string, s string, u string, t string").repartition(7), name, order="o", columns=["k", "s", "u", "t"])
        made.append(t.with_mapping("s", aggregate="Sum").with_mapping("u", aggregate="UniqueJoin").with_mapping("t", aggregate="TextJoin"))
    options = MergeOptions("Consolidate", key_columns=("k",), text_join_separator="|")
    exact = {r.k: r for r in merge(made, options, exact_fold=True, cells=True).collect()}
    plain = {r.k: r for r in merge(made, options).collect()}
    for k, vs in values.items():
        want = _fold(vs)
        assert (exact[k].s.number, exact[k].s.text) == ((want, None) if isinstance(want, float) else (None, want)), k
        parts = vs[0]
        for v in vs[1:]:
            had = [x for x in parts.split("|") if x]
            parts = "|".join([*had, v] if v and v not in had else had)
        assert exact[k].u == parts and plain[k].u == (vs[0] if len(vs) == 1 else "|".join(dict.fromkeys(v for v in vs if v)))
        assert exact[k].t == plain[k].t == (vs[0] if len(vs) == 1 else "|".join(v for v in vs if v))
        if k in ("whole", "large", "one"):
            assert plain[k].s == (want if isinstance(want, str) else str(int(want)))


def test_sums_are_numbers_in_a_workbook(spark, tmp_path):
    rows = [(1, "a", "10", 2**60, 1.5), (2, "a", "20", 2**60, 2.5), (3, "b", "70000000000000", 1, 7e13), (4, "b", "70000000000000", 2, 7e13), (5, "c", "007", 2**53 + 1, 5e15), (6, "d", "x", 2**60, None), (7, "d", "1.5", 0, None)]
    t = from_df(spark.createDataFrame(rows, "o long, k string, t string, n long, x double"), "x.csv", order="o", columns=["k", "t", "n", "x"])
    for name in ("t", "n", "x"):
        t = t.with_mapping(name, aggregate="Sum")
    options = MergeOptions("Consolidate", key_columns=("k",))
    for k, exact in enumerate((False, True)):
        path = str(tmp_path / f"{k}.xlsx")
        workbook.write(merge([t], options, exact_fold=exact, cells=True), path)
        book = workbook.Workbook(path)
        assert book.sheet(next(iter(book.paths)))[1:] == [["a", 30, str(2**61), 4], ["b", "140000000000000", 3, "140000000000000"], ["c", "007", str(2**53 + 1), 5 * 10**15], ["d", 1.5, str(2**60), 0]]
    workbook.write(merge([t], options), str(tmp_path / "plain.xlsx"))
    book = workbook.Workbook(str(tmp_path / "plain.xlsx"))
    assert [r[2] for r in book.sheet(next(iter(book.paths)))[1:]] == [str(2**61), 3, str(2**53 + 1), str(2**60)]


def test_joins_of_many_tables(spark):
    """Against a join table by table; more tables than a word has bits."""
    rng = random.Random(6)
    tables = [[(o, rng.choice(["", "k1", "k2", "k3", "k4", f"own{n}"]) if n % 3 else "k1", rng.choice([None, "", f"a{n}"]), rng.choice([None, n])) for o in range(3)] for n in range(70)]
    for many in (2, 70):
        made = [from_df(spark.createDataFrame(rows, "o int, k string, a string, b int"), f"{n}.csv", order="o", columns=["k", "a", "b"]) for n, rows in enumerate(tables[:many])]
        for kind in ("Left", "Inner", "Full"):
            out = None
            for rows in tables[:many]:
                here = {}
                for _, k, a, b in rows:
                    had = here.setdefault(k, [a, b])
                    here[k] = [a if not had[0] else had[0], b if had[1] is None else had[1]]
                if out is None:
                    out = here
                    continue
                out = {k: [x if x not in (None, "") else here.get(k, v)[i] for i, x in enumerate(v)] for k, v in out.items() if kind != "Inner" or k in here} | ({k: v for k, v in here.items() if k not in out} if kind == "Full" else {})
            got = merge(made, MergeOptions("Join", key_columns=("k",), join_kind=kind)).collect()
            assert [(r.k or "", r.a or "", r.b) for r in got] == [(k, v[0] or "", v[1]) for k, v in sorted(out.items())]


def test_whole_rows_are_deduplicated_by_their_cells(spark):
    rows = [(1, "x", -0.0, None), (2, "x", 0.0, None), (3, "x", -0.0, ""), (4, "", float("nan"), "y"), (5, None, float("nan"), "y"), (6, "x", 1e-300, "y"), (7, "x", 2e-300, "y"), (8, "x", 1e-300, "y")]
    t = from_df(spark.createDataFrame(rows, "o int, a string, d double, b string"), "x.csv", order="o", columns=["a", "d", "b"])
    got = merge([t], MergeOptions(deduplicate=True)).collect()
    assert sorted(map(str, ((r.a or "", r.d, r.b or "") for r in got))) == sorted(map(str, [("x", -0.0, ""), ("x", 0.0, ""), ("", float("nan"), "y"), ("x", 1e-300, "y"), ("x", 2e-300, "y")]))


def _brute(names, least):
    out = []
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            score = headers.likeness(a, names[j])
            if least <= score < 1:
                out.append((i, j, score))
    return out


def test_names_are_joined_by_segments(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdeé列名_ ", k=rng.randint(1, 24))) for _ in range(120)]
    names = list(dict.fromkeys([*base, *["".join(rng.choice("xy") if rng.random() < 0.15 else c for c in b) + rng.choice(["", "z"]) for b in base for _ in range(3)]]))
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    for least in (headers.WARN, headers.SUGGEST, 0.9):
        got = similar_names.alike(rows, least).filter("score < 1").collect()
        assert sorted((r.a, r.b, round(r.score, 9)) for r in got) == [(a, b, round(s, 9)) for a, b, s in _brute(names, least)]
    assert similar_names.first_pairs(spark, names, 0.72, 8) == _brute(names, 0.72)[:8]
    late = ["".join(rng.choices("abcdefghij", k=12)) for _ in range(400)] + ["column name 1", "column name 2"]
    assert similar_names.first_pairs(spark, late, 0.72, 8) == _brute(late, 0.72)[:8]


def test_distances_of_many_names(monkeypatch):
    """Names of more than 64 and 128 letters, many letters, few held at once."""
    rng = random.Random(3)
    for places in (edits.PLACES, 300):
        monkeypatch.setattr(edits, "PLACES", places)
        monkeypatch.setattr(edits, "PAIRS", 7 if places == 300 else edits.PAIRS)
        for low, high, letters in ((1, 24, "abcé列_ "), (50, 80, "ab/."), (60, 66, "ab"), (126, 150, "aab列")):
            names = ["".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(25)]
            names += ["".join(rng.choice(letters) if rng.random() < 0.15 else c for c in n) + rng.choice(["", "z"]) for n in names]
            want = [(a, b, round(s, 9)) for a, x in enumerate(names) for b, y in enumerate(names) if a < b and (s := headers.likeness(x, y)) >= 0.72]
            held = edits.Names(names)
            got = [(*sorted((int(held.order[a]), int(held.order[b]))), round(float(s), 9)) for x in edits.close(held, None, 0.72) for a, b, s in zip(*x)]
            assert want and sorted(got) == want
            ones, twos = edits.Names(names[:20]), edits.Names(names[20:])
            got = [(int(ones.order[a]), 20 + int(twos.order[b]), round(float(s), 9)) for x in edits.close(ones, twos, 0.72) for a, b, s in zip(*x)]
            assert sorted(got) == [w for w in want if w[0] < 20 <= w[1]]


@pytest.mark.parametrize("small, crowd", [(20_000, 200), (0, 200), (0, 8), (0, 1)])
def test_crowded_names(spark, monkeypatch, small, crowd):
    """All pairs, whether all names, some or none are crowded; names with more copies than a row holds."""
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdeé列名_ ", k=rng.randint(1, 24))) for _ in range(60)]
    names = [*base, *["".join(rng.choice("xy") if rng.random() < 0.15 else c for c in b) for b in base], *[f"https://host.example/{rng.randint(0, 9999)}" for _ in range(40)], *base[:20], "", *["copied name"] * 7]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    for key, value in {"SMALL": small, "CROWD": crowd, "COPIES": 3, "BLOCK": 60}.items():
        monkeypatch.setattr(similar_names, key, value)
    want = [(a, b, round(s, 9)) for a, x in enumerate(names) for b, y in enumerate(names) if a < b and x and y and (s := headers.likeness(x, y)) >= 0.72]
    for choice, met in (({}, lambda a, b: True), ({"left": F.expr("id % 5 = 0")}, lambda a, b: a % 5 == 0 or b % 5 == 0), ({"across": F.expr("id % 3 = 0")}, lambda a, b: (a % 3 == 0) != (b % 3 == 0))):
        got = sorted((r.a, r.b, round(r.score, 9)) for r in similar_names.alike(rows, 0.72, **choice).collect())
        assert got == [w for w in want if met(w[0], w[1])]


def test_blocks_of_names_have_a_bound(spark, monkeypatch):
    """However many names there are, a block has no more than HELD of them; pairs stay the same."""
    for n in (1, 12_820, 64_102, 128_204, 900_000, 50_000_000):
        assert n / similar_names._blocks(n, n) <= similar_names.HELD and n / similar_names._blocks(1, n) <= 4 * similar_names.HELD
    assert similar_names._blocks(128_204, 128_204) == similar_names.BLOCKS
    for key, value in {"BLOCK": 20, "BLOCKS": 2, "HELD": 20, "TASKS": 7, "COPIES": 3}.items():
        monkeypatch.setattr(similar_names, key, value)
    names = [f"https://host.example/{k * 7919 % 10_000}" for k in range(140)] + ["copied name"] * 7
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = sorted((r.a, r.b, round(r.score, 9)) for r in similar_names.alike(rows, 0.9).collect())
    assert got == [(a, b, round(s, 9)) for a, x in enumerate(names) for b, y in enumerate(names) if a < b and (s := headers.likeness(x, y)) >= 0.9]


def test_many_alike_urls(spark):
    """5,000 URLs of few hosts, whose segments nearly all share: in seconds."""
    rng = random.Random(5)
    hosts = [f"https://{rng.choice(['www.', 'blog.', 'm.', ''])}{''.join(rng.choices('then', k=6))}.example.{end}" for end in ("com", "net", "org") for _ in range(20)]
    names = [f"{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(0, 9999)}{rng.choice(['', '/', '.html', '#top', '?page=2&ref=x', '?utm_source=feed'])}" for _ in range(5000)]
    began = time.time()
    found = similar_names.alike(spark.createDataFrame(list(enumerate(names)), "id int, name string"), 0.8).cache()
    assert found.count() == found.select("a", "b").distinct().count()
    assert time.time() - began < 60
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE n AS SELECT unnest(range(5000)) AS id, unnest(?) AS name", [names])
    want = con.execute("SELECT a.id, b.id, levenshtein(a.name, b.name) AS d, greatest(length(a.name), length(b.name)) AS l FROM n a JOIN n b ON a.id < b.id WHERE a.id < 60 AND d <= l * 0.2 + 1e-9 ORDER BY 1, 2").fetchall()
    got = found.filter("a < 60").orderBy("a", "b").collect()
    found.unpersist()
    assert len(want) > 1000 and [(r.a, r.b, round(r.score, 9)) for r in got] == [(a, b, round(1 - d / n, 9)) for a, b, d, n in want]


def test_many_headers(spark):
    """16,384 names that are all alike, or none: in seconds."""
    began = time.time()
    alike = SourceTable("a.csv", "CSV", tuple(f"column {k}" for k in range(16_384)))
    assert headers.similar_pairs([alike]) == [("column 0", f"column {k}", 1 - 1 / 8) for k in range(1, 9)]
    rng = random.Random(1)
    other = tuple("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(16_384))
    assert len(headers.similar_pairs([SourceTable("b.csv", "CSV", other)])) <= 8
    assert time.time() - began < 60
    three = [SourceTable(n, "CSV", h) for n, h in (("a", other[:300]), ("b", other[:300]), ("c", tuple(h[:-1] + "!" for h in other[:150])))]
    assert headers.suggest_mappings(three) == {h[:-1] + "!": h for h in other[:150]}


def test_preflight_reads_what_it_checks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,mixed,empty\n1,2,\n3,x,\n")
    (tmp_path / "b.csv").write_text("k,mixed\n1,2\n")
    titles = lambda ts, **o: [r.title for r in preflight(spark, ts, MergeOptions(**o)).collect() if r.level != "Info"]
    for tables in (discovery.scan([str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])[0], discovery.scan_stored(spark, f"file://{tmp_path}")[0]):
        assert tables[0].frame is None
        assert titles(tables) == ["字段不一致", "字段类型混合", "字段全空"] == titles([discovery.load(spark, t) for t in tables])
        assert titles(tables, filter_column="no such") == titles(tables, filter_column="no such", filter_text=" ") == titles(tables)
        assert titles(tables, filter_column="  ", filter_text="x")[-1] == "未选择筛选字段" and titles(tables, filter_column="no such", filter_text="x")[0] == "筛选字段不存在"
        assert preflight(spark, tables, MergeOptions()).filter("title = '数据规模'").first().detail == f"3 rows, {24 + 12} bytes"
    (tmp_path / "c.xlsx").write_text("no workbook")
    broken = SourceTable(str(tmp_path / "c.xlsx"), "S", ("k",))
    gone = SourceTable(str(tmp_path / "gone.csv"), "CSV", ("k",), kind={"Csv": {"delimiter": 44}})
    assert titles([*tables, broken, gone])[:3] == ["文件不存在", "无法抽样读取", "无法抽样读取"] and titles([gone]) == ["文件不存在", "无法抽样读取", "字段全空"]


def test_durations_are_texts():
    assert [cells.shows_date(n, c) for n, c in ((46, None), (164, "[hh]:mm:ss"), (164, "[h]:mm"), (164, '"[h]" yyyy'), (22, None), (164, "[red]0.00"), (0, None))] == [None, None, None, True, True, False, False]
    assert cells.number_of(1.5, None, False) == "1.5" and cells.number_of(2.0, None, False) == "2" and cells.number_of(1.5, True, False).hour == 12
    assert [workbook.cell_text(x) for x in (1e-7, float("nan"), float("inf"), 1e20, 2.5, -3.0)] == ["0.0000001", "NaN", "inf", "100000000000000000000", "2.5", "-3"]


def test_duration_cells(tmp_path):
    path = str(tmp_path / "d.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="[hh]:mm:ss"/></numFmts><cellXfs><xf/><xf numFmtId="170"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" s="1"><v>1.5</v></c><c r="B1" s="2"><v>1.5</v></c></row></sheetData></worksheet>')
    assert workbook.Workbook(path).sheet("S") == [["1.5", dt.datetime(1899, 12, 31, 12)]]


def test_workbooks_of_any_store(spark, tmp_path):
    """Sheets read as one frame or apart, blank rows and columns, a stored path, pieces cut between sheets, a failed task."""
    df = spark.range(0, 40, 1, 5).select(F.col("id").alias("n"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("x"), "id")).alias("t"), F.when(F.col("id") < 20, F.col("id") / 4).alias("d"))
    path, seen = f"file:{tmp_path}/a.xlsx", []
    assert workbook.write(df, path, max_rows=7, told=lambda n, total: seen.append((n, total))) == (40, 6)
    assert seen[-1] == (40, 40) and [n for n, _ in seen] == sorted(n for n, _ in seen) and len(seen) > 4 and [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["a.xlsx"]
    want = [(r.n, r.t, r.d) for r in df.orderBy("n").collect()]
    for where in (path, str(tmp_path / "a.xlsx")):
        tables = discovery.scan([where])[0] if where == path else discovery.scan_stored(spark, f"file:{tmp_path}")[0]
        assert [t.estimated_rows for t in tables] == [7] * 5 + [5]
        tables = discovery.load_all(spark, tables)
        tables[2] = tables[2].with_mapping("t", transform="Uppercase")
        out = merge(tables, MergeOptions(include_source_sheet=True), ordered=True)
        assert [(r.n, r.t, r.d) for r in out.collect()] == [(n, t and (t.upper() if 14 <= n < 21 else t), d if n < 21 or d is None else d) for n, t, d in want]
        assert [r.asDict()["来源工作表"] for r in out.collect()] == [workbook.SHEET_NAME.format(n // 7 + 1) for n in range(40)]
    broken = df.withColumn("x", F.when(F.col("n") == 33, F.raise_error(F.lit("no"))).otherwise("y"))
    with pytest.raises(Exception, match="no"):
        workbook.write(broken, str(tmp_path / "b.xlsx"))
    assert not (tmp_path / "b.xlsx").exists() and not (tmp_path / "b.xlsx.part").exists()
    assert workbook.write(df.limit(0), path, overwrite=True) == (0, 1) and discovery.scan([path])[0][0].headers == ("n", "t", "d")
