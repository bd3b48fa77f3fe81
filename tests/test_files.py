"""Files in, files out: the small literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weft.model import SOURCE_FILE, SOURCE_SHEET, MergeOptions, SourceTable, load_scheme, save_scheme
from weft.operators.merge import MergeError, from_df, merge, preview
from weft.operators.profile import preflight, report
from weft.plans.headers import combine_header_rows, normalize_headers, output_plan, recommend_header, similar_pairs, suggest_mappings
from weft.sources import delimited, discovery, workbook


def source(spark, tmp_path, name, data, **header):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return discovery.load(spark, discovery.scan_file(str(path), **header)[0][0])


def rows(df):
    return [tuple(r) for r in df.collect()]


def total(spark, tmp_path, text, **more):
    t = source(spark, tmp_path, "t.csv", text)
    return rows(merge([t.with_mapping(t.headers[1], aggregate="Sum")], MergeOptions("Consolidate", key_columns=("城市",), **more)))


def test_mixed_encodings(spark, tmp_path):
    a = source(spark, tmp_path, "utf8.csv", b"\xef\xbb\xbf" + "姓名,金额\n张三,100\n".encode())
    b = source(spark, tmp_path, "gbk.csv", "姓名,金额\n".encode() + "李四,200".encode("gbk"))
    assert a.headers == ("姓名", "金额")
    assert rows(merge([a, b], MergeOptions(), ordered=True)) == [("张三", "100"), ("李四", "200")]


def test_text_is_kept(spark, tmp_path):
    t = source(spark, tmp_path, "n.csv", '编号,金额\n007,12\n9007199254740993,"1,234"\n')
    assert rows(merge([t], MergeOptions(), ordered=True)) == [("007", "12"), ("9007199254740993", "1,234")]


def test_header_only_empty_and_single_column(spark, tmp_path):
    t = source(spark, tmp_path, "empty.csv", "姓名,金额\n")
    assert rows(merge([t], MergeOptions())) == [] and t.headers == ("姓名", "金额")
    with pytest.raises(ValueError):
        source(spark, tmp_path, "blank.csv", "")
    assert len(rows(merge([source(spark, tmp_path, "one.csv", "城市\n北京\n上海\n")], MergeOptions()))) == 2


def test_ragged_and_multiline(spark, tmp_path):
    t = source(spark, tmp_path, "q.csv", 'id,note\n1,"line one\nline ""two"""\n2\n3,x,y\n')
    assert rows(merge([t], MergeOptions(), ordered=True)) == [("1", 'line one\nline "two"'), ("2", None), ("3", "x")]


def test_sums(spark, tmp_path):
    assert total(spark, tmp_path, "城市,金额\n北京,10\n北京,20\n上海,30\n") == [("上海", "30"), ("北京", "30")]
    assert total(spark, tmp_path, "城市,金额\n北京,9007199254740992\n北京,1\n") == [("北京", "9007199254740993")]
    assert total(spark, tmp_path, "城市,金额\n北京,70000000000000\n北京,70000000000000\n") == [("北京", "140000000000000")]
    assert total(spark, tmp_path, '城市,金额\na,"1,234"\nb,abc\nc,x\nc,\nd,1.5\nd,2\n') == [("a", "1,234"), ("b", "abc"), ("c", "0"), ("d", "3.5")]


def test_dedup_and_filter(spark, tmp_path):
    t = source(spark, tmp_path, "dup.csv", "姓名,城市\n张三,北京\n张三,北京\n李四,上海\n王五,\n")
    assert len(rows(merge([t], MergeOptions(deduplicate=True)))) == 3
    assert len(rows(merge([t], MergeOptions(deduplicate=True, key_columns=("没有",))))) == 3
    assert len(rows(merge([t], MergeOptions(filter_column="城市", filter_text="北")))) == 2
    assert len(rows(merge([t], MergeOptions(filter_column="城市", filter_text="北", filter_exclude=True)))) == 2


@pytest.mark.parametrize("kind, n", [("Left", 2), ("Inner", 1), ("Full", 3)])
def test_joins(spark, tmp_path, kind, n):
    a, b = source(spark, tmp_path, "left.csv", "id,姓名\n1,张三\n2,李四\n"), source(spark, tmp_path, "right.csv", "id,城市\n1,北京\n3,上海\n")
    out = rows(merge([a, b], MergeOptions("Join", key_columns=("id",), join_kind=kind)))
    assert len(out) == n and out[0] == ("1", "张三", "北京")
    with pytest.raises(MergeError):
        merge([a, b], MergeOptions("Join", key_columns=("none",)))


def test_lineage_and_transform(spark, tmp_path):
    t = source(spark, tmp_path, "t.csv", "姓名,城市\n 张三　,北京\n").with_mapping("姓名", transform="Trim")
    options = MergeOptions(include_source_file=True, include_source_sheet=True, output_order=("姓名", SOURCE_SHEET, "城市"))
    out = merge([t], options)
    assert out.columns == ["姓名", SOURCE_SHEET, "城市", SOURCE_FILE]
    assert rows(out) == [("张三", "CSV", "北京", "t.csv")]


def test_batch_rename(spark, tmp_path):
    made = [source(spark, tmp_path, f"{n}.csv", text) for n, text in zip("abcd", ("姓名,金额\n张三,100\n", "姓名,金额\n李四,200\n", "姓名,金额,备注\n王五,300,ok\n", "姓名\n赵六\n"))]
    out = merge(discovery.set_field(made, "金额", target_name="合同金额"), MergeOptions("Manual"), ordered=True)
    assert out.columns == ["姓名", "合同金额", "备注"]
    assert rows(out)[3] == ("赵六", None, None) and rows(out)[2] == ("王五", "300", "ok")
    assert discovery.field_groups(made)[0]["count"] == 4


def test_text_joins(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", ""), (3, "a", "y"), (4, "a", "x")], "o int, k string, v string")
    t = from_df(df, "t.csv", order="o", columns=["k", "v"])
    one = lambda op: rows(merge([t.with_mapping("v", aggregate=op)], MergeOptions("Consolidate", key_columns=("k",), text_join_separator="|")))
    assert one("TextJoin") == [("a", "x|y|x")] and one("UniqueJoin") == [("a", "x|y")] and one("First") == [("a", "x")]


def test_headers():
    assert normalize_headers(["姓名", "", "姓名"]) == ["姓名", "未命名列2", "姓名_2"]
    assert recommend_header([["报表标题"], ["姓名", "金额", "城市"], ["张三", "12", "北京"]]) == 1
    assert combine_header_rows([["客户", "金额"], ["姓名", "金额"]]) == ["客户 / 姓名", "金额"]
    a, b, c = (SourceTable(f"{n}.csv", "CSV", h) for n, h in zip("abc", (("手机号", "x"), ("手机号",), ("手机号码", "y"))))
    assert suggest_mappings([a, b, c]) == {"手机号码": "手机号"}
    assert similar_pairs([a, b, c]) == [("手机号", "手机号码", 0.75)]
    t = SourceTable("t.csv", "CSV", (SOURCE_FILE,))
    assert output_plan([t], MergeOptions(include_source_file=True)).headers == (SOURCE_FILE, f"_{SOURCE_FILE}2")


def test_delimiters(tmp_path):
    path = tmp_path / "带 空格.csv"
    path.write_text('姓名;说明;金额\n张三;"北京,朝阳";12\n李四;"上海,浦东";15\n')
    t, warnings = delimited.scan(str(path))
    assert t.kind == {"Csv": {"delimiter": ord(";")}} and not warnings and t.estimated_rows == 2
    bad = tmp_path / "latin1.csv"
    bad.write_bytes(b"name,value\ncaf\xe9,1\n")
    assert delimited.scan(str(bad))[1]


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 15), True, 9007199254740993, 1.5, "甲<&>"), (dt.datetime(2024, 1, 1, 6, 30), None, 2, None, "")], "`日期` timestamp_ntz, `启用` boolean, id long, x double, `名` string")
    path = str(tmp_path / "types.xlsx")
    assert workbook.write(df, path) == (2, 1)
    t = discovery.load(spark, workbook.scan(path)[0])
    out = rows(merge([t], MergeOptions(), ordered=True))
    assert out[0] == (dt.datetime(2024, 1, 15), True, "9007199254740993", 1.5, "甲<&>")
    assert out[1][:3] == (dt.datetime(2024, 1, 1, 6, 30), None, "2")
    assert rows(preview([t], MergeOptions()))[1][0] == "2024-01-01 06:30:00"
    with pytest.raises(ValueError):
        workbook.write(df, path)


def test_sheet_split(spark, tmp_path):
    df = spark.createDataFrame([("甲",), ("乙",), ("丙",)], "`姓名` string").coalesce(1)
    path = str(tmp_path / "s.xlsx")
    assert workbook.write(df, path, max_rows=2) == (3, 2)
    assert [len(workbook.Workbook(path).sheet(s)) for s in workbook.Workbook(path).paths] == [3, 2]
    assert [t.sheet_name for t in discovery.scan([path])[0]] == ["合并结果_001", "合并结果_002"]


def test_two_header_rows(spark, tmp_path):
    df = spark.createDataFrame([("客户", "金额"), ("姓名", "金额"), ("甲", "10"), ("乙", "20")], "`报表标题` string, b string").coalesce(1)
    path = str(tmp_path / "multi.xlsx")
    workbook.write(df, path)
    t = discovery.load(spark, workbook.scan(path, header_row=2, header_rows=2)[0])
    assert t.headers == ("客户 / 姓名", "金额") and rows(merge([t], MergeOptions(), ordered=True)) == [("甲", "10"), ("乙", "20")]


def test_preflight(spark, tmp_path):
    a, b = source(spark, tmp_path, "a.csv", "姓名,v,e\n张三,1,\n李四,x,\n"), source(spark, tmp_path, "b.csv", "姓名\n王五\n")
    issues = preflight(spark, [a, b], MergeOptions(filter_column="没有", filter_text="x"))
    titles = [r.title for r in issues.collect()]
    assert titles[0] == "筛选字段不存在" and {"字段类型混合", "字段全空", "字段不一致"} <= set(titles)
    assert report(issues).startswith("[Error] 筛选字段不存在\n没有\n\n")


def test_scheme(tmp_path):
    t = SourceTable("a.csv", "CSV", ("x",), kind={"Csv": {"delimiter": 44}})
    options = MergeOptions("Join", key_columns=("订单号", "日期"), join_kind="Full", deduplicate=True)
    text = save_scheme("n", [t], options)
    assert load_scheme(text) == ("n", [t], options)
    for bad in ('"header_row": 0', '"header_row": 1, "header_rows": 4'):
        with pytest.raises(ValueError, match="表头设置无效"):
            load_scheme(text.replace('"header_row": 1', bad, 1).replace('"header_rows": 1,', "", 1) if "header_rows" in bad else text.replace('"header_row": 1', bad, 1))
    with pytest.raises(ValueError):
        load_scheme('{"format_version": 2}')


def test_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("B.csv", "a.tsv", "~$x.xlsx", "n.txt", "sub/c.CSV"):
        (tmp_path / name).write_text("h\n1\n")
    (tmp_path / "bad.xlsx").write_text("no")
    found = discovery.collect(str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in found] == ["a.tsv", "B.csv", "bad.xlsx", "c.CSV"]
    tables, warnings = discovery.scan(found)
    assert len(tables) == 3 and len(warnings) == 1
    assert len(discovery.appended(tables, tables)) == 3 and len(discovery.search(tables, "SUB")) == 1
    assert discovery.with_header(tables[0], 1).headers == ("h",)


def test_sheets_of_a_workbook_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Bundles of sheets, still packed: the same tables as a scan of the whole workbook gives, rows from several tasks, and no list of the sheets' numbers in the plan."""
    monkeypatch.setattr(workbook, "BUNDLE", 100)
    path = str(tmp_path / "many.xlsx")
    workbook.write(spark.range(600).select("id", F.concat(F.lit("name "), "id").alias("name")).coalesce(1), path, max_rows=10)
    tables = workbook.scan_all(spark, [path])
    assert tables == sorted(workbook.scan(path), key=lambda t: t.sheet_name) and len(tables) == 60
    assert workbook._bundles(spark, [f"file:{path}"]).count() > 3
    loaded = workbook.read_all(spark, tables)
    assert [tuple(r) for r in loaded[7].frame.orderBy("__r").select("id", "name").collect()] == [(k, f"name {k}") for k in range(70, 80)]
    merged = merge(loaded, MergeOptions(), ordered=True)
    assert [r.id for r in merged.collect()] == list(range(600)) and len(merged._jdf.queryExecution().optimizedPlan().toString()) < 20_000
