"""Registered queries of the merge engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.model import SOURCE_FILE, SOURCE_SHEET, MergeOptions, SourceTable
from weft.operators.merge import from_df, merge, preview, sheets
from weft.operators.profile import cell_kinds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customer(spark, sf_dir) -> SourceTable:
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Key"), F.col("c_name").alias("Name"), F.col("c_nationkey").alias("Nation"), F.col("c_acctbal").alias("Balance"), F.col("c_mktsegment").alias("Segment"))
    return from_df(df, "customer.csv", order="Key")


def _supplier(spark, sf_dir) -> SourceTable:
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key "), F.col("s_name").alias("NAME"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return from_df(df, "supplier.csv", order="key ")


_BOTH = """(SELECT c_custkey AS "Key", c_name AS "Name", c_nationkey AS "Nation", c_acctbal AS "Balance", c_mktsegment AS "Segment", 'customer.csv' AS f FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 'supplier.csv' FROM supplier)"""


@query(f'SELECT "Key", "Name", "Nation", "Balance", "Segment" FROM {_BOTH}')
def append_union(spark, sf_dir):
    return merge([_customer(spark, sf_dir), _supplier(spark, sf_dir)], MergeOptions())


@query(f'SELECT "Key", "Name", "Nation", "Balance" FROM {_BOTH}')
def append_intersection(spark, sf_dir):
    return merge([_customer(spark, sf_dir), _supplier(spark, sf_dir)], MergeOptions("Intersection"))


@query("""SELECT c_name AS party, coalesce(nullif(c_mktsegment, ''), c_name) AS label, c_acctbal AS money FROM customer
UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier""")
def append_manual(spark, sf_dir):
    c = from_df(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment", F.col("c_name").alias("again"), "c_acctbal", "c_custkey"), "c.csv", order="c_custkey")
    c = c.with_mapping("c_name", target_name="party").with_mapping("c_mktsegment", target_name="label").with_mapping("again", target_name="label")
    c = c.with_mapping("c_acctbal", target_name="money").with_mapping("c_custkey", enabled=False)
    s = from_df(table(spark, sf_dir, "supplier"), "s.csv", order="s_suppkey").with_mapping("s_name", target_name="party").with_mapping("s_acctbal", target_name="money")
    s = s.with_mapping("s_suppkey", enabled=False).with_mapping("s_nationkey", target_name=" ")
    return merge([c, s], MergeOptions("Manual"))


@query(f"""SELECT "Name", f AS "{SOURCE_FILE}", 'CSV' AS "{SOURCE_SHEET}", "Key", "Nation", "Balance", "Segment" FROM {_BOTH}""")
def append_lineage_order(spark, sf_dir):
    options = MergeOptions(include_source_file=True, include_source_sheet=True, output_order=("name", SOURCE_FILE, SOURCE_SHEET))
    return merge([_customer(spark, sf_dir), _supplier(spark, sf_dir)], options)


def _part(spark, sf_dir) -> SourceTable:
    return from_df(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"), "p_brand", "p_size"), "part.csv", order="p_partkey")


@query("SELECT p_partkey, upper(trim(p_name)) AS p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")
def transform_trim_upper(spark, sf_dir):
    return merge([_part(spark, sf_dir).with_mapping("p_name", transform="Uppercase").with_mapping("p_size", transform="Trim")], MergeOptions())


@query("SELECT p_partkey, lower(trim(p_name)) AS p_name, lower(p_brand) AS p_brand, p_size FROM part")
def transform_trim_lower(spark, sf_dir):
    return merge([_part(spark, sf_dir).with_mapping("p_name", transform="Lowercase").with_mapping("p_brand", transform="Lowercase")], MergeOptions())


_PART = "SELECT p_partkey, '  ' || p_name || ' ' AS p_name, p_brand, p_size FROM part"


@query(f"{_PART} WHERE contains(lower(coalesce(p_brand, '')), 'brand#1')")
def filter_contains(spark, sf_dir):
    return merge([_part(spark, sf_dir)], MergeOptions(filter_column="P_BRAND", filter_text="brand#1"))


@query(f"{_PART} WHERE NOT contains(CAST(p_size AS VARCHAR), '1')")
def filter_exclude(spark, sf_dir):
    return merge([_part(spark, sf_dir)], MergeOptions(filter_column="p_size", filter_text="1", filter_exclude=True))


@query(f"""SELECT "Key", "Name", "Nation", "Balance", "Segment", f AS "{SOURCE_FILE}" FROM {_BOTH} WHERE contains(f, 'supp')""")
def filter_by_lineage(spark, sf_dir):
    return merge([_customer(spark, sf_dir), _supplier(spark, sf_dir)], MergeOptions(include_source_file=True, filter_column=SOURCE_FILE, filter_text="SUPP"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def dedup_row(spark, sf_dir):
    return merge([from_df(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"), "l.csv")], MergeOptions(deduplicate=True))


def _orders(spark, sf_dir) -> SourceTable:
    return from_df(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "orders.csv", order="o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def dedup_key_first(spark, sf_dir):
    return merge([_orders(spark, sf_dir)], MergeOptions(deduplicate=True, key_columns=("o_custkey",)))


@query("SELECT event_id, user_id, event_type FROM events WHERE contains(lower(event_type), 'c') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_after_filter(spark, sf_dir):
    e = from_df(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "events.csv", order="event_id")
    return merge([e], MergeOptions(deduplicate=True, key_columns=("user_id", "event_type"), filter_column="event_type", filter_text="C"))


def _events(spark, sf_dir, *names) -> SourceTable:
    return from_df(table(spark, sf_dir, "events").select("event_id", "user_id", *names), "events.csv", order="event_id")


@query("SELECT min(event_id) AS event_id, user_id, arg_min(event_type, event_id) FILTER (event_type <> '') AS event_type, arg_min(value, event_id) FILTER (value IS NOT NULL) AS value FROM events GROUP BY user_id")
def consolidate_first(spark, sf_dir):
    return merge([_events(spark, sf_dir, "event_type", "value")], MergeOptions("Consolidate", key_columns=("user_id",)))


@query("SELECT o_custkey, CAST(sum(o_orderkey) AS DECIMAL(38,0)) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def consolidate_sum_int(spark, sf_dir):
    return merge([_orders(spark, sf_dir).with_mapping("o_orderkey", aggregate="Sum")], MergeOptions("Consolidate", key_columns=("o_custkey",)))


@query("SELECT CAST(o_custkey AS VARCHAR) AS k, CAST(sum(CAST(o_orderkey AS HUGEINT) * 1000000000000037) AS VARCHAR) AS v FROM orders GROUP BY o_custkey")
def consolidate_sum_big_text(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("k"), (F.col("o_orderkey").cast("decimal(20,0)") * F.lit(1000000000000037).cast("decimal(17,0)")).cast("string").alias("v"), F.col("o_orderkey").alias("__o"))
    return merge([from_df(df, "o.csv", order="__o").with_mapping("v", aggregate="Sum")], MergeOptions("Consolidate", key_columns=("k",)))


@query("""SELECT user_id, min(event_id) AS event_id, string_agg(event_type, '|' ORDER BY o) AS event_type
FROM (SELECT user_id, event_type, min(event_id) AS o, min(event_id) AS event_id FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def consolidate_unique_join(spark, sf_dir):
    return merge([_events(spark, sf_dir, "event_type").with_mapping("event_type", aggregate="UniqueJoin")], MergeOptions("Consolidate", key_columns=("user_id",), text_join_separator="|"))


@query("SELECT conv_id, min(turn) AS turn, string_agg(nullif(role, ''), '；' ORDER BY turn) AS role, arg_min(text, turn) FILTER (text <> '') AS text FROM conversations GROUP BY conv_id")
def consolidate_text_join(spark, sf_dir):
    c = from_df(table(spark, sf_dir, "conversations"), "c.csv", order="turn").with_mapping("role", aggregate="TextJoin")
    return merge([c], MergeOptions("Consolidate", key_columns=("conv_id",)))


@query(f"""SELECT "Nation", "Segment", CAST(sum("Key") AS DECIMAL(38,0)) AS "Key" FROM {_BOTH} GROUP BY "Nation", "Segment" """)
def consolidate_multi_key_multi_table(spark, sf_dir):
    tables = [t.with_mapping(t.headers[0], aggregate="Sum", target_name="Key") for t in (_customer(spark, sf_dir), _supplier(spark, sf_dir))]
    return merge(tables, MergeOptions("Consolidate", key_columns=("Segment", "Nation"))).select("Nation", "Segment", "Key")


@query(f'SELECT f AS "{SOURCE_FILE}", CAST(sum("Key") AS DECIMAL(38,0)) AS "Key", arg_min("Name", "Key") AS "Name" FROM {_BOTH} GROUP BY f')
def consolidate_by_source(spark, sf_dir):
    tables = [t.with_mapping(t.headers[0], aggregate="Sum", target_name="Key") for t in (_customer(spark, sf_dir), _supplier(spark, sf_dir))]
    return merge(tables, MergeOptions("Consolidate", include_source_file=True, key_columns=(SOURCE_FILE,))).select(SOURCE_FILE, "Key", "Name")


def _join_tables(spark, sf_dir) -> list[SourceTable]:
    """Whole tables whose keys meet in part: multiples of 2 and of 3."""
    n = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_name").alias("name"))
    c = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3).alias("ID"), F.col("o_orderstatus").alias("who"), F.col("o_orderpriority").alias("segment"), "o_orderkey")
    return [from_df(n, "n.csv", order="id"), from_df(c, "c.csv", order="o_orderkey", columns=["ID", "who", "segment"])]


_N = "(SELECT c_custkey * 2 AS id, c_name AS name FROM customer) n"
_C = "(SELECT o_custkey * 3 AS id, arg_min(o_orderstatus, o_orderkey) AS who, arg_min(o_orderpriority, o_orderkey) AS segment FROM orders GROUP BY o_custkey) c"


def _join(kind: str):
    def run(spark, sf_dir):
        return merge(_join_tables(spark, sf_dir), MergeOptions("Join", key_columns=("id",), join_kind=kind))

    run.__name__ = f"join_{kind.lower()}"
    return query(f"SELECT coalesce(n.id, c.id) AS id, name, who, segment FROM {_N} {kind} JOIN {_C} ON n.id = c.id")(run)


for _kind in ("Left", "Inner", "Full"):
    _join(_kind)


@query(f"""SELECT coalesce(n.id, c.id, s.id) AS id, name, coalesce(c.who, s.who) AS who, segment FROM {_N} FULL JOIN {_C} ON n.id = c.id
FULL JOIN (SELECT s_suppkey * 5 AS id, s_name AS who FROM supplier) s ON s.id = coalesce(n.id, c.id)""")
def join_three_way_coalesce(spark, sf_dir):
    s = from_df(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 5).alias("id"), F.col("s_name").alias("who")), "s.csv", order="id")
    return merge([*_join_tables(spark, sf_dir), s], MergeOptions("Join", key_columns=("id",), join_kind="Full"))


@query(f"SELECT n.id AS id, name, who, segment FROM {_N} LEFT JOIN {_C} ON n.id = c.id WHERE NOT contains(lower(coalesce(segment, '')), 'urgent')")
def join_post_filter(spark, sf_dir):
    return merge(_join_tables(spark, sf_dir), MergeOptions("Join", key_columns=("id",), filter_column="segment", filter_text="URGENT", filter_exclude=True))


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def join_single_table_collapse(spark, sf_dir):
    return merge([_orders(spark, sf_dir)], MergeOptions("Join", key_columns=("o_custkey",)))


@query("""SELECT row_number() OVER (ORDER BY k) AS place, n_nationkey, n_regionkey FROM
(SELECT CAST(n_nationkey AS VARCHAR) || chr(31) || CAST(n_regionkey AS VARCHAR) AS k, n_nationkey, n_regionkey FROM nation)""")
def key_text_sort(spark, sf_dir):
    n = from_df(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n.csv", order="n_nationkey")
    out = merge([n], MergeOptions("Consolidate", key_columns=("n_regionkey", "n_nationkey")))
    return sheets(out.withColumn("k", F.concat_ws("\x1f", "n_nationkey", "n_regionkey")), ["k"], 1 << 40).select(F.col("row_in_sheet").cast("long").alias("place"), "n_nationkey", "n_regionkey")


@query("""SELECT key, kind, count(*) AS n FROM (SELECT key, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN '数字' ELSE '文本' END AS kind FROM
(SELECT unnest(['event_id', 'user_id', 'event_type', 'props']) AS key, unnest([CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type, props]) AS v FROM (SELECT * FROM events ORDER BY event_id LIMIT 100))
WHERE trim(coalesce(v, '')) <> '') GROUP BY key, kind""")
def column_type_profile(spark, sf_dir):
    return cell_kinds(_events(spark, sf_dir, "event_type", "props"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders ORDER BY orders.o_orderkey LIMIT 30")
def preview_limit(spark, sf_dir):
    return preview([_orders(spark, sf_dir)], MergeOptions())


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 4000 + 1 AS sheet, (row_number() OVER (ORDER BY o_orderkey) - 1) % 4000 + 1 AS row_in_sheet FROM orders")
def sheet_split(spark, sf_dir):
    return sheets(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 4000)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources consolidated by nation, with lineage and a filter."""
    tables = [t.with_mapping(t.headers[0], aggregate="Sum", target_name="Key") for t in (_customer(spark, sf_dir), _supplier(spark, sf_dir))]
    return merge(tables, MergeOptions("Consolidate", include_source_file=True, key_columns=("Nation",), filter_column=SOURCE_FILE, filter_text="c"))


from weft.plans import catalogue_files  # noqa: E402, F401  registers its queries
