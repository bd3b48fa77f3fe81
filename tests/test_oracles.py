"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from weft.plans.catalogue import ORACLES, QUERIES

DATA = os.environ.get("WEFT_DATA", "/root/testdata/sf0.001")


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, name):
    df = QUERIES[name](spark, DATA)
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    rows = want.fetchall()
    got = df.collect()
    assert rows
    assert [tuple(map(str, r)) for r in plain(got, df.columns)] == [tuple(map(str, r)) for r in plain(rows, names)]
