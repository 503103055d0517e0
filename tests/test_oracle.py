"""Every query with SQL against DuckDB on the same tables; the others must give rows."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, dict):
        return sorted((k, plain(y)) for k, y in x.items())
    return x


def key(row):
    return [(x is None, str(type(x)), x if x is not None else 0) for x in row]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    sql = entry.oracle_sql().get(name)
    df = entry.queries()[name](spark, SF if sql else SMALL)  # those without SQL are compared with slow versions elsewhere
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=lambda r: key([str(x) for x in r]))
    assert got
    if not sql:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted(([plain(r[i]) for i in order] for r in rel.fetchall()), key=lambda r: key([str(x) for x in r]))
    kinds = {c: KINDS.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    for c, t in df.dtypes:
        if t in KINDS.values():
            assert kinds[c] == t, (c, kinds[c], t)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1.1e-6, (a, b)
