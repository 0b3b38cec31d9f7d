"""Every core query with SQL, on the smallest data, against DuckDB."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def core(d):
    return {k: v for k, v in d.items() if not getattr(v, "__module__", "").startswith("mailweir.llm")}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(os.path.join(sf, "*.parquet")):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", [k for k in core(entry.queries()) if k in entry.oracle_sql()])
def test_same_rows_as_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols
    assert got == want


SLOW = ("model_",)


@pytest.mark.parametrize("name", [k for k in core(entry.queries()) if k not in entry.oracle_sql() and not k.startswith(SLOW)])
def test_other_queries_run(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.columns
    df.collect()


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "canonical_id", "n_copies", "disposition"]
