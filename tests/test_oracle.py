"""Every query with an SQL statement of its result, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import folioscope.plans as plans

SF = "/root/testdata/sf0.001"


def modules():
    import importlib
    import pkgutil

    found = [importlib.import_module(f"folioscope.plans.{m.name}") for m in pkgutil.iter_modules(plans.__path__)]
    return [m for m in found if hasattr(m, "QUERIES")]


QUERIES = {n: f for m in modules() for n, f in m.QUERIES.items()}
ORACLE = {n: s for m in modules() for n, s in m.ORACLE.items()}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLE:
        return
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
