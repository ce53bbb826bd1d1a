"""Every core query against its SQL on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from meibo.plans import details, problems, relational, reports, rules, scalars

MODULES = (problems, scalars, relational, reports, rules, details)
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query(spark, data, duck, module, name):
    df = module.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in module.SQL:
        assert df.columns
        return
    got = duck.execute(module.SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert rows == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
