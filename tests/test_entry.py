import duckdb
import pytest

import __spark_entry__ as entry
from querymill.operators import registry
from querymill.plans import queries as plans

CORE = sorted({**registry.QUERIES, **plans.QUERIES})


def _value(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def engine(data):
    import glob
    import os

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, engine, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted((tuple(_value(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in entry.oracle_sql():
        assert len(ours) > 0
        return
    done = engine.execute(entry.oracle_sql()[name])
    names = [c[0] for c in done.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted((tuple(_value(r[i]) for i in order) for r in done.fetchall()), key=repr)
