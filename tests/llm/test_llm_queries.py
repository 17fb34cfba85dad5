"""Every registered query of the subpackage on the smallest tables, beside its SQL where it has one."""

import glob
import os

import duckdb
import pytest

from querymill.llm import queries


def _value(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def engine(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, engine, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted((tuple(_value(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in queries.SQL:
        assert len(ours) > 0
        return
    done = engine.execute(queries.SQL[name])
    names = [c[0] for c in done.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted((tuple(_value(r[i]) for i in order) for r in done.fetchall()), key=repr)
