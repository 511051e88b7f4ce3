"""Every query with an SQL twin gives the twin's rows."""

import math
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from mintscope import queries as q

q.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, Decimal):
        return round(float(v), 5)
    return str(v) if isinstance(v, datetime) else v


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query(spark, con, name):
    got = q.QUERIES[name](spark, SF)
    want = con.execute(q.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda x: sorted(([plain(v) for v in r] for r in x), key=repr)
    assert rows(got.select(*[f"`{n}`" for n in names]).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_query_without_twin(spark, name):
    got = q.QUERIES[name](spark, SF)
    assert got.dtypes == [tuple(x.rsplit(" ", 1)) for x in q.results.RESULTS[name].split(", ")]
    got.collect()
