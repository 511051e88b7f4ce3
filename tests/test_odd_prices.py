"""Queries over events whose values are often zero give their SQL twin's rows, infinities and NaN included."""

import os
from pathlib import Path

import duckdb
import pytest

from mintscope import queries as q

from .test_queries import plain

q.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """sf0.001 with zeros: all of a mint's values, its first, its last, its buys, or every other one."""
    folder = tmp_path_factory.mktemp("odd")
    for p in Path(SF).glob("*.parquet"):
        if p.stem != "events":
            os.symlink(p, folder / p.name)
    at = "row_number() over (partition by user_id order by ts {0}) <= 12 and user_id % 7 = {1}"
    zero = f"user_id % 7 = 0 or {at.format('', 1)} or {at.format('desc', 2)} or user_id % 7 = 3 and event_type = 'purchase' or user_id % 7 = 4 and event_id % 2 = 0"
    duckdb.sql(f"copy (select * replace (case when {zero} then 0 else value end as value) from '{SF}/events.parquet' order by event_id) to '{folder}/events.parquet' (format parquet)")
    return str(folder)


def agree(spark, folder, name):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as from '{p}'")
    want = con.execute(q.ORACLES[name])
    names = [d[0] for d in want.description]
    rows = lambda x: sorted(([plain(v) for v in r] for r in x), key=repr)
    assert rows(q.QUERIES[name](spark, folder).select(*[f"`{n}`" for n in names]).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", [
    "chained_decisions",
    "w5_w6_w7_price_path",
    "w6_drawdowns",
    "survival_measures",
    "w16_absorption",
    "r17_rug_outcomes",
])
def test_zeros(spark, odd, name):
    agree(spark, odd, name)


def test_snapshot_of_zero_prices(spark, odd):
    mints = duckdb.sql(f"select count(distinct user_id) from '{odd}/events.parquet' where event_type in ('purchase', 'error')").fetchall()[0][0]
    assert len(q.QUERIES["f19_f20_f22_f23_snapshot"](spark, odd).collect()) == mints


@pytest.mark.parametrize(("name", "column"), [("w13_w14_j3_cohort_ranks", "rank"), ("w15_rank_velocity", "early_rank")])
def test_equal_values_in_another_order_tie(spark, tmp_path, name, column):
    rows = [(mint, kind, v) for mint, values in ((1, (0.3, 0.2, 0.1)), (2, (0.1, 0.2, 0.3))) for kind, v in [("signup", 0), *[("purchase", v) for v in values]]]
    events = ", ".join(f"({i}, timestamp '2024-01-01' + interval {i} second, {m}, '{k}', {v}::double, '{{\"k\": 1}}')" for i, (m, k, v) in enumerate(rows))
    duckdb.sql(f"copy (select event_id::bigint as event_id, ts, user_id::bigint as user_id, event_type, value, props from (values {events}) as t(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet' (format parquet)")
    assert {r.mint: r[column] for r in q.QUERIES[name](spark, str(tmp_path)).collect()} == {1: 1, 2: 2}
