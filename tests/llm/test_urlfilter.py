from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from mintscope.llm import urlfilter
from mintscope.llm.queries import ORACLES, op4_url_filters

SF = "/root/testdata/sf0.01"


def day(n):
    return datetime(2024, 1, n)


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as from '{SF}/pages.parquet'")
    got = op4_url_filters(spark, SF)
    want = con.execute(ORACLES["op4_url_filters"])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: [str(v) for v in r]
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, want.fetchall()))


def test_intervals(spark):
    rows = [("A.org", "block", "add", day(1)), ("a.org", "block", "add", day(3)), ("a.org", "block", "remove", day(5)), ("a.org", "block", "remove", day(6)), ("a.org", "block", "add", day(9)), ("b.org", "block", "remove", day(2)), ("c.org", "block", "add", day(2)), ("c.org", "block", "remove", day(2)), (None, "block", "add", day(1)), ("d.org", "block", "odd", day(1)), ("d.org", "block", "add", None)]
    events = spark.createDataFrame(rows, "entry string, verdict string, action string, at timestamp")
    got = sorted((r.entry, r.valid_from, r.valid_to) for r in urlfilter.validity(events).collect())
    assert [(e, f.day, t and t.day) for e, f, t in got] == [("a.org", 1, 5), ("a.org", 9, None)]


def test_edge_rows(spark):
    events = spark.createDataFrame(
        [("evil.org", "block", "add", day(5)), ("evil.org", "block", "remove", day(8)), ("evil.org/ok", "allow", "add", day(1)), ("deep.evil.org", "block", "add", day(6))],
        "entry string, verdict string, action string, at timestamp",
    )
    rows = [
        (1, "http://evil.org/", day(4)), (2, "http://evil.org/", day(5)), (3, "http://evil.org/", day(8)), (4, "HTTPS://u:p@WWW.Evil.org:80/OK/x?q#f", day(6)), (5, "http://a.deep.evil.org./x", day(9)),
        (6, None, day(6)), (7, "", day(6)), (8, "not a url", day(6)), (9, "http://evil.org", None), (2, "http://evil.org/", day(5)), (None, "http://evil.org/ok", day(6)), (10, "http://evil.org/" + "a/" * 50_000, day(6)), (11, "http://notevil.org/", day(6)),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp").withColumn("entry", F.lit("x"))
    got = sorted(((r.page_id or 0, r.verdict, r.entry) for r in urlfilter.judge(df, events, "page_id").collect()), key=str)
    assert got == sorted([(1, "none", None), (2, "block", "evil.org"), (2, "block", "evil.org"), (3, "none", None), (4, "block", "evil.org"), (5, "block", "deep.evil.org"), (6, "none", None), (7, "none", None), (8, "none", None), (9, "none", None), (0, "allow", "evil.org/ok"), (10, "block", "evil.org"), (11, "none", None)], key=str)
    kept = urlfilter.keep_allowed(df, events, "page_id")
    assert kept.columns == df.columns and sorted(r.page_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9, 11]
    assert urlfilter.judge(df.where("false"), events, "page_id").count() == 0
    assert {r.verdict for r in urlfilter.judge(df, events.where("false"), "page_id").collect()} == {"none"}


def test_entries_of_any_depth(spark):
    deep = ".".join("abcdefgh") + ".org"
    listed = [(deep, "block"), ("x.org/1/2/3/4/5", "block"), ("x.org/1/2", "allow"), ("x.org/1/2/3/4/5/6/7", "allow"), ("y.org/" + "/".join("p" * 150), "block"), ("y.org", "allow")]
    events = spark.createDataFrame([(e, v, "add", day(1)) for e, v in listed], "entry string, verdict string, action string, at timestamp")
    urls = ["http://z." + deep + "/q", "http://" + deep, "http://x.org/1/2/3/4/5/6", "http://x.org/1/2/3/4/6", "http://x.org/1/2/3/4/5/6/7/8", "http://y.org/" + "p/" * 200, "http://y.org/p/p"]
    df = spark.createDataFrame([(i, u, day(2)) for i, u in enumerate(urls)], "page_id long, url string, fetched_at timestamp")
    got = {r.page_id: (r.verdict, r.entry) for r in urlfilter.judge(df, events, "page_id").collect()}
    want = [listed[0], listed[0], listed[1], listed[2], listed[3], listed[4], listed[5]]
    assert got == {i: (v, e) for i, (e, v) in enumerate(want)}
    assert sorted(r.page_id for r in urlfilter.keep_allowed(df, events, "page_id").collect()) == [3, 4, 6]
