"""A: scans, catalogue, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import table
from ..operators.quality import replayed
from ..sources import catalog as C
from ..sources.files import union_runs
from . import query


def runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.selectExpr("concat(case o_orderkey % 3 when 0 then 'bt' when 1 then 'fixture' else 'run' end, o_custkey) as run_id", "o_orderkey as record_id", "o_orderstatus = 'O' as is_root", "unix_micros(cast(o_orderdate as timestamp)) as wall", "case o_orderpriority when '1-URGENT' then 'live' when '2-HIGH' then 'replay' else 'other' end as mode", "case when o_totalprice > 400000 then 'scenario big' else '' end as notes", "o_totalprice as price")


_RUNS = """runs AS (SELECT (CASE o_orderkey % 3 WHEN 0 THEN 'bt' WHEN 1 THEN 'fixture' ELSE 'run' END) || o_custkey AS run_id, o_orderkey AS record_id, o_orderstatus = 'O' AS is_root, epoch_us(o_orderdate) AS wall,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'live' WHEN '2-HIGH' THEN 'replay' ELSE 'other' END AS mode, CASE WHEN o_totalprice > 400000 THEN 'scenario big' ELSE '' END AS notes, o_totalprice AS price FROM orders)"""
_KIND = "CASE WHEN mode = 'replay' THEN 'replay' WHEN run_id LIKE 'fixture%' OR notes LIKE '%scenario%' THEN 'fixture' WHEN mode = 'live' THEN 'live_paper' WHEN run_id LIKE 'bt%' THEN 'backtest' ELSE 'unknown' END"


@query("""WITH e AS (SELECT event_type AS run_id, event_id, epoch_us(ts) AS us, user_id AS slot, CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN NULL ELSE 20000 - event_id END AS sn FROM events),
    w AS (SELECT *, min((sn IS NOT NULL)::INT) OVER (PARTITION BY run_id) = 1 AS whole FROM e)
    SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN whole THEN sn ELSE us END, CASE WHEN whole THEN 0 ELSE slot END, event_id) AS place FROM w""")
def a10_replay_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_type as run_id", "event_id", "unix_micros(cast(ts as timestamp)) as us", "user_id as slot", "if(event_type = 'view' and event_id % 5 = 0, null, 20000 - event_id) as sequence_number")
    return C.replay_order(e).select("run_id", "event_id", "place")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup') OR event_type = 'error' AND user_id % 2 = 0")
def a11_replay_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "case event_type when 'purchase' then 'buy' when 'signup' then 'token_created' when 'error' then 'data_gap' else 'decision' end as kind", "if(user_id % 2 = 0, 'live', 'replay') as source")
    return replayed(e).select("event_id", "event_type")


@query(f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY is_root DESC, wall DESC, record_id DESC) AS r FROM runs) SELECT run_id, record_id, is_root, wall FROM r WHERE r = 1")
def a12_latest_runs(spark, sf_dir):
    return C.latest_runs(runs(spark, sf_dir)).select("run_id", "record_id", "is_root", "wall")


@query("""WITH e AS (SELECT user_id AS run_id, count(*) AS events, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events WHERE event_type <> 'purchase' GROUP BY 1), f AS (SELECT user_id AS run_id, count(*) AS fills, sum(value) AS pnl FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT c_custkey AS run_id, coalesce(events, 0) AS events, first_us, last_us, coalesce(fills, 0) AS fills, pnl FROM customer LEFT JOIN e ON e.run_id = c_custkey LEFT JOIN f ON f.run_id = c_custkey""")
def a13_run_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id as run_id", "event_type", "unix_micros(cast(ts as timestamp)) as us", "value as pnl")
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    return C.run_statistics(r, e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"))


@query(f"WITH {_RUNS} SELECT record_id, {_KIND} AS kind, CASE {_KIND} WHEN 'live_paper' THEN 'source' WHEN 'replay' THEN 'derived' WHEN 'backtest' THEN 'derived' ELSE 'test' END AS role FROM runs")
def a14_run_kinds(spark, sf_dir):
    kind = C.run_kind(F.col("run_id"), F.col("mode"), F.col("notes"))
    return runs(spark, sf_dir).select("record_id", kind.alias("kind"), C.run_role(kind).alias("role"))


@query(f"WITH {_RUNS} SELECT arg_max(run_id, (wall, run_id)) AS run_id FROM runs WHERE mode = 'replay' AND {_KIND} = 'replay'")
def a15_latest_id(spark, sf_dir):
    x = runs(spark, sf_dir).withColumn("kind", C.run_kind(F.col("run_id"), F.col("mode"), F.col("notes")))
    return C.latest_id(x, mode="replay", kind="replay")


@query(f"""WITH {_RUNS}, l AS (SELECT run_id, {_KIND} AS kind FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY is_root DESC, wall DESC, record_id DESC) AS r FROM runs) WHERE r = 1),
    s AS (SELECT run_id, min(price) AS low FROM runs GROUP BY run_id)
    SELECT record_id, run_id, kind, low, CASE WHEN price > 200000 THEN 'a_large|' ELSE '' END || 'm_' || mode AS reason_codes FROM runs LEFT JOIN l USING (run_id) LEFT JOIN s USING (run_id)""")
def a8_export_decisions(spark, sf_dir):
    r = runs(spark, sf_dir)
    kinds = C.latest_runs(r).withColumn("kind", C.run_kind(F.col("run_id"), F.col("mode"), F.col("notes")))
    d = r.select("record_id", "run_id", F.col("run_id").alias("snapshot_hash"), F.array_compact(F.array(F.concat(F.lit("m_"), "mode"), F.when(F.col("price") > 200000, "a_large"))).alias("reason_codes"))
    s = r.groupBy("run_id").agg(F.min("price").alias("low")).withColumn("snapshot_hash", F.col("run_id"))
    return C.export_decisions(d, kinds, s).select("record_id", "run_id", "kind", "low", "reason_codes")


@query("""SELECT DISTINCT l_orderkey, l_linenumber, left(sha256(concat_ws(':', l_orderkey, l_partkey, l_linestatus, l_linenumber)), 16) AS fill_id, left(sha256(concat_ws(':', l_orderkey, l_partkey)), 16) AS position_id, coalesce(CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey END, l_orderkey) AS fill_us, l_partkey FROM lineitem""")
def a9_export_fills(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as run_id", "l_partkey as mint", "l_linestatus as side", "l_linenumber as seq", "if(l_suppkey % 2 = 0, l_suppkey, null) as confirmation_us", "if(l_suppkey % 3 = 0, l_partkey, null) as landing_us", "l_orderkey as send_us", "0L as signal_us").distinct()
    return C.export_fills(f).select(F.col("run_id").alias("l_orderkey"), F.col("seq").alias("l_linenumber"), "fill_id", "position_id", "fill_us", F.col("mint").alias("l_partkey")).distinct()


@query("""SELECT o_orderkey, concat_ws(';', CASE WHEN NOT coalesce(o_totalprice > 50000, false) THEN 'volume' END, CASE WHEN o_orderstatus = 'P' THEN 'complete' END, CASE WHEN o_custkey % 7 = 0 THEN 'sequence' END) AS reason,
    o_totalprice > 50000 AND o_orderstatus <> 'P' AND o_custkey % 7 <> 0 AS included, CASE WHEN o_orderstatus = 'P' THEN 'blocked' WHEN o_custkey % 7 = 0 THEN 'partial' WHEN o_totalprice <= 50000 THEN 'thin' ELSE 'primary' END AS class FROM orders""")
def a_slices_by_checks(spark, sf_dir):
    from ..plans.labels import first_match

    x = C.include_slices(table(spark, sf_dir, "orders"), {"volume": F.col("o_totalprice") > 50000, "complete": F.col("o_orderstatus") != "P", "sequence": F.col("o_custkey") % 7 != 0})
    has = lambda n: F.array_contains(F.split("reason", ";"), n)
    return x.select("o_orderkey", "reason", "included", first_match([("blocked", has("complete")), ("partial", has("sequence")), ("thin", has("volume"))], "primary").alias("class"))


@query("""WITH r AS (SELECT l_orderkey AS segment, count(*) AS rows, count(*) FILTER (l_tax > 0.07) AS corrupt FROM lineitem WHERE l_orderkey % 10 <> 3 GROUP BY 1)
    SELECT o_orderkey AS segment, coalesce(rows, 0) AS rows, o_custkey % 6 AS expected, coalesce(corrupt, 0) AS corrupt, CASE WHEN coalesce(rows, 0) = 0 THEN 'empty' WHEN corrupt > 0 THEN 'parse_errors' WHEN rows <> o_custkey % 6 THEN 'count_mismatch' ELSE 'ok' END AS status FROM orders LEFT JOIN r ON segment = o_orderkey""")
def a19_segment_integrity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 <> 3").selectExpr("l_orderkey as segment", "l_tax > 0.07 as corrupt")
    return C.segment_integrity(rows, table(spark, sf_dir, "orders").selectExpr("o_orderkey as segment", "o_custkey % 6 as expected"))


@query("""WITH u AS (SELECT c_custkey AS k, c_acctbal > 0 AS v, false AS c FROM customer UNION ALL SELECT s_suppkey, s_acctbal > 1000, true FROM supplier UNION ALL SELECT p_partkey, p_retailprice > 900, p_size > 25 FROM part)
    SELECT k, bool_and(v) AS verified, bool_or(c) AS counted, count(*) AS ledgers, count(DISTINCT v) = 1 AS uniform FROM u GROUP BY k""")
def a17_a24_merge_quality(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_acctbal > 0 as verified", "false as counted")
    b = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "s_acctbal > 1000 as verified", "true as counted")
    c = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_retailprice > 900 as verified", "p_size > 25 as counted")
    return C.merge_quality([union_runs([a, b]), c], ["k"])


@query("SELECT l_linenumber AS horizon, count(*) AS rows, count(DISTINCT l_partkey) AS mints FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def a_mart_counts(spark, sf_dir):
    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey as slice_id", "o_orderstatus = 'F' as included", "o_custkey as mint")
    f = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as slice_id", "l_linenumber as horizon", "l_partkey as mint")
    return C.mart(s, f, s)[1]
