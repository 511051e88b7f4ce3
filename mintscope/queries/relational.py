"""B, J, G, T: quality, joins, funding graph, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ev_trades, funding, li_trades, table, with_views
from ..operators import graph as G
from ..operators import joins as J
from ..operators import ledger as L
from ..operators import quality as Q
from ..sources.shared import spread
from . import query


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


_E = "e AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events)"


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def b1_transaction_dedup(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return Q.dedup(x, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], ["l_quantity"])


@query(f"""WITH {_E}, x AS (SELECT *, max(k) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM e)
    SELECT event_id, user_id, k FROM x WHERE high IS NULL OR k > high""")
def b2_newest_versions(spark, sf_dir):
    return Q.newest_versions(events(spark, sf_dir), ["user_id"], "k", ["us", "event_id"]).select("event_id", "user_id", "k")


@query(f"""WITH {_E}, x AS (SELECT event_type, event_id, user_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY us, event_id) AS last FROM e)
    SELECT event_type, last + 1 AS start_slot, event_id - 1 AS end_slot, CASE WHEN event_id > last + 9 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE event_id > last + 9 OR user_id * 100 > last""")
def b3_slot_gaps(spark, sf_dir):
    x = events(spark, sf_dir).withColumn("parent", F.col("user_id") * 100)
    return Q.slot_gaps(x, "event_type", "event_id", ["us", "event_id"], 8, "parent")


@query(f"""WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq FROM e), f AS (SELECT * FROM n WHERE k <> 7),
    x AS (SELECT user_id, seq, coalesce(lag(seq) OVER (PARTITION BY user_id ORDER BY seq), 0) + 1 AS expected FROM f)
    SELECT user_id, expected, seq AS got FROM x WHERE seq <> expected""")
def b4_sequence_gaps(spark, sf_dir):
    n = events(spark, sf_dir).withColumn("seq", F.expr("row_number() over (partition by user_id order by us, event_id)"))
    return Q.sequence_gaps(n.where("k <> 7"), "user_id", "seq")


@query(f"""WITH RECURSIVE {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS o FROM e WHERE user_id <= 40),
    r AS (
        SELECT user_id, o, o AS seq, o = 1 AND k <> 7 AS passed, CASE WHEN o = 1 AND k <> 7 THEN 1 ELSE 0 END AS last FROM n WHERE o = 1
        UNION ALL SELECT n.user_id, n.o, n.o, n.o = r.last + 1 AND n.k <> 7, CASE WHEN n.o = r.last + 1 AND n.k <> 7 THEN n.o ELSE r.last END FROM r JOIN n ON n.user_id = r.user_id AND n.o = r.o + 1)
    SELECT user_id, count(*) AS frames, count(*) FILTER (passed) AS passed, min(o) FILTER (NOT passed) AS first_failure FROM r GROUP BY user_id""".replace(" WHERE user_id <= 40", ""))
def b4_sequence_verdicts(spark, sf_dir):
    n = events(spark, sf_dir).withColumn("o", F.expr("row_number() over (partition by user_id order by us, event_id)").cast("long")).withColumn("ok", F.col("k") != 7).withColumn("seq", F.col("o"))
    v = Q.sequence_verdicts(n, "user_id", "seq", "o", "ok")
    return v.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("passed").alias("passed"), F.min(F.when(~F.col("passed"), F.col("o"))).alias("first_failure"))


@query("SELECT event_id, sha256(props) = sha256(CASE WHEN event_id % 5 = 0 THEN props || ' ' ELSE props END) AS intact FROM events")
def b5_payload_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", Q.payload_ok(F.col("props"), F.sha2(F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")), 256)).alias("intact"))


@query("SELECT count(*)::BIGINT AS seen, count(DISTINCT (l_orderkey, l_linenumber))::BIGINT AS applied, (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS deduped FROM lineitem")
def b6_holder_update_dedup(spark, sf_dir):
    return Q.dedup_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
    WITH a AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS old FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), b AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS new FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
    SELECT l_partkey, l_suppkey, coalesce(old, 0) AS old, coalesce(new, 0) AS new, coalesce(new, 0) - coalesce(old, 0) AS delta FROM a FULL JOIN b USING (l_partkey, l_suppkey)""")
def b7_balance_changes(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey", "l_linestatus").agg(F.sum("l_quantity").alias("amount"))
    keys = ["l_partkey", "l_suppkey"]
    return Q.balance_changes(s.where("l_linestatus = 'F'").select(*keys, "amount"), s.where("l_linestatus = 'O'").select(*keys, "amount"), keys)


@query("SELECT o_orderkey AS signature, o_custkey AS funder, o_custkey + 1 AS wallet, o_orderkey % 100 - 20 AS amount FROM orders WHERE o_orderkey % 100 > 20")
def b8_transfer_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return Q.transfer_edges(o.selectExpr("o_orderkey as signature", "array(o_custkey, o_custkey + 1) as accounts", "array(500L, 20L) as pre", "array(400L, o_orderkey % 100) as post"))


@query("""SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * l_quantity::BIGINT)::BIGINT AS delta FROM lineitem WHERE l_suppkey % 7 = l_orderkey % 7 GROUP BY 1""")
def b9_owner_delta(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "struct(l_suppkey % 7 as owner, 1L as mint, if(l_linestatus = 'O', 0L, cast(l_quantity as bigint)) as old, if(l_linestatus = 'O', cast(l_quantity as bigint), 0L) as new) as b")
    arrays = x.groupBy("l_orderkey").agg(F.collect_list("b").alias("b")).where("exists(b, x -> x.owner = l_orderkey % 7)")
    return arrays.select("l_orderkey", Q.owner_delta(F.col("b"), F.col("l_orderkey") % 7, F.lit(1)).alias("delta"))


@query("""SELECT o_orderkey, sha256(concat_ws('/', length(o_orderpriority) || ':' || o_orderpriority, length(o_orderstatus) || ':' || o_orderstatus)) AS shape,
    concat_ws('|', CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END) AS tag FROM orders""")
def b10_b11_shapes_and_tags(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", Q.shape_hash(F.array("o_orderpriority", "o_orderstatus")).alias("shape"), Q.evidence_tag({"large": F.col("o_totalprice") > 200000, "open": F.col("o_orderstatus") == "O"}).alias("tag"))


@query(f"""WITH {_E}, c AS (
        SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN user_id % 10 = 0 THEN 'tombstoned' WHEN user_id % 3 = 0 AND event_type = 'purchase' THEN 'tracked_trade' WHEN user_id % 3 = 0 THEN 'tracked' ELSE 'unrelated' END AS class, user_id FROM e),
    n AS (SELECT class, user_id, count(*) AS updates FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY updates DESC, user_id) AS place FROM n)
    SELECT * FROM r WHERE place <= 5""")
def class_volume_top5(spark, sf_dir):
    user, kind = F.col("user_id"), F.col("event_type")
    rules = [(kind == "error", "failed"), (user % 10 == 0, "tombstoned"), ((user % 3 == 0) & (kind == "purchase"), "tracked_trade"), (user % 3 == 0, "tracked")]
    n = events(spark, sf_dir).groupBy(Q.class_of(rules, "unrelated").alias("class"), "user_id").agg(F.count(F.lit(1)).alias("updates"))
    return n.withColumn("place", F.expr("row_number() over (partition by class order by updates desc, user_id)")).where("place <= 5")


@query(f"""WITH {_E}, s AS (SELECT user_id, us // 1000000 AS s, count(*) AS n FROM e GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT user_id, min(s) * 1000000 AS degraded_us, arg_min(CASE WHEN n > 2 THEN 'rate' ELSE 'queued' END, s) AS reason FROM r WHERE n > 2 OR run > 40 GROUP BY user_id""")
def b15_noisy_keys(spark, sf_dir):
    return Q.noisy_keys(events(spark, sf_dir), "user_id", "us", 2, 40)


@query(f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, us // 86400000000 ORDER BY us DESC, event_id DESC) AS p FROM e) SELECT user_id, event_id, us FROM r WHERE p = 1")
def b16_coalesced(spark, sf_dir):
    return Q.coalesced(events(spark, sf_dir), "user_id", "us", 86_400_000_000, ["us", "event_id"]).select("user_id", "event_id", "us")


@query(f"""WITH {_E}, g AS (SELECT DISTINCT CAST(k AS BIGINT) AS program, event_id AS slot, user_id AS mint FROM e WHERE event_type = 'signup' AND user_id % 5 = 0)
    SELECT DISTINCT event_id, user_id FROM e WHERE user_id IN (SELECT mint FROM g) OR EXISTS (SELECT 1 FROM g WHERE g.program = e.k AND e.event_id BETWEEN g.slot AND g.slot + 64)""")
def b18_retained(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.col("user_id").alias("mint"), F.col("k").alias("program"), F.col("event_id").alias("slot"), "event_type")
    out = Q.retained(e, e.where("event_type = 'signup' and mint % 5 = 0").select("mint", "program", "slot"), 64)
    return out.select("event_id", F.col("mint").alias("user_id"))


_GAPS = """g AS (SELECT CASE WHEN event_id % 400 = 1 THEN 'source' ELSE 'token' END AS scope, CASE WHEN event_id % 400 = 1 THEN 0 ELSE user_id END AS key, us, event_type = 'view' AS recovered FROM e WHERE event_id % 20 = 1 OR event_type = 'view' AND event_id % 3 = 0),
    i AS (SELECT scope, key, us AS start_us, coalesce(min(CASE WHEN recovered THEN us END) OVER (PARTITION BY scope, key ORDER BY us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1706745600000000) AS stop_us, recovered FROM g)"""


def _gaps(spark, sf_dir):
    g = events(spark, sf_dir).where("event_id % 20 = 1 or event_type = 'view' and event_id % 3 = 0")
    g = g.selectExpr("if(event_id % 400 = 1, 'source', 'token') as scope", "if(event_id % 400 = 1, 0, user_id) as key", "us", "event_type = 'view' as recovered")
    return Q.gap_intervals(g, 1706745600000000)


@query(f"WITH {_E}, {_GAPS} SELECT scope, key, start_us, stop_us FROM i WHERE NOT recovered")
def b19_gap_intervals(spark, sf_dir):
    return _gaps(spark, sf_dir)


@query(f"""WITH {_E}, {_GAPS}
    SELECT event_id, NOT EXISTS (SELECT 1 FROM i WHERE NOT recovered AND e.us >= start_us AND e.us < stop_us AND (scope <> 'token' OR key = user_id)) AS allowed FROM e""")
def b20_trade_allowed(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.col("event_id").alias("seq"), F.col("user_id").alias("mint"), "us")
    return Q.trade_allowed(e, _gaps(spark, sf_dir), 86_400_000_000).select("event_id", "allowed")


@query(f"WITH {_E} SELECT event_type AS kind, k % 3 AS source, count(*) AS events, max(us) AS last_us FROM e GROUP BY 1, 2")
def b21_source_health(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("kind"), (F.col("k") % 3).alias("source")).agg(F.count(F.lit(1)).alias("events"), F.max("us").alias("last_us"))


@query("SELECT count(*) FILTER (o_orderstatus <> 'P') AS allowed, count(*) FILTER (o_orderstatus = 'P') AS denied, count(*) FILTER (o_totalprice > 100000 AND o_orderstatus <> 'P') AS network_calls FROM orders")
def b22_request_ledger(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.agg(F.count_if(F.col("o_orderstatus") != "P").alias("allowed"), F.count_if(F.col("o_orderstatus") == "P").alias("denied"), F.count_if((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") != "P")).alias("network_calls"))


@query(f"""WITH {_E}, r AS (SELECT k, max(us) AS r FROM e WHERE event_type = 'error' AND user_id % 4 = 0 GROUP BY k)
    SELECT event_id FROM e LEFT JOIN r USING (k) WHERE NOT (event_type = 'click' AND r IS NOT NULL AND r >= us)""")
def b23_without_reverted(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"signature": F.col("k"), "tentative": F.col("event_type") == "click"})
    r = e.where("event_type = 'error' and user_id % 4 = 0").select("signature", F.col("us").alias("at"))
    return Q.without_reverted(e, r).select("event_id")


@query(f"""WITH {_E}, s AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'finalized' WHEN 'click' THEN 'confirmed' WHEN 'view' THEN 'processed' ELSE 'tentative' END AS status FROM e),
    r AS (SELECT *, CASE status WHEN 'finalized' THEN 3 WHEN 'confirmed' THEN 2 WHEN 'processed' THEN 1 ELSE 0 END AS rank FROM s)
    SELECT user_id, arg_max(status, rank) AS status, max(rank) = 0 AS tentative_only FROM r GROUP BY user_id""")
def b24_corrected(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("status", F.expr("case event_type when 'purchase' then 'finalized' when 'click' then 'confirmed' when 'view' then 'processed' else 'tentative' end"))
    return Q.corrected(e, "user_id")


@query("WITH x AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS us, lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before_us FROM orders) SELECT * FROM x WHERE before_us > us")
def b25_lookahead_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return Q.lookahead_violations(o, "o_custkey", "us", "o_orderkey")


@query(f"""WITH {_E}, c AS (SELECT k AS account, min(event_id) AS mint, min(us) AS created FROM e WHERE event_type = 'signup' GROUP BY k)
    SELECT event_id, mint, greatest(us, created) AS released_us FROM e JOIN c ON e.k = c.account WHERE event_type = 'view'""")
def b26_resolved_updates(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("account", F.col("k"))
    c = e.where("event_type = 'signup'").groupBy("account").agg(F.min("event_id").alias("mint"), F.min("us").alias("us"))
    return Q.resolved_updates(e.where("event_type = 'view'"), c, "account").select("event_id", "mint", "released_us")


@query(f"""WITH {_E} SELECT event_id, coalesce(nullif(abs(CASE WHEN k % 4 = 0 THEN NULL ELSE k - 50 END), 0), nullif(k % 3, 0), 1) AS tokens, coalesce(nullif(abs(value::BIGINT - 30), 0), k, 0) AS quote,
    floor(k * event_id / 1000000.0)::BIGINT AS fee_observed, ceil(k * event_id / 1000000.0)::BIGINT AS fee_modelled, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) = 1 AS first_buy FROM e WHERE event_type = 'purchase'""".replace("value::BIGINT", "floor(value)::BIGINT"))
def b27_b28_b29_trade_amounts(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    tokens, quote = Q.trade_amounts(F.expr("if(k % 4 = 0, null, k - 50)"), F.expr("k % 3"), F.expr("cast(floor(value) as bigint) - 30"), F.col("k"))
    first = F.expr("row_number() over (partition by user_id order by us, event_id) = 1")
    return e.select("event_id", tokens.alias("tokens"), quote.alias("quote"), Q.priority_fee(F.col("k"), F.col("event_id")).alias("fee_observed"), Q.priority_fee(F.col("k"), F.col("event_id"), True).alias("fee_modelled"), first.alias("first_buy"))


@query(f"WITH {_E}, r AS (SELECT user_id, event_type AS source, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS p FROM e) SELECT user_id, arg_min(source, (p, source)) AS source, count(*) AS reports FROM r GROUP BY user_id")
def z8_preferred_source(spark, sf_dir):
    return Q.preferred_source(events(spark, sf_dir).withColumnRenamed("event_type", "source"), ["user_id"], {"purchase": 0, "click": 1})


@query(with_views("ev", sql="""o AS (SELECT o_custkey, epoch_us(o_orderdate) AS us, max(o_totalprice) AS price FROM orders GROUP BY 1, 2),
    l AS (SELECT DISTINCT l_orderkey, l_linenumber, epoch_us(l_shipdate) AS us, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_linenumber, l.us, l.o_custkey, price FROM l ASOF LEFT JOIN o ON l.o_custkey = o.o_custkey AND l.us >= o.us"""))
def j_asof_last_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    right = o.groupBy("o_custkey", "us").agg(F.max("o_totalprice").alias("price"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"))
    n = lines.count()
    left = spread(lines, n, "l_orderkey").distinct().join(spread(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), n, "l_orderkey").distinct(), "l_orderkey")
    return J.asof(left, right, ["o_custkey"], "us", "price", n)


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, o_orderpriority AS shape, s_name IS NOT NULL AS known FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'O' LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0")
def j1_j4_j10_left_joins(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("shape"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("there"))
    return li.join(o, "l_orderkey", "left").join(s, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "l_suppkey", "shape", F.col("there").isNotNull().alias("known"))


@query(with_views("ev", sql="""t AS (SELECT wallet AS key, min(us) AS a FROM ev WHERE side = 'buy' GROUP BY 1), c AS (SELECT wallet AS key, min(us) AS b FROM ev WHERE side = 'sell' GROUP BY 1)
    SELECT key, CASE WHEN a IS NULL THEN 'canonical_only' WHEN b IS NULL THEN 'false_positive' WHEN b - a <= 86400000000 THEN 'matched' ELSE 'missing_later' END AS outcome, b - a AS lag_us FROM t FULL JOIN c USING (key)"""))
def j5_t8_reconcile(spark, sf_dir):
    t = ev_trades(spark, sf_dir).withColumn("key", F.col("wallet"))
    return J.reconcile(t.where("side = 'buy'").select("key", "us"), t.where("side = 'sell'").select("key", "us"), 86_400_000_000)


@query(with_views("ev", sql="""x AS (
        SELECT p.seq AS id, p.mint, p.us, e.us AS e_us, CASE WHEN e.side = 'sell' THEN 0 ELSE 1 END AS p, e.side AS kind FROM ev AS p JOIN ev AS e ON e.mint = p.mint AND e.us > p.us AND e.us <= p.us + 172800000000 WHERE p.side = 'sell'),
    b AS (SELECT id, arg_min(kind, (e_us, p, kind)) AS kind, min(e_us) AS e_us FROM x GROUP BY id)
    SELECT seq AS id, mint, us, coalesce(kind, 'expired') AS resolution, e_us - us AS latency_us FROM ev LEFT JOIN b ON id = seq WHERE side = 'sell'"""))
def j6_t7_first_resolution(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    pending = t.where("side = 'sell'").select(F.col("seq").alias("id"), "mint", "us")
    return J.first_resolution(pending, t.withColumn("kind", F.col("side")), ["mint"], 172_800_000_000, F.when(F.col("side") == "sell", 0).otherwise(1))


_SIGNATURE = "CASE WHEN seq % 3 = 0 THEN NULL ELSE CAST(quote AS INT) % 12 END"


@query(with_views("ev", sql=f"""i AS (SELECT *, {_SIGNATURE.replace('CAST(quote AS INT)', 'CAST(trunc(quote) AS INT)')} AS sig FROM ev) SELECT a.seq AS id, arg_min(b.seq, (b.us, b.seq)) AS original FROM i AS a JOIN i AS b ON a.mint = b.mint AND (b.us < a.us OR b.us = a.us AND b.seq < a.seq)
    AND CASE WHEN a.sig IS NOT NULL AND b.sig IS NOT NULL THEN a.sig = b.sig ELSE a.wallet = b.wallet AND a.us - b.us <= 864000000000 AND abs(a.quote - b.quote) <= 0.5 * greatest(a.quote, b.quote, 1) END GROUP BY 1"""))
def j7_duplicate_intents(spark, sf_dir):
    return J.duplicate_intents(ev_trades(spark, sf_dir).withColumns({"id": F.col("seq"), "signature": F.expr(_SIGNATURE)}), 864_000_000_000, 0.5)


@query(with_views("li", "fund", sql="""f AS (SELECT wallet, arg_max(funder, (us, edge)) AS funder FROM fund GROUP BY wallet),
    b AS (SELECT mint, wallet, min(us) AS us, min(seq) AS seq FROM li WHERE side = 'buy' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY us, seq) AS k FROM b),
    g AS (SELECT mint, funder, count(*) AS n FROM r JOIN f USING (wallet) WHERE k <= 8 GROUP BY 1, 2)
    SELECT mint, sum(n * (n - 1) // 2)::BIGINT AS pairs, count(*) AS funders FROM g GROUP BY mint"""))
def j8_j9_same_funder_pairs(spark, sf_dir):
    return J.same_funder_pairs(li_trades(spark, sf_dir), funding(spark, sf_dir), 8)


@query(with_views("ev", sql="""b AS (SELECT mint, wallet, coalesce(sum(quote) FILTER (side = 'buy'), 0) AS bought, coalesce(sum(quote) FILTER (side = 'sell'), 0) AS sold FROM ev GROUP BY 1, 2),
    x AS (SELECT *, round(sum(sold) OVER (PARTITION BY wallet) - sold, 6) AS elsewhere FROM b)
    SELECT mint, count(*) AS rotated_wallets, sum(elsewhere) AS rotated_notional FROM x WHERE bought > 0 AND elsewhere > 0 GROUP BY mint"""))
def j14_rotation(spark, sf_dir):
    return J.rotation(ev_trades(spark, sf_dir))


@query("""WITH o AS (SELECT o_orderkey AS position, o_custkey, epoch_us(o_orderdate) AS us, o_totalprice AS quote FROM orders WHERE o_orderstatus <> 'P'),
    l AS (SELECT l_orderkey AS position, max(epoch_us(l_shipdate)) AS exit_us, sum(l_extendedprice) AS exit_quote FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT position, us AS entry_us, exit_us, quote AS entry_quote, exit_quote, exit_quote - quote AS pnl, CASE WHEN us IS NULL THEN 'orphan_exit' WHEN exit_us IS NULL THEN 'open' ELSE 'closed' END AS status FROM o FULL JOIN l USING (position)""")
def j11_k6_pair_fills(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("position"), F.lit("buy").alias("side"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), F.col("o_totalprice").alias("quote"))
    x = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("position"), F.lit("sell").alias("side"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), F.col("l_extendedprice").alias("quote"))
    return J.pair_fills(o.union(x))


@query("""WITH o AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), n AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    l AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
    SELECT l.o_custkey, l.o_orderpriority, coalesce(o.k, n.k) AS o_orderkey FROM l LEFT JOIN o USING (o_custkey, o_orderpriority) LEFT JOIN n ON n.o_custkey = l.o_custkey""")
def j12_fallback(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return J.fallback(o.select("o_custkey", "o_orderpriority").distinct(), o.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"], ["o_custkey"], "o_orderkey", ["o_orderkey"])


@query("""WITH a AS (SELECT c_custkey AS k, 0 AS i, nullif(c_mktsegment, 'BUILDING') AS name, c_acctbal < 0 AS flag FROM customer),
    b AS (SELECT s_suppkey, 1, s_name, s_acctbal < 0 FROM supplier), c AS (SELECT p_partkey, 2, p_name, NULL::BOOLEAN FROM part),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
    SELECT k, arg_min(name, i) FILTER (name IS NOT NULL) AS name, coalesce(bool_or(flag), false) AS flag, string_agg(DISTINCT i::VARCHAR, ',' ORDER BY i::VARCHAR) AS sources FROM u GROUP BY k""")
def j13_j16_merge_sources(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "nullif(c_mktsegment, 'BUILDING') as name", "c_acctbal < 0 as flag")
    b = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "s_name as name", "s_acctbal < 0 as flag")
    c = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_name as name")
    return J.merge_sources([a, b, c], ["k"], ["name"], ["flag"])


@query("SELECT o_custkey, max(o_totalprice) AS price, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def j15_j17_best_per_key(spark, sf_dir):
    return J.best_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"], ["o_totalprice", "o_orderkey"]).withColumnRenamed("o_totalprice", "price")


@query(with_views("fund", sql="SELECT funder, wallet, sum(amount) AS amount, max(us) AS last_us, count(*) AS transfers FROM fund GROUP BY 1, 2"))
def g1_funding_edges(spark, sf_dir):
    return G.edges(funding(spark, sf_dir))


@query(with_views("fund", sql="""g AS (SELECT DISTINCT funder::VARCHAR AS a, wallet::VARCHAR AS b FROM fund WHERE funder <> wallet), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
    n AS (SELECT a AS wallet, list_sort(list_distinct(list_append(list(b), a))) AS m FROM u GROUP BY a)
    SELECT wallet, left('cluster-' || sha256(array_to_string(m, '|')), 20) AS cluster, len(m) AS members FROM n"""))
def g2_clusters(spark, sf_dir):
    return G.clusters(G.edges(funding(spark, sf_dir)))


@query(with_views("fund", sql="""f AS (SELECT DISTINCT funder, wallet FROM fund), p AS (SELECT DISTINCT c_nationkey AS payer, c_custkey AS wallet FROM customer WHERE c_acctbal < 0),
    a AS (SELECT wallet, sum(k) * 0.10 AS e FROM f JOIN (SELECT funder, count(*) - 1 AS k FROM f GROUP BY 1) USING (funder) GROUP BY wallet),
    b AS (SELECT wallet, sum(k) * 0.15 AS e FROM p JOIN (SELECT payer, count(*) - 1 AS k FROM p GROUP BY 1) USING (payer) GROUP BY wallet)
    SELECT wallet, least(1.0, sum(e)) AS evidence FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY wallet"""))
def g3_evidence(spark, sf_dir):
    payers = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("payer"), F.col("c_custkey").alias("wallet"))
    return G.evidence(G.edges(funding(spark, sf_dir)), payers)


@query(with_views("fund", sql="s AS (SELECT c_custkey AS wallet FROM customer WHERE c_custkey % 100 = 5) SELECT DISTINCT wallet FROM fund WHERE funder IN (SELECT funder FROM fund JOIN s USING (wallet)) UNION SELECT wallet FROM s"))
def g4_related(spark, sf_dir):
    seeds = table(spark, sf_dir, "customer").where("c_custkey % 100 = 5").select(F.col("c_custkey").alias("wallet"))
    return G.related(G.edges(funding(spark, sf_dir)), seeds)


@query(with_views("li", "fund", sql="""g AS (SELECT funder, wallet, sum(amount) AS amount, max(us) AS last_us, count(*) AS transfers FROM fund GROUP BY 1, 2), m AS (SELECT wallet, count(DISTINCT mint) AS mints FROM li WHERE side = 'buy' GROUP BY 1)
    SELECT funder, count(*) AS wallets, sum(amount) AS amount, sum(amount) / count(*) AS mean_amount, sum(transfers) / count(*) AS density, max(last_us) - min(last_us) <= 31536000000000 AS burst, count(*) FILTER (mints > 1) AS multi_launch
    FROM g LEFT JOIN m USING (wallet) GROUP BY funder"""))
def funding_profile(spark, sf_dir):
    launches = li_trades(spark, sf_dir).where("side = 'buy'").select("wallet", "mint")
    return G.profile(G.edges(funding(spark, sf_dir)), launches, 31_536_000_000_000)


_LEDGER = """
    n AS (SELECT *, row_number() OVER (PARTITION BY mint, wallet ORDER BY us, seq) AS i FROM ev),
    r AS (
        SELECT mint, wallet, i, CASE WHEN side = 'buy' THEN tokens ELSE 0 END AS held, CASE WHEN side = 'buy' THEN quote ELSE 0 END AS cost, 0.0::DOUBLE AS realised,
            CASE WHEN side = 'buy' THEN tokens ELSE 0 END AS bought, CASE WHEN side = 'buy' THEN 0 ELSE tokens END AS sold FROM n WHERE i = 1
        UNION ALL
        SELECT n.mint, n.wallet, n.i, CASE WHEN side = 'buy' THEN held + tokens ELSE held - least(tokens, held) END,
            CASE WHEN side = 'buy' THEN cost + quote ELSE cost - CASE WHEN held > 0 THEN cost / held ELSE 0 END * least(tokens, held) END,
            CASE WHEN side = 'buy' THEN realised ELSE realised + quote * least(tokens, held) / tokens - CASE WHEN held > 0 THEN cost / held ELSE 0 END * least(tokens, held) END,
            CASE WHEN side = 'buy' THEN bought + tokens ELSE bought END, CASE WHEN side = 'buy' THEN sold ELSE sold + tokens END
        FROM r JOIN n ON n.mint = r.mint AND n.wallet = r.wallet AND n.i = r.i + 1),
    p AS (SELECT r.* FROM r JOIN (SELECT mint, wallet, max(i) AS i FROM r GROUP BY 1, 2) USING (mint, wallet, i))"""


@query(with_views("ev", sql=_LEDGER + """, m AS (SELECT mint, arg_max(price, (us, seq)) AS price FROM ev GROUP BY mint)
    SELECT mint, wallet, held, cost, realised, bought, sold, CASE WHEN held > 0 THEN cost / held END AS average_entry, realised > 0 AS taken_profit, sold > 0 AND held <= 0 AS round_trip, price, held * price - cost AS unrealised FROM p LEFT JOIN m USING (mint)""").replace("WITH", "WITH RECURSIVE", 1))
def t1_positions(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    return L.marked(L.positions(t), t.groupBy("mint").agg(F.max_by("price", F.struct("us", "seq")).alias("price")))


@query("""WITH a AS (SELECT l_partkey AS mint, l_suppkey AS account, arg_max(o_custkey, (l_shipdate, l_orderkey, l_linenumber, l_quantity, o_custkey)) AS owner, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_quantity, o_custkey)) AS balance FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT mint, owner, sum(balance) AS balance, count(*) AS accounts FROM a GROUP BY 1, 2""")
def t2_owner_balances(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return L.owner_balances(x.select(F.col("l_partkey").alias("mint"), F.col("l_suppkey").alias("account"), F.col("o_custkey").alias("owner"), F.col("l_quantity").alias("balance"), F.col("l_shipdate").alias("us"), F.struct("l_orderkey", "l_linenumber", "l_quantity", "o_custkey").alias("seq")))


@query(with_views("ev", sql=_LEDGER + """, s AS (SELECT *, CASE WHEN bought > 0 THEN least(1.0, sold / bought) END AS sold_share FROM p)
    SELECT mint, wallet, sold_share, CASE WHEN bought <= 0 THEN 'seller_only' WHEN held <= 0 THEN 'exited' WHEN sold_share >= 0.9 THEN 'sold_90' WHEN sold > 0 THEN 'partial' ELSE 'holding' END AS status FROM s""").replace("WITH", "WITH RECURSIVE", 1))
def t3_behaviour(spark, sf_dir):
    return L.behaviour(L.positions(ev_trades(spark, sf_dir))).select("mint", "wallet", "sold_share", "status")


@query(with_views("ev", sql="""b AS (SELECT *, round(sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) OVER (PARTITION BY mint, wallet ORDER BY us, seq ROWS UNBOUNDED PRECEDING), 6) AS balance FROM ev),
    c AS (SELECT *, (balance > 0)::INT - (coalesce(lag(balance) OVER (PARTITION BY mint, wallet ORDER BY us, seq), 0) > 0)::INT AS change FROM b)
    SELECT mint, sum(greatest(change, 0))::BIGINT AS entries, sum(greatest(-change, 0))::BIGINT AS exits, sum(change)::BIGINT AS net, CASE WHEN sum(greatest(change, 0)) > 0 THEN 1 - sum(greatest(-change, 0)) / sum(greatest(change, 0)) END AS stickiness FROM c GROUP BY mint"""))
def t4_w9_holder_churn(spark, sf_dir):
    return L.holder_churn(L.balance_history(ev_trades(spark, sf_dir)))


@query(with_views("ev", sql=_LEDGER + """, h AS (SELECT mint, wallet, held AS balance FROM p WHERE held > 0), d AS (SELECT mint, sum(quote) AS depth FROM ev GROUP BY mint), c AS (SELECT mint, min(wallet) AS wallet FROM ev WHERE side = 'buy' GROUP BY mint),
    k AS (SELECT *, balance / sum(balance) OVER (PARTITION BY mint) AS share, row_number() OVER (PARTITION BY mint ORDER BY balance DESC, wallet) AS place FROM h),
    x AS (SELECT k.*, depth, c.mint IS NOT NULL AS creator, coalesce(realised >= cost AND sold > 0, false) AS free_roll FROM k JOIN p USING (mint, wallet) LEFT JOIN d USING (mint) LEFT JOIN c ON c.mint = k.mint AND c.wallet = k.wallet WHERE place <= 10),
    f AS (SELECT *, balance / depth * 15 AS load FROM x)
    SELECT mint, wallet, place, share, CASE WHEN creator THEN 'creator' WHEN free_roll THEN 'free_roller' WHEN share >= 0.1 THEN 'whale' ELSE 'top_holder' END AS class, free_roll,
        least(1, greatest(0, (share * 70 + load) * 0.25)) * 100 AS impact_25, least(1, greatest(0, (share * 70 + load) * 0.5)) * 100 AS impact_50, least(1, greatest(0, share * 70 + load)) * 100 AS impact_100 FROM f""").replace("WITH", "WITH RECURSIVE", 1))
def t5_exit_threats(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    ledger = L.positions(t)
    held = ledger.where("held > 0").select("mint", "wallet", F.col("held").alias("balance"))
    return L.exit_threats(held, ledger, t.groupBy("mint").agg(F.sum("quote").alias("depth")), t.where("side = 'buy'").groupBy("mint").agg(F.min("wallet").alias("wallet")))


@query(with_views("li", sql="""h AS (SELECT mint, wallet, sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) AS balance FROM li GROUP BY 1, 2), s AS (SELECT mint, sum(tokens) FILTER (side = 'buy') / 4 AS supply FROM li GROUP BY mint), x AS (SELECT * FROM h JOIN s USING (mint))
    SELECT mint, wallet, 'negative_balance' AS violation FROM x WHERE balance < 0 UNION ALL SELECT mint, wallet, 'share_above_one' FROM x WHERE balance > supply
    UNION ALL SELECT mint, NULL, 'supply_exceeded' FROM x GROUP BY mint HAVING sum(balance) > max(supply)"""))
def t11_invariants(spark, sf_dir):
    t = li_trades(spark, sf_dir)
    held = t.groupBy("mint", "wallet").agg(F.sum(F.when(F.col("side") == "buy", F.col("tokens")).otherwise(-F.col("tokens"))).alias("balance"))
    return L.invariant_violations(held, t.groupBy("mint").agg((F.sum(F.when(F.col("side") == "buy", F.col("tokens"))) / 4).alias("supply")))



@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_retailprice END AS q, p_size * 20000000.0 AS b, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 7 END AS price FROM part),
    d AS (SELECT *, CASE WHEN q > 0 AND b > 0 THEN q / b END AS derived FROM p)
    SELECT p_partkey, CASE WHEN price IS NOT NULL THEN 'observed' WHEN derived IS NOT NULL THEN 'derived' ELSE 'missing' END AS price_source, coalesce(price, derived) AS price, least(100, greatest(0, 100 - greatest(b - 206900000, 0) * 100 / 793100000)) AS progress,
        coalesce(price, derived) * 1000000000 AS market_cap, CASE WHEN price IS NOT NULL THEN 1.0 WHEN derived IS NOT NULL THEN 0.7 ELSE 0 END AS price_confidence FROM d""")
def b12_enriched_curve(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "if(p_size % 5 = 0, 0D, p_retailprice) as quote", "p_size * 20000000D as base", "if(p_partkey % 3 = 0, p_retailprice / 7, null) as price")
    return Q.enriched_curve(p).select("p_partkey", "price_source", "price", "progress", "market_cap", "price_confidence")
