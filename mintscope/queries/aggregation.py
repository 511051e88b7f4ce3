"""U: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import balances, ev_trades, li_trades, table, with_views
from ..operators import aggregates as A
from ..operators.windows import first_buyers
from . import query


@query(with_views("ev", sql="""
    SELECT mint, count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side = 'sell') AS sells,
        coalesce(sum(quote) FILTER (side = 'buy'), 0) AS buy_volume, coalesce(sum(quote) FILTER (side = 'sell'), 0) AS sell_volume,
        count(DISTINCT wallet) FILTER (side = 'buy') AS unique_buyers, count(DISTINCT wallet) FILTER (side = 'sell') AS unique_sellers,
        max(price) AS ath, min(price) AS atl, arg_max(price, (us, seq)) AS latest_price, arg_min(price, (us, seq)) AS first_price,
        max(us) FILTER (side = 'buy') AS last_buy_us, max(us) FILTER (side = 'sell') AS last_sell_us,
        min(us) FILTER (side = 'sell' AND quote >= 5) AS first_large_sell_us
    FROM ev GROUP BY mint"""))
def u1_trade_stats(spark, sf_dir):
    return A.trade_stats(ev_trades(spark, sf_dir))


_RANKS = with_views("li", sql="""
    r AS (SELECT mint, {v} AS v, row_number() OVER (PARTITION BY mint ORDER BY {v}) - 1 AS i, count(*) OVER (PARTITION BY mint) AS n FROM li WHERE side = 'buy')
    SELECT mint, max(v) FILTER (i = (n - 1) * 50 // 100) AS p50, max(v) FILTER (i = (n - 1) * 90 // 100) AS p90 FROM r GROUP BY mint""")


@query(_RANKS.format(v="quote"))
def u2_percentiles(spark, sf_dir):
    return A.percentiles(li_trades(spark, sf_dir).where("side = 'buy'"), ["mint"], "quote", [50, 90])


@query(with_views("li", "bal", sql="""
    r AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY balance, wallet) AS up, row_number() OVER (PARTITION BY mint ORDER BY balance DESC, wallet) AS down FROM bal)
    SELECT mint, count(*) AS holders, sum(balance) AS supply, 2 * sum(up * balance) / (count(*) * sum(balance)) - (count(*) + 1) / count(*) AS gini,
        sum(balance * balance) / (sum(balance) * sum(balance)) AS hhi,
        sum(balance) FILTER (down <= 1) / sum(balance) * 100 AS top1_pct, sum(balance) FILTER (down <= 3) / sum(balance) * 100 AS top3_pct,
        sum(balance) FILTER (down <= 5) / sum(balance) * 100 AS top5_pct, sum(balance) FILTER (down <= 10) / sum(balance) * 100 AS top10_pct,
        sum(balance) FILTER (down <= 20) / sum(balance) * 100 AS top20_pct
    FROM r GROUP BY mint"""))
def u3_u4_u5_concentration(spark, sf_dir):
    return A.concentration(balances(spark, sf_dir))


@query(with_views("li", "bal", sql="""
    left_ AS (SELECT * FROM bal WHERE wallet % 10 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY balance DESC, wallet) AS down FROM left_),
    s AS (SELECT mint, sum(balance) AS supply FROM bal GROUP BY mint)
    SELECT mint, count(*) AS holders, sum(balance) FILTER (down <= 10) / any_value(supply) * 100 AS top_pct FROM r JOIN s USING (mint) GROUP BY mint"""))
def u6_u7_top_share_without_owners(spark, sf_dir):
    held = balances(spark, sf_dir)
    return A.top_share(held, held.where("wallet % 10 = 0").select("mint", "wallet"), held.groupBy("mint").agg(F.sum("balance").alias("supply")), 10)


@query(with_views("li", sql="""
    c AS (SELECT mint, account, count(*) AS n FROM li GROUP BY 1, 2)
    SELECT mint, max(n) AS max_group, max(n) / sum(n) AS dominant_share, count(*) AS groups FROM c GROUP BY mint"""))
def u8_dominant_share(spark, sf_dir):
    return A.dominant_share(li_trades(spark, sf_dir), ["mint"], "account")


@query(with_views("ev", sql="""
    f AS (SELECT mint, wallet, quote, row_number() OVER (PARTITION BY mint, wallet ORDER BY us, seq) AS k FROM ev WHERE side = 'buy'),
    c AS (SELECT mint, round_even(CAST(quote AS DECIMAL(38, 9)), 1) AS q, count(*) AS n FROM f WHERE k = 1 GROUP BY 1, 2)
    SELECT mint, max(n) AS identical_amounts FROM c GROUP BY mint"""))
def u9_identical_amounts(spark, sf_dir):
    return A.identical_amounts(first_buyers(ev_trades(spark, sf_dir), 1_000_000), 1)


@query(with_views("li", sql="""
    SELECT wallet, min(us) AS first_us, max(us) AS last_us, count(DISTINCT mint) AS mints,
        coalesce(sum(tokens) FILTER (side = 'buy'), 0) AS bought, coalesce(sum(tokens) FILTER (side = 'sell'), 0) AS sold
    FROM li GROUP BY wallet"""))
def u10_wallet_summary(spark, sf_dir):
    return A.wallet_summary(li_trades(spark, sf_dir))


@query(with_views("li", sql="""
    creator AS (SELECT mint, min(wallet) AS wallet FROM li WHERE side = 'buy' GROUP BY mint)
    SELECT mint, wallet, coalesce(sum(tokens) FILTER (side = 'buy'), 0) - coalesce(sum(tokens) FILTER (side = 'sell'), 0) AS net_tokens,
        sum(CASE WHEN side = 'buy' THEN -quote ELSE quote END) AS net_quote, min(us) FILTER (side = 'sell') AS first_sell_us,
        CASE WHEN sum(tokens) FILTER (side = 'buy') > 0 THEN least(1.0, coalesce(sum(tokens) FILTER (side = 'sell'), 0) / sum(tokens) FILTER (side = 'buy')) END AS sold_share
    FROM li JOIN creator USING (mint, wallet) GROUP BY mint, wallet"""))
def u11_creator_state(spark, sf_dir):
    trades = li_trades(spark, sf_dir)
    return A.creator_state(trades, trades.where("side = 'buy'").groupBy("mint").agg(F.min("wallet").alias("wallet")))


@query(with_views("ev", sql="""
    SELECT mint, sum(quote) FILTER (side = 'buy') AS buy_volume, count(*) FILTER (side = 'buy') AS buys FROM ev GROUP BY mint
    ORDER BY buy_volume DESC, buys DESC, mint LIMIT 10"""))
def u13_top_mints(spark, sf_dir):
    return A.top_mints(A.trade_stats(ev_trades(spark, sf_dir)).select("mint", "buys", "sells", "buy_volume"), 10)


def _reasons() -> F.Column:
    """Reasons of a line, as a stand-in for a decision's codes."""
    return F.array_compact(F.array(F.concat(F.lit("flag_"), F.col("l_returnflag")), F.when(F.col("l_discount") >= 0.05, "deep_discount"), F.when(F.col("l_quantity") < 10, "small_lot"), F.when(F.col("l_tax") == 0, "untaxed")))


_REASONS = """r AS (
    SELECT l_linestatus, unnest(list_filter([concat('flag_', l_returnflag), CASE WHEN l_discount >= 0.05 THEN 'deep_discount' END,
        CASE WHEN l_quantity < 10 THEN 'small_lot' END, CASE WHEN l_tax = 0 THEN 'untaxed' END], lambda x: x IS NOT NULL)) AS code FROM lineitem)"""


@query(f"WITH {_REASONS} SELECT code, count(*) AS count FROM r GROUP BY code")
def u14_reason_histogram(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return A.histogram(lines.select(_reasons().alias("codes")), "codes")


@query(f"""WITH {_REASONS}, c AS (SELECT l_linestatus, code, count(*) AS count FROM r GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY count DESC, code) AS place FROM c)
    SELECT * FROM p WHERE place <= 3""")
def u18_top_reasons(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return A.top_reasons(lines.select("l_linestatus", _reasons().alias("codes")), ["l_linestatus"], "codes", 3)


@query("""
    SELECT o_orderpriority AS strategy, count(*) AS fills, count(*) FILTER (o_totalprice > 200000) AS wins, sum(o_totalprice - 200000) AS net_pnl,
        max(o_totalprice - 200000) AS best, count(*) FILTER (o_orderstatus = 'O') AS status_O, count(*) FILTER (o_orderstatus = 'F') AS status_F, count(*) FILTER (o_orderstatus = 'P') AS status_P
    FROM orders GROUP BY 1""")
def u15_strategy_attribution(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pnl = F.col("o_totalprice") - 200000
    return o.groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.count(F.lit(1)).alias("fills"), F.count_if(pnl > 0).alias("wins"), F.sum(pnl).alias("net_pnl"), F.max(pnl).alias("best"), *[F.count_if(F.col("o_orderstatus") == s).alias(f"status_{s}") for s in "OFP"])


@query("""
    WITH e AS (SELECT avg(o_totalprice) AS expected, count(*) FILTER (o_orderstatus = 'O') AS entered, count(*) FILTER (o_orderstatus = 'P') AS watched FROM orders),
    r AS (SELECT avg(l_extendedprice * (1 - l_discount)) AS realised FROM lineitem)
    SELECT expected, realised, expected - realised AS gap, entered, watched FROM e, r""")
def u16_edge_calibration(spark, sf_dir):
    o = table(spark, sf_dir, "orders").agg(F.avg("o_totalprice").alias("expected"), F.count_if(F.col("o_orderstatus") == "O").alias("entered"), F.count_if(F.col("o_orderstatus") == "P").alias("watched"))
    r = table(spark, sf_dir, "lineitem").agg(F.avg(F.expr("l_extendedprice * (1 - l_discount)")).alias("realised"))
    return o.join(r).select("expected", "realised", (F.col("expected") - F.col("realised")).alias("gap"), "entered", "watched")


@query("""
    WITH o AS (SELECT o_totalprice, o_orderstatus, o_custkey % 20 = 0 AS k, row_number() OVER (ORDER BY o_orderkey, o_custkey) - 1 AS i FROM orders),
    c AS (
        SELECT 'all' AS cohort, * FROM o UNION ALL SELECT 'large', * FROM o WHERE o_totalprice >= 300000
        UNION ALL SELECT 'open', * FROM o WHERE o_orderstatus = 'O' UNION ALL SELECT 'sampled', * FROM o WHERE k)
    SELECT cohort, count(*) AS rows, avg((o_totalprice > 150000)::INT) AS hit_rate, avg((o_orderstatus = 'F')::INT) AS done_rate FROM c GROUP BY cohort""")
def u20_cohort_rates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cohorts = {"all": F.lit(True), "large": F.col("o_totalprice") >= 300000, "open": F.col("o_orderstatus") == "O", "sampled": F.col("o_custkey") % 20 == 0}
    return A.overlapping_rates(o, cohorts, {"hit_rate": F.col("o_totalprice") > 150000, "done_rate": F.col("o_orderstatus") == "F"})


@query("""
    SELECT unnest(['rows', 'open', 'mean_price', 'max_price']) AS metric,
        unnest([count(*)::DOUBLE, count(*) FILTER (o_orderstatus = 'O')::DOUBLE, avg(o_totalprice), max(o_totalprice)]) AS value FROM orders""")
def u_long_summary(spark, sf_dir):
    return A.long_summary(table(spark, sf_dir, "orders"), {"rows": F.count(F.lit(1)), "open": F.count_if(F.col("o_orderstatus") == "O"), "mean_price": F.avg("o_totalprice"), "max_price": F.max("o_totalprice")})


@query("""
    WITH x AS (
        SELECT l_linestatus AS horizon, CASE WHEN l_discount > 0.02 THEN l_discount END AS a, CASE WHEN l_tax > 0.03 THEN l_tax END AS b, CASE WHEN l_quantity > 5 THEN l_quantity END AS c FROM lineitem),
    g AS (
        SELECT horizon, 'cost' AS feature_group, ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) / 2 AS p FROM x
        UNION ALL SELECT horizon, 'size', (c IS NOT NULL)::INT FROM x)
    SELECT horizon, feature_group, count(*) AS rows, avg(p) AS present_ratio, count(*) FILTER (p = 1) AS complete FROM g GROUP BY 1, 2""")
def u23_u24_missingness(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").selectExpr("l_linestatus as horizon", "case when l_discount > 0.02 then l_discount end as a", "case when l_tax > 0.03 then l_tax end as b", "case when l_quantity > 5 then l_quantity end as c")
    return A.missingness(x, ["horizon"], {"cost": ["a", "b"], "size": ["c"]})


@query("""
    SELECT event_type AS source, count(*) AS events, count(DISTINCT user_id) AS users, sum((n > 1)::INT) AS duplicates
    FROM (SELECT event_type, user_id, count(*) OVER (PARTITION BY event_type, user_id, date_trunc('day', ts)) AS n FROM events) GROUP BY 1""")
def u29_source_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("n", F.expr("count(1) over (partition by event_type, user_id, date_trunc('day', ts))"))
    return e.groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("n") > 1).alias("duplicates"))
