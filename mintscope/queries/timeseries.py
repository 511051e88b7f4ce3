"""W: windows and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import balances, ev_launches, ev_trades, li_trades, table, with_views
from ..functions.math import exact_sum
from ..operators import windows as W
from ..operators.cohorts import cohort_ranks
from . import query


@query(with_views("ev", sql="""
    r AS (SELECT mint, wallet, side, seq, row_number() OVER (PARTITION BY mint ORDER BY us DESC, seq DESC) AS place FROM ev)
    SELECT * FROM r WHERE place <= 12"""))
def w1_bounded_history(spark, sf_dir):
    return W.bounded_history(ev_trades(spark, sf_dir), 12).select("mint", "wallet", "side", "seq", "place")


@query(with_views("ev", sql="""
    r AS (
        SELECT mint, seq, price, us, arg_min(price, (us, seq)) OVER a AS pa, arg_min(us, (us, seq)) OVER a AS ua, arg_min(price, (us, seq)) OVER b AS pb, arg_min(us, (us, seq)) OVER b AS ub
        FROM ev WINDOW a AS (PARTITION BY mint ORDER BY us RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW), b AS (PARTITION BY mint ORDER BY us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW))
    SELECT mint, seq, CASE WHEN pa > 0 THEN (price - pa) / pa END AS return_43200s, CASE WHEN us > ua THEN (price - pa) / ((us - ua) / 1000.0) END AS velocity_43200s,
        CASE WHEN pb > 0 THEN (price - pb) / pb END AS return_172800s, CASE WHEN us > ub THEN (price - pb) / ((us - ub) / 1000.0) END AS velocity_172800s
    FROM r"""))
def w2_w4_window_returns(spark, sf_dir):
    out = W.window_returns(ev_trades(spark, sf_dir), [43200, 172800])
    return out.select("mint", "seq", "return_43200s", "velocity_43200s", "return_172800s", "velocity_172800s")


@query(with_views("ev", sql="""
    a AS (SELECT mint, max(us) AS "at" FROM ev GROUP BY mint),
    x AS (SELECT ev.mint, a."at", price, lag(price) OVER (PARTITION BY ev.mint ORDER BY us, seq) AS before FROM ev JOIN a ON ev.mint = a.mint AND us >= a."at" - 604800000000 AND us <= a."at"),
    v AS (SELECT mint, "at", avg(abs(price / before - 1)) AS volatility FROM x WHERE before > 0 GROUP BY 1, 2)
    SELECT a.mint, a."at", volatility FROM a LEFT JOIN v USING (mint, "at")"""))
def w3_mean_absolute_return(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    return W.mean_absolute_return(t, t.groupBy("mint").agg(F.max("us").alias("at")), 604800)


@query(with_views("ev", sql="""
    x AS (
        SELECT *, max(price) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high, max(price) OVER (o ROWS UNBOUNDED PRECEDING) AS run,
            max(us) FILTER (side = 'buy') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM ev WINDOW o AS (PARTITION BY mint ORDER BY us, seq))
    SELECT mint, arg_min(us, (-price, us, seq)) AS ath_us, count(*) FILTER (price > high) AS new_highs, max((run - price) / run) AS max_drawdown,
        1 - arg_max(price, (us, seq)) / max(price) AS end_drawdown, max(us - before) FILTER (side = 'buy') AS longest_gap_us
    FROM x GROUP BY mint"""))
def w5_w6_w7_price_path(spark, sf_dir):
    return W.price_path(ev_trades(spark, sf_dir))


@query(with_views("ev", sql="""
    SELECT mint, seq, coalesce(sum(quote) FILTER (side = 'buy') OVER w, 0) AS buy_volume, sum(CASE WHEN side = 'buy' THEN quote ELSE -quote END) OVER w AS net_flow,
        count(DISTINCT CASE WHEN side = 'buy' THEN wallet END) OVER w AS buyers
    FROM ev WINDOW w AS (PARTITION BY mint ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)"""))
def w8_w9_window_flow(spark, sf_dir):
    return W.window_flow(ev_trades(spark, sf_dir), 86400).select("mint", "seq", "buy_volume", "net_flow", "buyers")


@query(with_views("ev", sql="""
    f AS (SELECT mint, wallet, min((us, seq, quote)) AS f FROM ev WHERE side = 'buy' GROUP BY 1, 2),
    r AS (SELECT mint, wallet, row_number() OVER (PARTITION BY mint ORDER BY f) AS place, f[1] AS us, f[3] AS quote FROM f)
    SELECT mint, wallet, place, us, quote FROM r WHERE place <= 8""").replace("min((us, seq, quote)) AS f", "min(us) AS us, arg_min(seq, (us, seq)) AS seq, arg_min(quote, (us, seq)) AS quote").replace("ORDER BY f) AS place, f[1] AS us, f[3] AS quote", "ORDER BY us, seq) AS place, us, quote"))
def w10_first_buyers(spark, sf_dir):
    return W.first_buyers(ev_trades(spark, sf_dir), 8)


@query(with_views("ev", sql="""
    h AS (SELECT mint, wallet, min(us) FILTER (side = 'buy') AS b, min(us) FILTER (side = 'sell') AS s FROM ev GROUP BY 1, 2)
    SELECT mint, count(*) AS wallets, avg(greatest(0, s - b) / 1000000.0) AS mean_seconds, max(greatest(0, s - b) / 1000000.0) AS max_seconds
    FROM h WHERE b IS NOT NULL AND s IS NOT NULL GROUP BY mint"""))
def w11_holding_times(spark, sf_dir):
    return W.holding_times(ev_trades(spark, sf_dir))


@query(with_views("li", "bal", sql="""
    f AS (SELECT mint, wallet, min(us) AS us, min(seq) AS seq FROM li WHERE side = 'buy' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY us, seq) AS place FROM f)
    SELECT r.mint, count(bal.mint) / count(*) AS retention FROM r LEFT JOIN bal ON r.mint = bal.mint AND r.wallet = bal.wallet WHERE place <= 20 GROUP BY r.mint"""))
def w12_retention(spark, sf_dir):
    return W.retention(li_trades(spark, sf_dir), balances(spark, sf_dir), 20)


_COHORT = """
    s AS (SELECT mint, coalesce(sum(quote) FILTER (side = 'buy'), 0) AS score FROM ev GROUP BY mint),
    p AS (
        SELECT a.mint, b.mint AS other, x.score, y.score AS theirs FROM launch AS a JOIN launch AS b ON abs(a.launch_us - b.launch_us) <= {w}
        JOIN s AS x ON x.mint = a.mint JOIN s AS y ON y.mint = b.mint)
    SELECT mint, count(*) AS cohort, count(*) FILTER (theirs > score OR theirs = score AND other < mint) + 1 AS rank, avg((theirs <= score)::INT) AS percentile FROM p GROUP BY mint"""


@query(with_views("ev", "launch", sql=_COHORT.format(w=43200000000)))
def w13_w14_j3_cohort_ranks(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    score = t.groupBy("mint").agg(F.coalesce(exact_sum(F.when(F.col("side") == "buy", F.col("quote"))), F.lit(0.0)).alias("score"))
    return cohort_ranks(ev_launches(spark, sf_dir), score, 43200)


@query(with_views("ev", "launch", sql="""
    c AS (SELECT l.mint, sum(quote) FILTER (us <= launch_us + 432000000000) AS a, sum(quote) FILTER (us <= launch_us + 1296000000000) AS b FROM launch AS l JOIN ev ON ev.mint = l.mint AND us >= launch_us GROUP BY l.mint),
    p AS (SELECT x.mint, count(*) FILTER (coalesce(y.a, 0) > coalesce(x.a, 0) OR coalesce(y.a, 0) = coalesce(x.a, 0) AND y.mint < x.mint) + 1 AS ra,
            count(*) FILTER (coalesce(y.b, 0) > coalesce(x.b, 0) OR coalesce(y.b, 0) = coalesce(x.b, 0) AND y.mint < x.mint) + 1 AS rb
        FROM c AS x JOIN launch AS l ON l.mint = x.mint JOIN launch AS m ON abs(l.launch_us - m.launch_us) <= 43200000000 JOIN c AS y ON y.mint = m.mint GROUP BY x.mint)
    SELECT mint, ra AS early_rank, rb AS late_rank, rb - ra AS rank_velocity FROM p"""))
def w15_rank_velocity(spark, sf_dir):
    t, launches = ev_trades(spark, sf_dir), ev_launches(spark, sf_dir)
    by = lambda days: F.coalesce(exact_sum(F.when(F.col("us") <= F.col("launch_us") + days * 86400 * W.SECOND, F.col("quote"))), F.lit(0.0))
    c = t.join(launches, "mint").where("us >= launch_us").groupBy("mint").agg(by(5).alias("a"), by(15).alias("b"))
    early = cohort_ranks(launches, c.select("mint", F.col("a").alias("score")), 43200).select("mint", F.col("rank").alias("early_rank"))
    late = cohort_ranks(launches, c.select("mint", F.col("b").alias("score")), 43200).select("mint", F.col("rank").alias("late_rank"))
    return early.join(late, "mint").withColumn("rank_velocity", F.col("late_rank") - F.col("early_rank"))


@query(with_views("ev", sql="""
    h AS (SELECT mint, min(us) AS hus, arg_min(seq, (us, seq)) AS hseq FROM ev WHERE side = 'sell' AND quote >= 50 GROUP BY mint),
    b AS (SELECT ev.mint, arg_max(price, (us, seq)) AS pb FROM ev JOIN h USING (mint) WHERE (us, seq) < (hus, hseq) GROUP BY ev.mint),
    a AS (SELECT ev.*, hus, pb FROM ev JOIN h USING (mint) LEFT JOIN b USING (mint) WHERE (us, seq) > (hus, hseq))
    SELECT h.mint, count(a.mint) FILTER (side = 'buy') AS buys_after, coalesce(sum(quote) FILTER (side = 'buy'), 0) AS volume_after, count(DISTINCT wallet) FILTER (side = 'buy') AS buyers_after,
        min(us - a.hus) FILTER (price >= pb) AS recovery_us, max(price / pb) AS recovery
    FROM h LEFT JOIN a USING (mint) GROUP BY h.mint"""))
def w16_absorption(spark, sf_dir):
    return W.absorption(ev_trades(spark, sf_dir), 50.0)


@query(with_views("ev", sql="""
    s AS (SELECT mint, min(us) AS su, arg_min(price, (us, seq)) AS sp FROM ev GROUP BY mint),
    x AS (SELECT ev.mint, us, su, price / sp - 1 AS m FROM ev JOIN s USING (mint) WHERE us >= su AND sp > 0)
    SELECT mint, max(m) FILTER (us <= su + 86400000000) AS max_return_86400s, min(m) FILTER (us <= su + 86400000000) AS max_drawdown_86400s,
        max(m) FILTER (us <= su + 604800000000) AS max_return_604800s, min(m) FILTER (us <= su + 604800000000) AS max_drawdown_604800s,
        min(us - su) FILTER (m >= 0.2) AS up20_us, min(us - su) FILTER (m <= -0.5) AS down50_us
    FROM x GROUP BY mint"""))
def w17_forward_extremes(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    starts = t.groupBy("mint").agg(F.min("us").alias("start_us"), F.min_by("price", F.struct("us", "seq")).alias("start_price"))
    return W.forward_extremes(t, starts, [86400, 604800])


@query(with_views("ev", sql="SELECT mint, seq, avg(price) OVER (PARTITION BY mint ORDER BY us, seq ROWS 11 PRECEDING) AS trailing_mean FROM ev"))
def w18_trailing_mean(spark, sf_dir):
    return W.trailing_mean(ev_trades(spark, sf_dir)).select("mint", "seq", "trailing_mean")


_STATES = """
    b AS (SELECT *, sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) OVER (PARTITION BY mint, wallet ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS bal FROM ev),
    d AS (SELECT mint, us, seq, wallet, side, (bal > 0)::INT - (bal - CASE WHEN side = 'buy' THEN tokens ELSE -tokens END > 0)::INT AS turn, NULL AS mark, 1 AS one FROM b
        UNION ALL SELECT user_id, epoch_us(ts), event_id, NULL, NULL, 0, CASE WHEN (props->>'$.k')::BIGINT < 40 THEN 'DataGap' ELSE 'HardDiscarded' END, 0 FROM events WHERE event_type = 'view' AND (props->>'$.k')::BIGINT BETWEEN 38 AND 41),
    c AS (SELECT *, sum(one) OVER w AS n, sum(turn) OVER w AS holders, count(DISTINCT CASE WHEN side = 'buy' THEN wallet END) OVER w AS buyers, first_value(mark IGNORE NULLS) OVER w AS held FROM d WINDOW w AS (PARTITION BY mint ORDER BY us, seq ROWS UNBOUNDED PRECEDING)),
    z AS (SELECT *, CASE WHEN held IS NOT NULL THEN held WHEN n >= 4 OR holders >= 4 OR buyers >= 3 THEN 'ActiveDeep' WHEN n >= 2 OR holders >= 2 THEN 'ActiveLight' WHEN n >= 1 THEN 'FirstPass' ELSE 'Discovered' END AS state FROM c),
    e AS (SELECT *, us + 1000000::BIGINT * CASE state WHEN 'Discovered' THEN 900 WHEN 'ActiveDeep' THEN 7200 WHEN 'FirstPass' THEN 1800 WHEN 'ActiveLight' THEN 1800 ELSE 259200 END AS expires_us, lag(state) OVER (PARTITION BY mint ORDER BY us, seq) AS p, lead(us) OVER (PARTITION BY mint ORDER BY us, seq) AS next_us FROM z)"""


def lifecycle_marks(spark, sf_dir):
    """Gaps and discards that a token's state is held at: some of its views."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "view") & k.between(38, 41))
    return e.select(F.col("user_id").alias("mint"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("seq"), F.when(k < 40, "DataGap").otherwise("HardDiscarded").alias("mark"))


@query(with_views("ev", sql=_STATES + " SELECT mint, us, seq, coalesce(p, 'Discovered') AS was, state, n, holders, buyers, expires_us FROM e WHERE coalesce(p, 'Discovered') <> state"))
def w19_lifecycle(spark, sf_dir):
    return W.lifecycle(ev_trades(spark, sf_dir), lifecycle_marks(spark, sf_dir))


@query(with_views("ev", sql=_STATES + " SELECT mint, us, seq, state, expires_us, next_us FROM e WHERE next_us IS NULL OR next_us > expires_us"))
def w20_expiries(spark, sf_dir):
    x = W.lifecycle_states(ev_trades(spark, sf_dir), lifecycle_marks(spark, sf_dir))
    return W.expiries(x, W.ttl_seconds(F.col("state")), "state")


@query(with_views("ev", sql="""
    h AS (SELECT mint, us // 86400000000 AS horizon, sum(quote) AS v FROM ev GROUP BY 1, 2),
    p AS (SELECT a.mint, a.horizon, max(b.v) AS peak, arg_max(b.horizon, (b.v, -b.horizon)) AS peak_horizon FROM h AS a JOIN h AS b ON a.mint = b.mint AND b.horizon >= a.horizon GROUP BY 1, 2)
    SELECT *, peak_horizon - horizon AS time_to_peak FROM p"""))
def w21_j2_horizon_peaks(spark, sf_dir):
    rows = ev_trades(spark, sf_dir).groupBy("mint", F.expr("us div 86400000000").alias("horizon")).agg(F.sum("quote").alias("v"))
    return W.horizon_peaks(rows, ["mint"], "v")


@query(with_views("ev", sql="r AS (SELECT mint, us, seq, row_number() OVER (PARTITION BY mint ORDER BY us, seq) AS k FROM ev) SELECT mint, us, seq FROM r WHERE k = 1"))
def w22_first_per_mint(spark, sf_dir):
    return W.first_per_key(ev_trades(spark, sf_dir), ["mint"], ["us", "seq"]).select("mint", "us", "seq")


@query(with_views("ev", sql="SELECT mint, seq, max(price) OVER o AS best, min(price) OVER o AS worst FROM ev WINDOW o AS (PARTITION BY mint ORDER BY us, seq ROWS UNBOUNDED PRECEDING)"))
def w23_excursions(spark, sf_dir):
    return W.excursions(ev_trades(spark, sf_dir), ["mint"], "price").select("mint", "seq", "best", "worst")
