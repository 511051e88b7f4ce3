"""Survival of large sells, tentative sells and the defence against them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..adapters import ev_trades, table, with_views
from ..operators import defence as D
from ..operators import joins as J
from ..operators import ledger as L
from ..operators import windows as W
from ..plans import families as P
from ..plans.features import snapshot
from ..plans import survival as S
from ..sources.shared import cut, spread
from . import query
from .relational import _LEDGER
from .results import RESULTS

#: A launch is what happens to one mint in a stretch of six days, so that launches have from one to two dozen trades.
STRETCH = 518_400_000_000
_TK = f"tk AS (SELECT * REPLACE (mint * 1000 + us // {STRETCH} % 1000 AS mint) FROM ev)"


def launch_trades(spark, sf_dir):
    return ev_trades(spark, sf_dir).withColumn("mint", F.expr(f"mint * 1000 + us div {STRETCH} % 1000"))


#: Seconds that stand for 5 s, 30 s and 1 min: the events lie days apart.
SHORT, LONG, MINUTE = 43_200, 172_800, 432_000
LARGE = 30.0


@query(with_views("ev", sql=f"""{_TK},
    x AS (SELECT *, sum((side = 'sell' AND quote >= {LARGE})::INT) OVER (PARTITION BY mint ORDER BY us, seq) AS episode FROM tk),
    o AS (SELECT mint, episode, us AS o_us, seq AS o_seq, price AS floor FROM x WHERE side = 'sell' AND quote >= {LARGE}),
    y AS (SELECT x.*, o_us, o_seq, floor FROM x JOIN o USING (mint, episode)),
    b AS (SELECT mint, episode, min((us, seq)) AS back FROM y WHERE side = 'buy' AND price >= floor GROUP BY 1, 2),
    z AS (SELECT y.*, back FROM y LEFT JOIN b USING (mint, episode) WHERE back IS NULL OR (us, seq) <= back)
    SELECT mint, episode, any_value(o_us) AS us, any_value(floor) AS price, count(*) FILTER (side = 'buy') AS buys, coalesce(sum(quote) FILTER (side = 'buy'), 0) AS volume,
        count(DISTINCT wallet) FILTER (side = 'buy') AS buyers, any_value(back[1]) - any_value(o_us) AS recovery_us, max(us) AS end_us
    FROM z GROUP BY 1, 2"""))
def sell_episodes(spark, sf_dir):
    return S.sell_episodes(launch_trades(spark, sf_dir), LARGE)


def launch_context(spark, sf_dir):
    """The launches' trades, anchors and holders; F5 and F6 of them; holders then and now; what the first buyer sold.

    Trades are written once and dealt out by mint, over as many tasks as their number needs: all that is known of a mint comes of these tasks.
    """
    t = cut(launch_trades(spark, sf_dir), "launches")
    t = spread(t, t.count(), "mint")
    anchors = t.groupBy("mint").agg((F.max("us") + 10_000_000).alias("observed_us"))
    signed = F.when(F.col("side") == "buy", F.col("tokens")).otherwise(-F.col("tokens"))
    past = F.col("us") <= F.col("observed_us") - MINUTE * 1_000_000
    held = t.join(anchors, "mint").groupBy("mint", "wallet").agg(F.sum(signed).alias("balance"), F.coalesce(F.sum(F.when(past, signed)), F.lit(0.0)).alias("before"))
    counts = held.groupBy("mint").agg(F.count_if(F.col("balance") > 0).alias("holders"), F.count_if(F.col("before") > 0).alias("holders_1m"))
    counts = counts.select("mint", "holders_1m", ((F.col("holders") - F.col("holders_1m")) / F.greatest("holders_1m", F.lit(1))).alias("holder_growth_rate"))
    price = P.price_columns(t, anchors.select("*", F.lit(None).cast("long").alias("launch_us"), F.lit(None).cast("double").alias("launch_price")), {"30s": LONG, "1m": MINUTE, "5m": 3 * MINUTE})
    none = t.select("mint", F.lit(0.0).alias("top5_share"), F.lit(0.0).alias("dev_sold")).where("false")
    flow = P.flow_columns(t, none)
    dev = t.where("side = 'buy'").groupBy("mint").agg(F.min("wallet").alias("wallet"))
    own = t.join(dev, ["mint", "wallet"]).groupBy("mint").agg(F.min(F.when(F.col("side") == "sell", F.col("us"))).alias("creator_first_sell_us"), F.coalesce(F.sum(F.when(F.col("side") == "sell", F.col("tokens"))), F.lit(0.0)).alias("s"), F.sum(F.when(F.col("side") == "buy", F.col("tokens"))).alias("b"))
    own = own.select("mint", "creator_first_sell_us", F.least(F.col("s") / F.col("b"), F.lit(1.0)).alias("creator_sell_percentage"))
    return t, anchors, held.select("mint", "wallet", "balance"), price, flow, counts, own


def survival(t, anchors, held, price, flow, counts, own):
    context = J.side_by_side([price.select("mint", "return_pct_30s"), flow.select("mint", "organic_flow_score"), counts, own], "mint")
    return S.survival_columns(t, anchors, held, context, LARGE, SHORT, LONG)


_SURVIVAL = f"""{_TK},
    o AS (SELECT mint, max(us) + 10000000 AS ob FROM tk GROUP BY mint), e AS (SELECT tk.*, ob FROM tk JOIN o USING (mint)),
    w AS (SELECT mint, wallet, sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) AS bal, coalesce(sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) FILTER (us <= ob - {MINUTE}000000), 0) AS old FROM e GROUP BY 1, 2),
    h AS (SELECT mint, count(*) FILTER (bal > 0) AS hn, count(*) FILTER (old > 0) AS ho FROM w GROUP BY 1),
    rk AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY bal DESC, wallet) AS r, sum(bal) OVER (PARTITION BY mint) AS sup FROM w WHERE bal > 0),
    sh AS (SELECT mint, sum(bal) FILTER (r = 1) / any_value(sup) AS top1, sum(bal) FILTER (r <= 3) / any_value(sup) AS top3, sum(bal) FILTER (r <= 5) / any_value(sup) AS top5 FROM rk GROUP BY 1),
    ls AS (SELECT mint, min(us) AS hus, arg_min(price, (us, seq)) AS hp, count(*) AS ln, sum(quote) AS lq FROM e WHERE side = 'sell' AND quote >= {LARGE} GROUP BY 1),
    fb AS (SELECT DISTINCT mint, wallet FROM (SELECT mint, wallet, row_number() OVER (PARTITION BY mint ORDER BY us, seq) AS k FROM e WHERE side = 'buy') WHERE k <= 8),
    rt AS (SELECT mint, arg_max(price, (us, seq)) AS last, max(price) AS ath, arg_min(price, (us, seq)) FILTER (us >= ob - {LONG}000000) AS p0, arg_min(price, (us, seq)) AS fp, min(us) AS lu, max(us) FILTER (side = 'buy') AS lbu, any_value(ob) AS ob FROM e GROUP BY 1),
    af AS (SELECT e.mint, count(*) AS ab, count(DISTINCT wallet) AS au, sum(quote) AS aq, min(us) FILTER (price >= hp) AS bus, arg_min(price, (us, seq)) FILTER (price >= hp) AS bp FROM e JOIN ls USING (mint) WHERE side = 'buy' AND us > hus GROUP BY 1),
    g AS (SELECT mint, count(*) AS n, count(*) FILTER (side = 'buy') AS b, coalesce(sum(quote) FILTER (side = 'buy'), 0) AS bv, coalesce(sum(quote) FILTER (side = 'sell'), 0) AS sv, coalesce(max(quote) FILTER (side = 'buy'), 0) AS lb, count(DISTINCT wallet) FILTER (side = 'buy') AS ub,
        count(*) FILTER (side = 'buy' AND quote >= {LARGE}) AS nlb, count(DISTINCT wallet) FILTER (side = 'buy' AND us >= ob - {LONG}000000) AS u30, count(DISTINCT wallet) FILTER (side = 'buy' AND us >= ob - {SHORT}000000) AS u5 FROM e GROUP BY 1),
    ts AS (SELECT e.mint, count(*) AS top_sells FROM e JOIN rk ON rk.mint = e.mint AND rk.wallet = e.wallet AND r <= 5 WHERE side = 'sell' GROUP BY 1), es AS (SELECT e.mint, count(*) AS early_sells FROM e JOIN fb USING (mint, wallet) WHERE side = 'sell' GROUP BY 1),
    dv AS (SELECT mint, min(wallet) AS dw FROM e WHERE side = 'buy' GROUP BY 1), ds AS (SELECT e.mint, min(us) FILTER (side = 'sell') AS fs, least(1, coalesce(sum(tokens) FILTER (side = 'sell'), 0) / sum(tokens) FILTER (side = 'buy')) AS sp FROM e JOIN dv ON dv.mint = e.mint AND dw = wallet GROUP BY 1),
    a AS (SELECT g.*, hn, ho, p0, fp, lu, lbu, ob, top1, coalesce(top3, 0) AS top3, coalesce(top5, 0) AS top5, hus, hp, ln, lq, last, ath, ab, au, aq, bus, bp, coalesce(CASE WHEN p0 > 0 THEN last / p0 - 1 END, 0) AS ret, (hn - ho) / greatest(ho, 1) AS gr, CASE WHEN b > 0 THEN ub / b ELSE 0 END AS org, coalesce(top_sells, 0) AS tsl, coalesce(early_sells, 0) AS esl, fs, coalesce(sp, 0) AS sp, CASE WHEN bv > 0 THEN lb / bv ELSE 0 END AS part
        FROM g JOIN h USING (mint) LEFT JOIN sh USING (mint) LEFT JOIN ls USING (mint) JOIN rt USING (mint) LEFT JOIN af USING (mint) LEFT JOIN ts USING (mint) LEFT JOIN es USING (mint) LEFT JOIN ds USING (mint)),
    f AS (SELECT *, ret > 0 AND ub <= 2 AND b >= 2 AS breadth, ret > 0 AND tsl > 0 AS tops, ret > 0 AND esl > 0 AS earlies, ret > 0 AND nlb BETWEEN 1 AND 2 AND part >= 0.55 AND ub <= 2 AS oneortwo, CASE WHEN hus IS NULL THEN 0 ELSE least(1, coalesce(au, 0) / 5) END AS absb FROM a),
    s AS (SELECT *, least(1, greatest(0, 0.35 * org + 0.25 * greatest(gr, 0) + 0.15 * least(1, ub / 6) + 0.25 * (1 - (0.35 * breadth::INT + 0.35 * oneortwo::INT + 0.15 * tops::INT + 0.15 * earlies::INT)) - sp)) AS auth FROM f)"""


_F14 = """coalesce(ln, 0) AS large_sell_count, coalesce(lq, 0) AS large_sell_total_quote, CASE WHEN ath > 0 AND hus IS NOT NULL THEN least(1, abs(hp - last) / ath) END AS price_impact_of_large_sells, (bus - hus) // 1000 AS recovery_after_large_sell_ms, CASE WHEN hp > 0 AND bus IS NOT NULL THEN least(1, (bp - hp) / hp) END AS recovery_after_large_sell_pct,
        CASE WHEN hus IS NOT NULL THEN coalesce(ab, 0) END AS buyers_after_large_sell_count, CASE WHEN hus IS NOT NULL THEN coalesce(au, 0) END AS unique_buyers_after_large_sell, CASE WHEN hus IS NOT NULL THEN coalesce(aq, 0) END AS buy_volume_after_large_sell, CASE WHEN hus IS NOT NULL THEN hn END AS holder_count_after_large_sell,
        absb AS absorption_success_score, 1 - absb AS absorption_failure_score, greatest(coalesce(ln, 0) - 1, 0) AS repeated_absorption_count, least(1, top3 * 2 / 3) AS distribution_into_buyers_score, abs(ret) <= 0.05 AND bv + sv >= 10 AND tsl > 0 AS price_flat_volume_high_distribution_warning,
        ret >= 0.5 AND gr <= 0 AND ub <= 2 AND hn <= 2 AS vertical_move_without_holder_growth, ret >= 0.5 AND ub <= 2 AS vertical_move_without_unique_buyers, tops AS price_up_top_holders_selling, earlies AS price_up_bundle_selling, ret > 0 AND fs IS NOT NULL AS price_up_dev_selling, ret > 0 AND u5 < u30 AS price_up_unique_buyers_down,
        ret > 0 AND hn < ho AS price_up_holder_count_down, part >= 0.6 AS price_up_buy_size_concentration_high, oneortwo AS price_up_only_one_or_two_large_buys, breadth AS price_up_no_retail_breadth, auth AS momentum_authenticity_score, least(1, tops::INT + earlies::INT + oneortwo::INT) / 3 AS exit_liquidity_trap_score,
        fs IS NULL AND ret >= 0 AS dev_not_selling_while_price_up, least(1, auth + absb + 1 - top5 + CASE WHEN ret >= 0 THEN 0.2 ELSE 0 END) / 3 AS organic_survival_score, least(n, 20) / 20 AS anti_rug_confidence_score"""


@query(with_views("ev", sql=_SURVIVAL + f" SELECT mint, {_F14} FROM s"))
def f14_survival_columns(spark, sf_dir):
    return survival(*launch_context(spark, sf_dir))


#: Microseconds of a slot, and of the wait for a resolution.
SLOT, WAIT = 43_200_000_000, 172_800_000_000


def few_wallets(spark, sf_dir):
    """The launches' trades by twelve wallets, so that sellers come again; written, since all that is known of a sell comes of them."""
    return cut(launch_trades(spark, sf_dir).withColumn("wallet", F.col("wallet") % 12), "trades")


def threats(t):
    """T5's index of the launches' holders, with the names that sellers have there; who bought in the first slot belongs to the bundle."""
    ledger = cut(L.positions(t), "ledger")
    held = ledger.where("held > 0").select("mint", "wallet", F.col("held").alias("balance"))
    creators = t.where("side = 'buy'").groupBy("mint").agg(F.min("wallet").alias("wallet"))
    x = L.exit_threats(held, ledger, t.groupBy("mint").agg(F.sum("quote").alias("depth")), creators).join(held, ["mint", "wallet"])
    first = t.where("side = 'buy'").groupBy("mint", "wallet").agg(F.min("us").alias("first_us")).join(t.groupBy("mint").agg(F.min("us").alias("launch_us")), "mint").where(f"first_us <= launch_us + {SLOT}").select("mint", "wallet", F.lit(True).alias("early"))
    place = F.when(F.col("place") == 1, "top1holder").when(F.col("place") <= 3, "top3holder").when(F.col("place") <= 5, "top5holder").otherwise("top10holder")
    kind = F.when(F.col("class") == "creator", "dev").when(F.col("early"), "bundlewallet").when(F.col("class") == "free_roller", "freerollingholder").when(F.col("class") == "whale", "whale").otherwise(place)
    return x.join(first, ["mint", "wallet"], "left").select("mint", F.col("wallet").alias("seller"), kind.alias("threat_class"), F.col("share").alias("holding_pct"), "balance", F.col("impact_100").alias("full_exit_impact_pct"), F.col("place").alias("top_rank"))


def tentative_sells(t, index):
    """The sells of t as they are seen before they are confirmed, with what is known of seller, token and our position; written, since copies are looked for among them."""
    order = Window.partitionBy("mint").orderBy("us", "seq")
    e = t.withColumn("before", F.lag("price").over(order)).where("side = 'sell'")
    held = t.groupBy("mint", "wallet").agg(F.sum(F.when(F.col("side") == "buy", F.col("tokens")).otherwise(-F.col("tokens"))).alias("balance"))
    absorbed = S.absorption_success(t, LARGE).select("mint", F.col("absorption_success_score").alias("absorption"))
    sticky = W.retention(t, held, 10).select("mint", F.col("retention").alias("stickiness"))
    token = t.groupBy("mint").agg(F.sum("quote").alias("depth"), F.avg("quote").alias("q"), F.avg("tokens").alias("n"), F.min(F.when(F.col("side") == "buy", F.col("wallet"))).alias("creator"))
    ours = F.col("mint") % 3 != 2
    token = token.select("mint", "depth", "creator", F.when(ours, F.col("q")).alias("size_quote"), F.when(ours, F.col("n")).alias("size_tokens"))
    x = e.select(
        F.col("seq").alias("id"), "mint", F.col("wallet").alias("seller"), F.expr(f"us div {SLOT}").alias("slot"), "us", F.expr(f"case when seq % 4 = 0 then concat('s', mint, '.', us div {SLOT}) end").alias("signature"), F.expr("elt(seq % 5 + 1, 'deshredpreexecution', 'rawshred', 'fixturetentative', 'mockearlyintent', 'replaytentative')").alias("source"),
        F.col("tokens").alias("token_in"), F.col("quote").alias("quote_out"), F.col("before").alias("price_before"), F.when(F.col("before").isNotNull(), F.col("price")).alias("price_after"), F.coalesce("before", "price").alias("latest_price"), (F.lit(0.6) + F.col("seq") % 40 / 100).alias("decode_confidence"), (F.col("seq") % 7 == 0).alias("partial"), (F.col("seq") % 450).alias("latency_ms"),
    ).join(index, ["mint", "seller"], "left").join(J.side_by_side([token, D.threat_index(index), absorbed, sticky], "mint"), "mint")
    return cut(x.withColumns({"is_creator": F.coalesce(F.col("seller") == F.col("creator"), F.lit(False)), "is_top_holder": F.coalesce(F.col("top_rank") <= 3, F.lit(False)), "growth": F.lit(0.0)}).drop("creator", "max_impact_pct"), "tentative")


def detected(spark, sf_dir):
    """The launches' trades, the index of their holders, and T6 of their sells: each made once."""
    t = few_wallets(spark, sf_dir)
    index = cut(threats(t), "threats")
    return t, index, D.detect(tentative_sells(t, index))


_SELLS = f"""{_TK}, tw AS (SELECT * REPLACE (wallet % 12 AS wallet) FROM tk), {_LEDGER.replace("FROM ev)", "FROM tw)")},
    dp AS (SELECT mint, sum(quote) AS depth, avg(quote) AS q, avg(tokens) AS n, min(wallet) FILTER (side = 'buy') AS creator, min(us) AS launch_us FROM tw GROUP BY 1),
    k AS (SELECT mint, wallet, held AS balance, realised, cost, sold, held / sum(held) OVER (PARTITION BY mint) AS share, row_number() OVER (PARTITION BY mint ORDER BY held DESC, wallet) AS place FROM p WHERE held > 0),
    fb AS (SELECT mint, wallet, min(us) AS us, arg_min(seq, (us, seq)) AS seq FROM tw WHERE side = 'buy' GROUP BY 1, 2),
    ix AS (SELECT k.mint, k.wallet, k.balance, share, place, least(1, greatest(0, share * 70 + balance / depth * 15)) * 100 AS full_pct,
        CASE WHEN k.wallet = creator THEN 'dev' WHEN fb.us <= launch_us + {SLOT} THEN 'bundlewallet' WHEN realised >= cost AND sold > 0 THEN 'freerollingholder' WHEN share >= 0.1 THEN 'whale' WHEN place = 1 THEN 'top1holder' WHEN place <= 3 THEN 'top3holder' WHEN place <= 5 THEN 'top5holder' ELSE 'top10holder' END AS class
        FROM k JOIN dp USING (mint) LEFT JOIN fb ON fb.mint = k.mint AND fb.wallet = k.wallet WHERE place <= 10),
    ti AS (SELECT mint, max(full_pct) AS worst, CASE WHEN max(full_pct) >= 25 THEN 120 ELSE 350 END AS lead FROM ix GROUP BY 1),
    ls AS (SELECT mint, min(us) AS hus FROM tw WHERE side = 'sell' AND quote >= {LARGE} GROUP BY 1), ab AS (SELECT mint, least(1, count(DISTINCT wallet) / 5) AS absorption FROM tw JOIN ls USING (mint) WHERE side = 'buy' AND us > hus GROUP BY 1),
    rf AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY us, seq) AS r FROM fb), bl AS (SELECT mint, wallet, sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) AS b FROM tw GROUP BY 1, 2),
    st AS (SELECT rf.mint, avg((b > 0)::INT) AS sticky FROM rf JOIN bl USING (mint, wallet) WHERE r <= 10 GROUP BY 1),
    e AS (SELECT *, lag(price) OVER (PARTITION BY mint ORDER BY us, seq) AS pb FROM tw),
    s AS (SELECT seq AS id, e.mint, e.wallet AS seller, us // {SLOT} AS slot, us, CASE WHEN seq % 4 = 0 THEN 's' || e.mint || '.' || us // {SLOT} END AS signature, list_extract(['deshredpreexecution', 'rawshred', 'fixturetentative', 'mockearlyintent', 'replaytentative'], (seq % 5 + 1)::INT) AS source, tokens, quote, pb, CASE WHEN pb IS NOT NULL THEN price END AS pa, coalesce(pb, price) AS lp,
            greatest(0, 0.6 + seq % 40 / 100 - CASE WHEN seq % 7 = 0 THEN 0.25 ELSE 0 END) AS dc, seq % 450 AS lat, depth, CASE WHEN e.mint % 3 <> 2 THEN q END AS size_quote, CASE WHEN e.mint % 3 <> 2 THEN n END AS size_tokens, e.wallet = creator IS TRUE AS is_creator, coalesce(place <= 3, false) AS is_top, class, ix.balance, share, full_pct, place, coalesce(lead, 0) AS lead, coalesce(absorption, 0) AS absorption, coalesce(sticky, 0) AS sticky
        FROM e JOIN dp ON dp.mint = e.mint LEFT JOIN ix ON ix.mint = e.mint AND ix.wallet = e.wallet LEFT JOIN ti ON ti.mint = e.mint LEFT JOIN ab ON ab.mint = e.mint LEFT JOIN st ON st.mint = e.mint WHERE side = 'sell'),
    du AS (SELECT b.id, arg_min(a.id, (a.slot, a.id)) AS original FROM s AS b JOIN s AS a ON a.mint = b.mint AND a.slot = b.slot AND a.id < b.id AND (a.signature = b.signature OR (a.signature IS NULL OR b.signature IS NULL) AND a.seller = b.seller AND abs(a.tokens - b.tokens) <= 0.05 * greatest(a.tokens, b.tokens, 1)) GROUP BY 1),
    i AS (SELECT s.*, original, coalesce(class, CASE WHEN is_creator THEN 'dev' WHEN is_top THEN 'top3holder' ELSE 'unknown' END) AS kind, CASE WHEN is_creator THEN 0.92 WHEN is_top OR place IS NOT NULL THEN 0.85 WHEN tokens > 0 AND quote > 0 THEN 0.6 ELSE 0.55 END AS ac,
            greatest(coalesce(CASE WHEN pb > 0 THEN abs((pa - pb) / pb) * 100 END, 0), CASE WHEN class IS NULL THEN least(1, greatest(quote, tokens * lp) / greatest(depth, 1)) * 100 ELSE full_pct * least(1, tokens / s.balance) END) AS own FROM s LEFT JOIN du USING (id)),
    j AS (SELECT *, coalesce(list(own) FILTER (original IS NULL) OVER (PARTITION BY mint, slot ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS earlier FROM i),
    m AS (SELECT *, len(earlier) AS nb, least(100, own + list_reduce(list_prepend(0.0::DOUBLE, earlier), lambda a, x: a + least(100, x + a))) AS eff, least(dc, ac) AS conf, lat / greatest(lead, 1) AS ratio, kind IN ('dev', 'devcluster', 'top1holder', 'top3holder', 'bundlewallet', 'bundlecluster', 'samefundercluster') AS grave,
            least(1, absorption + sticky / 3) AS prob, CASE WHEN kind = 'dev' THEN 5 WHEN kind LIKE 'top%' THEN 10 WHEN kind LIKE 'bundle%' THEN 12 WHEN kind = 'whale' THEN 15 ELSE 8 END AS least_pct FROM j),
    u AS (SELECT *, ratio >= 1.1 AS lands, coalesce(size_quote, 0) * eff / 100 * least(1, ratio) * eff / 100 * CASE WHEN grave THEN 1 ELSE least(1, greatest(0.1, 1 - absorption)) END AS saved, coalesce(size_quote, 0) * 0.25 + CASE WHEN NOT grave AND absorption >= 0.75 THEN coalesce(size_quote, 0) * absorption * 0.2 ELSE 0 END AS lost,
            CASE WHEN conf < 0.55 THEN 0 WHEN conf >= 0.82 AND eff >= greatest(25, least_pct) THEN 4 WHEN conf >= 0.7 AND eff >= greatest(15, least_pct) THEN 2 WHEN eff >= least(8, least_pct) THEN 1 ELSE 0 END AS asked FROM m),
    v AS (SELECT *, saved >= 0.02 AND saved - lost >= 0.01 AS pays FROM u),
    d AS (SELECT *, CASE WHEN asked >= 3 AND (NOT grave AND (absorption >= 0.75 OR NOT lands) OR size_quote IS NOT NULL AND NOT pays) THEN 2 ELSE asked END AS lev FROM v),
    t6 AS (SELECT id, mint, seller, slot, us, signature, source, original, tokens AS token_in, quote AS quote_out, kind AS seller_class, dc AS decoded_confidence, ac AS account_confidence, conf AS confidence, coalesce(balance, tokens) AS seller_balance, coalesce(share, 0) AS seller_holding_pct, own AS own_impact_pct, eff AS impact_pct, nb AS slot_before, lp AS price_before, coalesce(pa, lp * greatest(0, 1 - eff / 100)) AS price_after,
        ratio AS latency_edge_ratio, lands AS can_land, lat AS latency_advantage_ms, greatest(lead, 1) AS required_latency_ms, absorption AS absorption_health_score, prob AS post_sell_absorption_probability, saved AS expected_saved_loss, lost AS expected_opportunity_cost, saved - lost AS net_benefit, least(1, conf * least(1, ratio) * (1 - prob / 2)) AS net_benefit_confidence,
        CASE WHEN original IS NULL THEN lev END AS level, CASE WHEN original IS NULL THEN ['info', 'watch', 'exit_armed', 'emergency_exit_recommended', 'emergency_exit_required'][lev + 1] END AS risk_level,
        CASE WHEN original IS NULL THEN concat_ws('|', CASE WHEN source = 'deshredpreexecution' THEN 'deshred_pre_execution_sell_warning' ELSE 'early_intent_sell_warning' END, CASE WHEN kind = 'dev' THEN 'shred_dev_sell_warning' WHEN kind LIKE 'top%' THEN 'shred_top_holder_sell_warning' WHEN kind LIKE 'bundle%' THEN 'shred_bundle_exit_warning' WHEN kind = 'whale' THEN 'shred_whale_dump_warning' END,
            CASE WHEN lev >= 2 THEN 'shred_exit_armed' END, CASE WHEN dc < 0.55 THEN 'shred_low_confidence' END, CASE WHEN nb > 0 THEN 'shred_same_slot_sell_cluster' END, CASE WHEN NOT lands THEN 'shred_signal_stale' END) END AS reasons,
        CASE WHEN original IS NULL THEN size_quote IS NOT NULL AND lev >= 2 END AS armed, CASE WHEN original IS NULL THEN size_quote IS NOT NULL AND conf >= 0.82 AND eff >= 25 AND pays AND lev >= 3 END AS triggered, CASE WHEN original IS NULL THEN us + 5000000 END AS expires_us, size_quote, size_tokens FROM d)"""


@query(with_views("ev", sql=_SELLS + " SELECT * FROM t6").replace("WITH", "WITH RECURSIVE", 1))
def t6_tentative_sells(spark, sf_dir):
    return detected(spark, sf_dir)[2]


def confirmations(spark, sf_dir):
    """What else happens to a launch's wallets: views are sells that were executed or failed, clicks balances that fell, signups take back, root or contradict."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click', 'signup')")
    k = F.get_json_object("props", "$.k").cast("long")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    x = e.select((F.col("user_id") * 1000 + F.expr(f"unix_micros(cast(ts as timestamp)) div {STRETCH} % 1000")).alias("mint"), (k % 12).alias("seller"), us.alias("us"), "event_type", "event_id", (F.col("value") / (10 + k)).alias("price_after"))
    kind = F.when(F.col("event_type") == "view", F.when(F.col("event_id") % 6 == 0, "failed").otherwise("executed")).when(F.col("event_type") == "click", "balance").otherwise(F.expr("elt(event_id % 3 + 1, 'reverted', 'rooted', 'mismatch')"))
    return x.select("mint", "seller", "us", kind.alias("kind"), "price_after")


def resolutions(spark, sf_dir, t, found):
    return D.resolve(found, confirmations(spark, sf_dir), t.select("mint", "us", "price"), WAIT)


_RESOLVED = _SELLS + f""",
    cf AS (SELECT user_id * 1000 + epoch_us(ts) // {STRETCH} % 1000 AS mint, CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS seller, epoch_us(ts) AS us, value / (10 + CAST(json_extract_string(props, '$.k') AS BIGINT)) AS pa,
        CASE event_type WHEN 'view' THEN CASE WHEN event_id % 6 = 0 THEN 2 ELSE 1 END WHEN 'click' THEN 3 ELSE [0, 4, 5][(event_id % 3 + 1)::INT] END AS o FROM events WHERE event_type IN ('view', 'click', 'signup')),
    mt AS (SELECT t6.id, min((cf.us, cf.o, cf.pa)) AS x FROM t6 JOIN cf ON cf.mint = t6.mint AND cf.seller = t6.seller AND cf.us > t6.us AND cf.us <= t6.us + {WAIT} WHERE original IS NULL GROUP BY 1),
    rz AS (SELECT t6.id, t6.mint, coalesce(x[1], t6.us + {WAIT}) AS us, (coalesce(x[1], t6.us + {WAIT}) - t6.us) // 1000 AS latency_ms, ['reorged', 'confirmed_executed', 'confirmed_failed', 'account_effects_observed', 'rooted_executed', 'decode_mismatch', 'not_seen_within_ttl'][coalesce(x[2], 6) + 1] AS outcome, price_before, triggered, size_tokens, x[3] AS pa FROM t6 LEFT JOIN mt USING (id) WHERE original IS NULL),
    tl AS (SELECT mint, us, max(price) AS p FROM tw GROUP BY 1, 2),
    res AS (SELECT rz.id, rz.mint, rz.us, outcome, outcome IN ('reorged', 'confirmed_failed', 'decode_mismatch', 'not_seen_within_ttl') AS false_positive, latency_ms,
        CASE WHEN triggered AND outcome IN ('confirmed_executed', 'confirmed_failed') AND price_before > pa THEN (price_before - pa) * size_tokens WHEN triggered AND outcome = 'not_seen_within_ttl' AND tl.p > price_before THEN (price_before - tl.p) * size_tokens ELSE 0 END AS saved FROM rz ASOF LEFT JOIN tl ON tl.mint = rz.mint AND rz.us >= tl.us)"""


@query(with_views("ev", sql=_RESOLVED + " SELECT * FROM res").replace("WITH", "WITH RECURSIVE", 1))
def t7_sell_resolutions(spark, sf_dir):
    t, _, found = detected(spark, sf_dir)
    return resolutions(spark, sf_dir, t, cut(found, "sells"))


_OF = lambda *kinds: f"count(*) FILTER (step = 0 AND level IS NOT NULL AND seller_class IN ({', '.join(repr(k) for k in kinds)})) OVER w"
_LAST = lambda cond, v: f"last_value(CASE WHEN {cond} THEN {v} END IGNORE NULLS) OVER w"


@query(with_views("ev", sql=_RESOLVED + f""",
    x AS (SELECT mint, us, 0 AS step, id, seller_class, quote_out, impact_pct, decoded_confidence, confidence, level, reasons, armed, triggered, can_land, expected_saved_loss, NULL::VARCHAR AS outcome, NULL::BOOLEAN AS false_positive, NULL::DOUBLE AS saved, NULL::BIGINT AS latency_ms FROM t6
        UNION ALL SELECT mint, us, 1, id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, outcome, false_positive, saved, latency_ms FROM res),
    y AS (SELECT mint, us, step, id, count(*) FILTER (step = 0) OVER w AS n, coalesce(sum(quote_out) OVER w, 0) AS vol, {_OF('dev', 'devcluster')} AS dev, {_OF('top1holder', 'top3holder', 'top5holder', 'top10holder')} AS top, {_OF('bundlewallet', 'bundlecluster')} AS bun, {_OF('whale')} AS wha, count(*) FILTER (reasons LIKE '%same_slot%') OVER w AS clu, coalesce(max(impact_pct) OVER w, 0) AS imx, coalesce(sum(impact_pct) OVER w, 0) AS ism,
            coalesce(max(decoded_confidence) OVER w, 0) AS cmx, coalesce(avg(decoded_confidence) OVER w, 0) AS cmn, coalesce({_LAST('level IS NOT NULL', 'level')}, 0) AS lev, coalesce({_LAST('step = 1 OR armed', 'step = 0')}, false) AS arm, coalesce(bool_or(triggered) OVER w, false) AS trg, {_LAST("outcome = 'confirmed_executed'", 'latency_ms')} AS l1, {_LAST("outcome = 'account_effects_observed'", 'latency_ms')} AS l2, {_LAST("outcome = 'rooted_executed'", 'latency_ms')} AS l3,
            count(*) FILTER (false_positive) OVER w AS fp, coalesce({_LAST('triggered', 'expected_saved_loss')}, 0) AS est, coalesce(sum(saved) FILTER (outcome = 'confirmed_executed') OVER w, 0) AS rea, coalesce(sum(abs(saved)) FILTER (false_positive) OVER w, 0) AS opp, coalesce({_LAST('level IS NOT NULL', 'NOT can_land')}, false) AS sta, coalesce({_LAST('level IS NOT NULL', 'least(1, impact_pct / 100 + confidence / 2)')}, 0) AS mal,
            {_LAST('step = 0', 'level IS NOT NULL')} AS was_warning, {_LAST('level IS NOT NULL', 'confidence')} AS wconf, max(CASE WHEN step = 0 THEN decoded_confidence END) OVER w AS run FROM x WINDOW w AS (PARTITION BY mint ORDER BY us, step, id ROWS UNBOUNDED PRECEDING))
    SELECT y.mint, us, step, id, n AS tentative_sell_count_window, vol AS tentative_sell_volume_quote_window, dev AS tentative_sell_from_dev_count, top AS tentative_sell_from_top_holder_count, bun AS tentative_sell_from_bundle_count, wha AS tentative_sell_from_whale_count, clu AS tentative_sell_same_slot_cluster_count, imx AS tentative_sell_impact_max_pct, ism AS tentative_sell_impact_sum_pct,
        cmx AS tentative_sell_confidence_max, cmn AS tentative_sell_confidence_mean, lev AS shred_sell_warning_level, arm AS shred_exit_armed_flag, trg AS shred_emergency_exit_triggered_flag, coalesce(l1, 0) AS shred_to_geyser_processed_ms, coalesce(l2, 0) AS shred_to_account_effect_confirmation_ms, coalesce(l3, 0) AS shred_to_rooted_confirmation_ms, fp / n AS shred_sell_false_positive_rate_wallet, fp / n AS shred_sell_false_positive_rate_source,
        est AS shred_sell_saved_loss_estimate, rea AS shred_sell_saved_loss_realized, opp AS shred_exit_opportunity_cost, sta AS shred_signal_stale_flag, coalesce(lead, 0) AS shred_exit_latency_budget_ms, coalesce(l1, l2, l3, 0) AS shred_exit_latency_used_ms, greatest(0, est + rea - opp) AS shred_exit_edge_score, mal AS malicious_sell_intent_score,
        coalesce(CASE WHEN was_warning THEN wconf ELSE run END, 0) AS preconfirmation_exit_confidence, least(1, coalesce(worst, 0) / 100) AS dangerous_seller_precomputed_impact_score, least(1, coalesce(worst, 0) / 100) AS exit_threat_index_score FROM y LEFT JOIN ti ON ti.mint = y.mint""").replace("WITH", "WITH RECURSIVE", 1))
def f21_defence_columns(spark, sf_dir):
    t, index, found = detected(spark, sf_dir)
    found = cut(found, "sells")
    return D.defence_columns(found, resolutions(spark, sf_dir, t, found), D.threat_index(index))


_THERE = " + ".join(f"({x.rsplit(' ', 1)[0]} IS NOT NULL)::INT" for x in RESULTS["f14_survival_columns"].split(", ")[1:])


@query(with_views("ev", sql=_SURVIVAL + f", t AS (SELECT mint, {_F14} FROM s) SELECT mint, {_THERE} AS available, 35 - ({_THERE}) AS unavailable FROM t"))
def f22_availability(spark, sf_dir):
    """What a snapshot of F14's columns and the six placeholder groups has and lacks."""
    return snapshot(f14_survival_columns(spark, sf_dir)).select("mint", "available", "unavailable")
