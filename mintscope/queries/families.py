"""Feature families at full width."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ev_trades, table, with_views
from ..plans import families as P
from . import query
from .relational import _LEDGER

#: Launches made of parts, by expressions that both engines read.
_LAUNCH = {
    "mint": "p_partkey", "launch_slot": "CASE WHEN p_partkey % 19 = 3 THEN NULL ELSE p_partkey * 7 END", "quote_mint": "CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE 'q' END", "quote_asset_type": "CASE WHEN p_size % 2 = 0 THEN 'Sol' ELSE 'Usdc' END", "creator_wallet": "CASE WHEN p_partkey % 23 = 2 THEN NULL ELSE p_brand END",
    "payer_wallet": "p_type", "bonding_curve_pubkey": "p_name", "associated_bonding_curve_pubkey": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END", "metadata_pubkey": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END", "token_program_type": "CASE WHEN p_size % 3 = 0 THEN 'Token2022' ELSE 'Spl' END", "create_instruction_variant": "'create'",
    "name": "CASE WHEN p_partkey % 17 = 1 THEN '' WHEN p_partkey % 17 = 2 THEN NULL ELSE p_name END", "symbol": "CASE WHEN p_size % 10 = 3 THEN 'aéè' ELSE p_brand END", "uri": "CASE WHEN p_partkey % 13 = 1 THEN '' ELSE concat(lower(p_type), '://host', p_size, '.example.org/', p_partkey % 50) END", "launch_same_tx_buy_count": "p_size % 4", "launch_same_slot_buy_count": "p_size % 6",
    "first_seen_source": "CASE WHEN p_size % 4 = 1 THEN 'ShredTentative' WHEN p_size % 4 = 2 THEN 'DeshredTentative' ELSE 'Geyser' END", "launch_tx_client_fingerprint": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END", "launch_us": "CASE WHEN p_partkey % 29 = 4 THEN NULL ELSE p_partkey * 40000000 END", "observed_us": "200000 * CAST(40000000 AS BIGINT)",
}
_L = f"l AS (SELECT {', '.join(f'{v} AS {n}' for n, v in _LAUNCH.items())} FROM part)"


def launches(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(*[f"{v} as {n}" for n, v in _LAUNCH.items()])


_T = ("name", "symbol", "uri")
_ascii = lambda c: f"CASE WHEN length({c}) > 0 THEN (length({c}) - length(regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g'))) / length({c}) ELSE 0.0 END"


@query(f"""WITH {_L}, d AS (SELECT *, {', '.join(f'count(*) OVER (PARTITION BY {c}) - 1 AS d_{c}' for c in _T)} FROM l), e AS (SELECT * REPLACE ({', '.join(f"coalesce({c}, '') AS {c}" for c in _T)}) FROM d)
    SELECT mint, launch_slot, quote_mint, creator_wallet, payer_wallet, bonding_curve_pubkey, associated_bonding_curve_pubkey, metadata_pubkey, create_instruction_variant, launch_same_tx_buy_count, launch_same_slot_buy_count, launch_tx_client_fingerprint, greatest(0, (observed_us - launch_us) // 1000) AS time_since_launch_ms,
        lower(quote_asset_type) AS quote_asset_type, lower(token_program_type) AS token_program_type, lower(first_seen_source) AS first_seen_source, {', '.join(f"length({c}) AS {c}_length, {c} = '' AS has_empty_{c}, CASE WHEN {c} = '' THEN 0.0 ELSE len(list_distinct(string_split({c}, ''))) / length({c}) END AS {c}_entropy, CASE WHEN {c} = '' THEN 0 ELSE d_{c} END AS duplicate_{c}_seen_historically" for c in _T)},
        greatest({', '.join(_ascii(c) for c in _T)}) AS suspicious_unicode_score, CASE WHEN uri LIKE '%:%' THEN lower(split_part(uri, ':', 1)) ELSE 'unknown' END AS uri_scheme FROM e""".replace("greatest(0, (observed_us - launch_us) // 1000)", "CASE WHEN launch_us IS NOT NULL THEN greatest(0, (observed_us - launch_us) // 1000) ELSE 0 END"))
def f1_launch_columns(spark, sf_dir):
    return P.launch_identity(launches(spark, sf_dir))


@query("""WITH l AS (SELECT o_orderkey AS mint, o_custkey AS creator, o_orderpriority AS payer, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE 'ipfs://h' || o_orderkey % 1000 || '/a' END AS uri, epoch_us(o_orderdate) AS us FROM orders), o AS (SELECT max(us) AS o FROM l),
    h AS (SELECT *, CASE WHEN uri LIKE '%://%' THEN split_part(split_part(uri, '://', 2), '/', 1) END AS host FROM l, o)
    SELECT mint, (o - min(us) OVER (PARTITION BY creator)) // 1000000 AS creator_age_in_local_index, count(*) OVER (PARTITION BY creator) AS creator_total_launches_seen, count(*) FILTER (us >= o - 15552000000000) OVER (PARTITION BY creator) AS creator_launches_last_1h, NULL::VARCHAR AS creator_cluster_id,
        count(*) OVER (PARTITION BY creator, payer) > 1 AS creator_reuses_same_payer, host IS NOT NULL AND count(*) OVER (PARTITION BY host) > 1 AS creator_reuses_same_metadata_domain, count(*) FILTER (us >= o - 15552000000000) OVER (PARTITION BY creator) >= 3 AS creator_launching_spam_wave_flag FROM h""")
def f2_creator_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mint"), F.col("o_custkey").alias("creator"), F.col("o_orderpriority").alias("payer"), F.expr("if(o_orderkey % 4 = 0, 'x', concat('ipfs://h', o_orderkey % 1000, '/a'))").alias("uri"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("launch_us"))
    end = o.agg(F.max("launch_us").alias("observed_us"))
    return P.creator(o.join(F.broadcast(end)), hour_us=15_552_000_000_000)  # end is one row


_DEV = {
    "mint": "o_orderkey", "launch_us": "CASE WHEN o_orderkey % 31 = 1 THEN NULL ELSE o_custkey * 1000000 END", "observed_us": "o_custkey * 1000000 + (o_orderkey % 400) * 1000000", "initial": "CAST(o_orderkey % 50 AS DOUBLE) * 1000000", "owner_balance": "CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 41 = 1 THEN CAST(2000000000 AS DOUBLE) ELSE CAST(o_custkey % 60 AS DOUBLE) * 900000 - 1000000 END",
    "net_tokens": "CAST(o_orderkey % 70 AS DOUBLE) * 700000 - 5000000", "net_quote": "CAST(o_orderkey % 90 AS DOUBLE) / 7", "first_sell_us": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey * 1000000 + o_orderkey % 77 * 1500 END", "sold_share": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / 10 END",
    "rank": "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey % 15 + 1 END", "circulating": "CASE WHEN o_orderkey % 8 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 9 AS DOUBLE) * 80000000 END",
}


@query(f"""WITH s AS (SELECT {', '.join(f'{v} AS {n}' for n, v in _DEV.items())} FROM orders), b AS (SELECT *, greatest(coalesce(owner_balance, net_tokens), 0) AS bal, coalesce((observed_us - launch_us) // 1000000, -1) AS age FROM s), k AS (SELECT *, bal <= 1000000000 AS ok FROM b)
    SELECT mint, initial AS creator_initial_token_balance, bal AS dev_balance, CASE WHEN initial > 0 THEN least(1, greatest(0, bal / initial)) END AS creator_retained_supply_pct, CASE WHEN ok THEN bal / 1000000000 END AS dev_holding_pct_total_supply, CASE WHEN ok THEN bal / 1000000000 END AS dev_holding_pct_curve_economic_supply,
        CASE WHEN ok AND circulating > 0 THEN bal / circulating END AS dev_holding_pct_circulating, CASE WHEN ok THEN bal / 1000000000 END AS creator_ownership_pct, CASE WHEN ok THEN 'token_supply_curve_economic_or_protocol_constant' END AS token_supply_selected_for_holder_pct,
        {', '.join(f"CASE WHEN age >= {s} THEN {c} END AS creator_net_{n}_after_{t}" for n, c in (("tokens", "net_tokens"), ("quote_flow", "net_quote")) for t, s in (("10s", 10), ("30s", 30), ("1m", 60), ("5m", 300)))},
        first_sell_us IS NOT NULL AS creator_has_sold, CASE WHEN launch_us IS NOT NULL AND first_sell_us IS NOT NULL THEN greatest(0, (first_sell_us - launch_us) // 1000) END AS creator_first_sell_time_ms, coalesce(sold_share, 0) AS creator_dump_velocity, rank AS creator_balance_rank,
        {', '.join(f"coalesce(rank <= {n}, false) AS creator_is_top{n}_holder" for n in (1, 3, 5, 10))} FROM k""")
def f3_developer_columns(spark, sf_dir):
    return P.developer(table(spark, sf_dir, "orders").selectExpr(*[f"{v} as {n}" for n, v in _DEV.items()]))


_CURVE = {
    "mint": "p_partkey", "virtual_quote": "CAST(p_size AS DOUBLE) + 30", "virtual_token": "CAST(p_size AS DOUBLE) * 20000000", "real_quote": "CAST(p_partkey % 80 AS DOUBLE) / 2", "real_token": "CAST(p_partkey % 70 AS DOUBLE) * 10000000", "token_decimals": "6", "price_raw": "CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 3 END",
    "price": "CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 3000 END", "price_confidence": "CASE WHEN p_size % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END", "latest_price": "CAST(p_partkey % 90 AS DOUBLE) / 4000", "launch_price": "CASE WHEN p_partkey % 11 = 1 THEN NULL WHEN p_partkey % 11 = 2 THEN CAST(0 AS DOUBLE) ELSE CAST(p_partkey % 30 AS DOUBLE) / 4000 END",
    "cap_1b": "CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * 1000 END", "cap_total": "CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) * 900 ELSE NULL END", "cap_confidence": "CAST(0.7 AS DOUBLE)", "complete": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size > 45 END", "progress": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * 2 END",
    "completion": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END", "progress_confidence": "CAST(0.8 AS DOUBLE)", "updated_us": "CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE p_partkey * 1234567 END", "observed_us": "p_partkey * 1234000 + 900000", "top1_share": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size % 10 AS DOUBLE) / 10 END", "dev_sold": "CAST(p_partkey % 4 AS DOUBLE) / 8",
}


@query(f"""WITH c AS (SELECT {', '.join(f'{v} AS {n}' for n, v in _CURVE.items())} FROM part), d AS (SELECT *, least(1, (real_quote + virtual_quote) / 100) AS depth FROM c)
    SELECT mint, virtual_quote AS virtual_quote_reserves, virtual_token AS virtual_token_reserves, real_quote AS real_quote_reserves, real_token AS real_token_reserves, token_decimals, price_raw AS price_lamports_per_raw_token, price AS price_sol_per_token, price_confidence AS reserve_price_confidence, coalesce(price, latest_price) AS price_current,
        launch_price AS price_launch, CASE WHEN launch_price > 0 THEN latest_price / launch_price - 1 END AS price_change_from_launch_pct, cap_1b AS market_cap_quote_1b, coalesce(cap_total, price * 1000000000) AS market_cap_quote_total_supply, 1e9 AS token_supply_curve_economic_ui, 1e9 AS token_supply_protocol_constant_ui,
        'token_supply_curve_economic_or_protocol_constant' AS token_supply_selected_for_market_cap, 'bonding_curve_real_reserves_and_curve_economic_supply' AS token_supply_selected_for_curve_progress, 'phase102.supply_denominator.v1' AS supply_denominator_policy_version, cap_confidence AS market_cap_confidence, complete AS curve_complete_flag, progress AS curve_progress_pct,
        coalesce(progress, completion) AS curve_completion_pct, progress_confidence AS curve_progress_confidence, CASE WHEN updated_us IS NOT NULL THEN greatest(0, CAST(trunc((observed_us - updated_us) / 1000) AS BIGINT)) END AS curve_staleness_ms, depth AS quote_asset_specific_depth_score, least(1, greatest(0, depth * (1 - coalesce(top1_share, 0)) * (1 - dev_sold))) AS quote_asset_specific_curve_health FROM d""")
def f4_curve_columns(spark, sf_dir):
    return P.curve(table(spark, sf_dir, "part").selectExpr(*[f"{v} as {n}" for n, v in _CURVE.items()]))


_FEE = "CASE WHEN seq % 6 = 0 THEN NULL ELSE (wallet * 997 + seq * 13) % 16000 END"
_P = lambda where, q: f"(SELECT mint, max(fee) FILTER (i = (n - 1) * {q} // 100) AS v FROM (SELECT mint, fee, row_number() OVER (PARTITION BY mint ORDER BY fee) - 1 AS i, count(*) OVER (PARTITION BY mint) AS n FROM t WHERE fee IS NOT NULL AND {where}) GROUP BY mint)"


@query(with_views("ev", sql=f"""t AS (SELECT mint, side, quote, us, seq, {_FEE} AS fee, CASE WHEN seq % 4 = 0 THEN NULL ELSE 5000 END AS base, row_number() OVER (PARTITION BY mint, side ORDER BY us, seq) AS r FROM ev), s AS (SELECT mint, sum(quote) AS q, sum(coalesce(fee, 0) + coalesce(base, 0)) AS paid FROM t GROUP BY mint),
    x AS (SELECT s.mint, a.v AS med, h.v AS p90, b.v AS buy, l.v AS sell, f.v AS first, CASE WHEN q > 0 THEN paid / 1e9 / q ELSE 0 END AS move, CASE WHEN s.mint % 3 = 0 THEN 0 ELSE (s.mint % 7 - 3) / 1e6 END AS ret FROM s LEFT JOIN {_P('true', 50)} AS a USING (mint) LEFT JOIN {_P('true', 90)} AS h USING (mint) LEFT JOIN {_P("side = 'buy'", 50)} AS b USING (mint)
        LEFT JOIN {_P("side = 'sell'", 50)} AS l USING (mint) LEFT JOIN {_P("side = 'buy' AND r <= 8", 50)} AS f USING (mint))
    SELECT mint, med AS launch_priority_fee_median, p90 AS launch_priority_fee_p90, buy AS pump_buy_priority_fee_median, sell AS pump_sell_priority_fee_median, first AS first_buyers_priority_fee_median, coalesce(med > 0 AND p90 >= 2 * med, false) AS priority_fee_spike_near_launch, med AS our_required_priority_fee_estimate,
        least(1, coalesce(p90, 0) / 10000) AS fee_war_score, move AS minimum_move_to_cover_observed_fees, ret - move AS edge_minus_fee_war_cost, least(1, coalesce(p90, 0) / 10000) >= 0.5 AND ret - move <= 0 AS high_fee_low_edge_warning FROM x"""))
def f18_fee_columns(spark, sf_dir):
    t = ev_trades(spark, sf_dir).withColumns({"priority_fee": F.expr(_FEE), "base_fee": F.expr("CASE WHEN seq % 4 = 0 THEN NULL ELSE 5000 END")})
    r = t.select("mint").distinct().select("mint", F.when(F.col("mint") % 3 != 0, (F.col("mint") % 7 - 3) / 1e6).alias("return_pct_30s"))
    return P.fee_competition(t, r)


_EXEC = {
    "mint": "p_partkey", "first_seen_source": _LAUNCH["first_seen_source"], "launch_slot": _LAUNCH["launch_slot"], "trades": "p_size * 2", "latest_price": "CAST(p_partkey % 40 AS DOUBLE) / 9", "history_price": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_partkey % 25 AS DOUBLE) / 9 END",
    "organic_flow_score": "CASE WHEN p_size % 8 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 50 END", "rug_probability_score": "CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(p_partkey % 100 AS DOUBLE) / 150 END",
}


@query(f"""WITH x AS (SELECT {', '.join(f'{v} AS {n}' for n, v in _EXEC.items())} FROM part)
    SELECT mint, NULL::BIGINT AS first_seen_by_shred_ns, NULL::DOUBLE AS shred_lead_time_ms, first_seen_source <> 'Geyser' AS token_signal_available_before_geyser_flag, coalesce(launch_slot, 0) AS slot_id, least(1, trades / 50) AS competition_intensity_score, CASE WHEN history_price IS NULL THEN 0 ELSE latest_price - history_price END AS counterfactual_buy_after_100ms_pnl,
        least(1, greatest(0, coalesce(organic_flow_score, 0) - coalesce(rug_probability_score, 0))) AS latency_adjusted_trade_eligibility FROM x""")
def f19_execution_columns(spark, sf_dir):
    return P.execution(table(spark, sf_dir, "part").selectExpr(*[f"{v} as {n}" for n, v in _EXEC.items()]))


_QUALITY = {
    "mint": "p_partkey", "gap": "p_partkey % 14 = 1", "tentative": "p_partkey % 10 = 2", "first_seen_source": _LAUNCH["first_seen_source"], "price_current": "CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_retailprice END", "buy_volume_quote": "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END", "holder_count_current": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END",
    "bundle_risk_score": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END", "rug_probability_score": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size END", "other": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END",
}
_FIVE = ["price_current", "buy_volume_quote", "holder_count_current", "bundle_risk_score", "rug_probability_score"]


@query(f"""WITH x AS (SELECT {', '.join(f'{v} AS {n}' for n, v in _QUALITY.items())} FROM part), m AS (SELECT *, {' + '.join(f'({c} IS NULL)::INT' for c in _FIVE)} AS miss, ({' + '.join(f'({c} IS NOT NULL)::INT' for c in [*_FIVE, 'other'])}) / 6 AS there FROM x),
    q AS (SELECT *, least(1, greatest(0, there - miss / 10 - CASE WHEN tentative THEN 0.2 ELSE 0 END - CASE WHEN gap THEN 0.5 ELSE 0 END)) AS q FROM m)
    SELECT mint, true AS geyser_connected_flag, first_seen_source <> 'Geyser' AS shred_connected_flag, gap OR tentative AS source_disagreement_flag, miss AS critical_feature_missing_count, there AS feature_completeness_pct, q AS data_quality_score, q >= 0.5 AND NOT gap AS trade_allowed_data_quality_flag FROM q""")
def f20_data_quality_columns(spark, sf_dir):
    return P.data_quality(table(spark, sf_dir, "part").selectExpr(*[f"{v} as {n}" for n, v in _QUALITY.items()]))


@query("""WITH p AS (SELECT unnest(['wallet_behavior_vector', 'wallet_risk_vector', 'wallet_alpha_vector', 'wallet_toxicity_vector', 'buyer_cohort_similarity_to_past_winners', 'creator_launch_factory_score', 'same_launch_instruction_shape_score', 'same_compute_budget_pattern_score', 'client_fingerprint_cluster_id', 'client_fingerprint_historical_win_rate',
    'first_10_event_sequence', 'event_bigram_counts', 'event_sequence_similarity_to_winners', 'motif_id', 'motif_historical_expected_pnl', 'price_path_shape_id', 'combined_multivariate_path_similarity', 'dynamic_time_warp_distance_price_to_winner_templates', 'higher_low_accumulation_score', 'hazard_rug_next_10s', 'survival_probability_30s',
    'expected_safe_hold_time', 'anomaly_score_positive', 'anomaly_requires_deep_tracking_flag']) AS feature) SELECT DISTINCT user_id AS mint, feature, 'unavailable' AS status FROM events, p""")
def f23_placeholders(spark, sf_dir):
    return P.placeholders(table(spark, sf_dir, "events").select(F.col("user_id").alias("mint")).distinct())


@query(with_views("ev", sql="""s AS (SELECT mint, min(us) AS su, arg_min(price, (us, seq)) AS sp FROM ev GROUP BY mint), x AS (SELECT ev.*, sp, max(price) OVER (PARTITION BY mint ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS run, lead(us) OVER (PARTITION BY mint ORDER BY us, seq) AS nu FROM ev JOIN s USING (mint))
    SELECT mint, max((run - price) / run) AS max_drawdown, 1 - arg_max(price, (us, seq)) / max(price) AS drawdown_from_ath, CASE WHEN any_value(sp) > 0 THEN greatest(0, 1 - arg_max(price, (us, seq)) / any_value(sp)) END AS drawdown_from_launch, sum(CASE WHEN price < sp AND nu IS NOT NULL THEN nu - us ELSE 0 END) AS below_launch_us FROM x GROUP BY mint"""))
def w6_drawdowns(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    return P.price_path(t, t.groupBy("mint").agg(F.min("us").alias("start_us"), F.min_by("price", F.struct("us", "seq")).alias("start_price")))


_SPANS = {"30s": 172_800, "1m": 432_000, "5m": 1_296_000}


@query(with_views("ev", sql=f"""o AS (SELECT mint, max(us) + 3600000000 AS ob, CASE WHEN mint % 4 = 0 THEN NULL ELSE min(us) - 5000000 END AS la, CASE WHEN mint % 5 = 0 THEN NULL WHEN mint % 5 = 1 THEN 0 ELSE avg(price) END AS lp FROM ev GROUP BY mint),
    x AS (SELECT ev.*, ob, la, lp, lag(price) OVER w AS p0, lag(us) OVER w AS u0, max(price) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM ev JOIN o USING (mint) WINDOW w AS (PARTITION BY mint ORDER BY us, seq)),
    g AS (SELECT mint, any_value(ob) AS ob, any_value(la) AS la, any_value(lp) AS lp, max(price) AS hi, min(price) AS lo, arg_max(price, (us, seq)) AS last, arg_min(us, (-price, us, seq)) AS ath, count(*) FILTER (price > coalesce(run, 0)) AS n, avg((price < lp)::INT) AS below, bool_or(side = 'sell') AS sold,
        {', '.join(f"arg_min(price, (us, seq)) FILTER (us >= ob - {s * 1_000_000}) AS f_{n}" for n, s in _SPANS.items())}, min(us) FILTER (us >= ob - {_SPANS['30s'] * 1_000_000}) AS fu, {', '.join(f"avg(abs(price / p0 - 1)) FILTER (u0 >= ob - {_SPANS[n] * 1_000_000} AND p0 > 0) AS v_{n}" for n in ("30s", "1m"))} FROM x GROUP BY mint)
    SELECT mint, hi AS price_high, lo AS price_low, CASE WHEN hi > 0 THEN 1 - last / hi END AS drawdown_from_ath_pct, CASE WHEN lp > 0 THEN greatest(0, 1 - last / lp) END AS drawdown_from_launch_pct, {', '.join(f"CASE WHEN f_{n} > 0 THEN last / f_{n} - 1 END AS return_pct_{n}" for n in _SPANS)}, v_30s AS realized_volatility_30s, v_1m AS realized_volatility_1m,
        CASE WHEN (ob - fu) // 1000 > 0 THEN (last - f_30s) / ((ob - fu) // 1000) END AS price_velocity_30s, CASE WHEN la IS NOT NULL THEN greatest(0, (ath - la) // 1000) END AS time_to_ath_ms, CASE WHEN lp > 0 THEN below ELSE 0 END AS time_below_launch_price_pct, n AS new_ath_frequency, CASE WHEN hi > 0 AND sold THEN hi - last END AS post_ath_selloff_velocity FROM g"""))
def f5_price_columns(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    m = F.col("mint")
    a = t.groupBy("mint").agg((F.max("us") + 3_600_000_000).alias("observed_us"), F.min("us").alias("first"), F.avg("price").alias("mean"))
    a = a.select("mint", "observed_us", F.when(m % 4 != 0, F.col("first") - 5_000_000).alias("launch_us"), F.when(m % 5 == 0, None).when(m % 5 == 1, F.lit(0.0)).otherwise(F.col("mean")).alias("launch_price"))
    return P.price_columns(t, a, _SPANS)


_RANK = lambda side, q: f"max(quote) FILTER (side = '{side}' AND i = (n - 1) * {q} // 100)"


@query(with_views("ev", sql=f"""r AS (SELECT *, row_number() OVER (PARTITION BY mint, side ORDER BY quote) - 1 AS i, count(*) OVER (PARTITION BY mint, side) AS n, row_number() OVER (PARTITION BY mint ORDER BY us, seq) AS k, max(us) FILTER (side = 'buy') OVER (PARTITION BY mint ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM ev),
    g AS (SELECT mint, count(*) FILTER (side = 'buy') AS b, count(*) FILTER (side = 'sell') AS s, count(DISTINCT wallet) FILTER (side = 'buy') AS ub, count(DISTINCT wallet) FILTER (side = 'sell') AS us_, coalesce(sum(quote) FILTER (side = 'buy'), 0) AS bv, coalesce(sum(quote) FILTER (side = 'sell'), 0) AS sv, max(quote) FILTER (side = 'buy') AS lb, max(quote) FILTER (side = 'sell') AS ls,
        {_RANK('buy', 50)} AS mb, {_RANK('sell', 50)} AS ms, {_RANK('buy', 90)} AS pb9, {_RANK('sell', 90)} AS ps9, avg((side = 'buy')::INT) FILTER (k <= 10) AS ten, coalesce(max(us - pb) FILTER (side = 'buy'), 0) // 1000 AS gap, CASE WHEN mint % 3 = 0 THEN 0 ELSE (mint % 10) / 12 END AS t5, CASE WHEN mint % 3 = 0 THEN 0 ELSE (mint % 4) / 5 END AS ds FROM r GROUP BY mint),
    o AS (SELECT *, CASE WHEN b > 0 THEN ub / b ELSE 0 END * (1 - t5) AS org FROM g)
    SELECT mint, b AS buy_count, s AS sell_count, b + s AS trade_count, ub AS unique_buyers, us_ AS unique_sellers, bv AS buy_volume_quote, sv AS sell_volume_quote, bv - sv AS net_flow_quote, CASE WHEN s > 0 THEN b / s END AS buy_sell_count_ratio, CASE WHEN sv > 0 THEN bv / sv END AS buy_sell_volume_ratio, lb AS largest_buy_quote, ls AS largest_sell_quote,
        mb AS median_buy_size_quote, ms AS median_sell_size_quote, pb9 AS p90_buy_size_quote, ps9 AS p90_sell_size_quote, ten AS first_10_trades_buy_ratio, gap AS no_buy_gap_longest_ms, org AS organic_flow_score, least(1, 1 - org + ds) AS toxic_flow_score FROM o"""))
def f6_flow_columns(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    m = F.col("mint")
    shares = t.select("mint").distinct().where(m % 3 != 0).select("mint", ((m % 10) / 12).alias("top5_share"), ((m % 4) / 5).alias("dev_sold"))
    return P.flow_columns(t, shares)


_CONTEXT = {
    "mint": "p_partkey", "curve": "p_partkey % 60", "associated_curve": "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_size END", "reliable": "p_partkey % 7 <> 0", "net_tokens": "CAST(p_size AS DOUBLE)", "creator_sold": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 100 END", "growth": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 40 - 0.1 END", "missing_owners": "p_size % 3",
    **{c: f"CASE WHEN p_partkey % 10 = {i} THEN NULL ELSE p_size + {i} END" for i, c in enumerate(P.COUNTERS)},
}


@query(with_views("li", "bal", sql=f"""cr AS (SELECT mint, min(wallet) AS creator FROM li WHERE side = 'buy' GROUP BY mint), cx AS (SELECT x.*, creator FROM (SELECT {', '.join(f'{v} AS {n}' for n, v in _CONTEXT.items())} FROM part) AS x LEFT JOIN cr USING (mint)),
    r AS (SELECT b.mint, b.wallet, b.balance, curve, associated_curve, creator, b.balance / sum(b.balance) OVER w AS share, row_number() OVER (PARTITION BY b.mint ORDER BY b.balance DESC, b.wallet) AS r, row_number() OVER (PARTITION BY b.mint ORDER BY b.balance) - 1 AS i, count(*) OVER w AS n, coalesce(b.wallet = curve, false) OR coalesce(b.wallet = associated_curve, false) AS oc, coalesce(b.wallet = creator, false) AS ow FROM bal AS b JOIN cx ON cx.mint = b.mint WINDOW w AS (PARTITION BY b.mint)),
    g AS (SELECT mint, count(*) AS n, sum(balance) AS s, count(*) FILTER (NOT oc) AS ec, count(*) FILTER (NOT oc AND NOT ow) AS ecd, max(balance) FILTER (NOT oc) AS f, max(balance) FILTER (ow) AS dev, count(*) FILTER (share >= 0.1 AND r <= 20) AS wc, coalesce(sum(share) FILTER (share >= 0.1 AND r <= 20), 0) AS wp, coalesce(bool_or(ow) FILTER (r = 1), false) AS tc, max(balance) FILTER (i = (n - 1) * 50 // 100) AS med,
        max(balance) FILTER (i = (n - 1) * 90 // 100) AS p90, 2 * sum((i + 1) * balance) / (count(*) * sum(balance)) - (count(*) + 1) / count(*) AS gini, sum(share * share) AS hhi, {', '.join(f'sum(share) FILTER (r <= {k}) AS t{k}' for k in (1, 3, 5, 10, 20))} FROM r GROUP BY mint),
    y AS (SELECT cx.*, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(ec, 0) AS ec, coalesce(ecd, 0) AS ecd, coalesce(f, 0) AS f, greatest(0, 250 - greatest(0, coalesce(dev, net_tokens))) AS ci, coalesce(wc, 0) AS wc, coalesce(wp, 0) AS wp, coalesce(tc, false) AS tc, med, p90, coalesce(gini, 0) AS gini, coalesce(hhi, 0) AS hhi, {', '.join(f'coalesce(t{k}, 0) AS t{k}' for k in (1, 3, 5, 10, 20))}, reliable AND coalesce(s, 0) <= 250.000001 AS ok FROM cx LEFT JOIN g ON g.mint = cx.mint)
    SELECT mint, n AS holder_count_current, n AS holders_with_nonzero_balance, n AS holder_count_owner_wallets, {', '.join(f'coalesce({c}, 0) AS {c}' for c in P.COUNTERS)}, ec AS holder_count_excluding_curve, ecd AS holder_count_excluding_curve_and_dev, CASE WHEN ok THEN s END AS observed_holder_supply, CASE WHEN reliable THEN ci END AS circulating_holder_supply, growth AS holder_growth_rate,
        CASE WHEN growth IS NOT NULL THEN least(1, greatest(0, growth)) END AS sustained_holder_growth_score, CASE WHEN n > 0 THEN s / n END AS average_holder_balance, med AS median_holder_balance, p90 AS p90_holder_balance, gini AS holder_balance_gini, hhi AS holder_balance_hhi, t1 AS top1_holder_pct, t1 AS top1_holder_pct_observed, CASE WHEN ok THEN f / 250 END AS top1_holder_pct_total_supply,
        CASE WHEN ok THEN f / 250 END AS top1_holder_pct_curve_economic_supply, CASE WHEN ok AND CASE WHEN ci > 0 THEN f / ci ELSE 0 END <= 1.000001 THEN CASE WHEN ci > 0 THEN f / ci ELSE 0 END END AS top1_holder_pct_circulating, CASE WHEN ok THEN 'token_supply_curve_economic_or_protocol_constant' END AS token_supply_selected_for_holder_pct, t3 AS top3_holder_pct, t5 AS top5_holder_pct, t10 AS top10_holder_pct,
        t20 AS top20_holder_pct, CASE WHEN NOT reliable THEN 0.3 WHEN missing_owners = 0 THEN 0.9 ELSE 0.5 END AS holder_metric_confidence, missing_owners AS missing_owner_mapping_count, least(1, greatest(0, 1 - t5 + greatest(gini, 0))) / 2 AS holder_distribution_improvement_score, wc AS whale_count, wp AS whale_holding_pct, tc AS top1_is_creator,
        least(1, 0.45 * least(1, greatest(0, (t1 - 0.30) / 0.40)) + 0.30 * least(1, greatest(0, (t5 - 0.75) / 0.25)) * least(1, greatest(n, 1) / 5) + 0.15 * coalesce(creator_sold, 0) + 0.10 * gini) AS concentration_risk_score, t1 >= 0.55 AS one_wallet_controls_market_flag FROM y"""))
def f7_f8_holder_columns(spark, sf_dir):
    from ..adapters import balances, li_trades

    first = li_trades(spark, sf_dir).where("side = 'buy'").groupBy("mint").agg(F.min("wallet").alias("creator"))
    context = table(spark, sf_dir, "part").selectExpr(*[f"{v} as {n}" for n, v in _CONTEXT.items()]).join(first, "mint", "left")
    return P.holder_columns(balances(spark, sf_dir), context, 250.0)


_RUG = {
    "mint": "o_orderkey", "first_sell_us": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END", "sold_share": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / 20 END", "drawdown_from_ath_pct": "CASE WHEN o_custkey % 8 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) / 100 END", "drawdown_from_launch_pct": "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END",
    "launch_us": "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey * 1000000 END", "observed_us": "o_custkey * 1000000 + o_orderkey % 500 * 1000000", "growth": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS DOUBLE) - 1 END", "buy_volume": "CAST(o_orderkey % 60 AS DOUBLE)", "sell_volume": "CAST(o_custkey % 60 AS DOUBLE)",
    "last_buy_us": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey * 1000000 + o_orderkey % 500 * 1000000 - o_custkey % 45 * 1000000 END", "top1_share": "CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 70 AS DOUBLE) / 100 END", "trades": "o_custkey % 40",
}


@query(f"""WITH x AS (SELECT {', '.join(f'{v} AS {n}' for n, v in _RUG.items())} FROM orders), y AS (SELECT *, coalesce(observed_us - launch_us <= 300000000, false) AND coalesce(drawdown_from_launch_pct, 0) >= 0.7 AS fell, coalesce(observed_us - last_buy_us >= 20000000, true) AS quiet FROM x)
    SELECT mint, first_sell_us IS NOT NULL AS dev_sold_flag, coalesce(sold_share, 0) AS dev_sold_pct, coalesce(drawdown_from_ath_pct, 0) >= 0.5 AS price_drop_50pct_from_ath, fell AS price_drop_70pct_from_launch_within_5m, coalesce(growth <= 0, false) AS holder_growth_stalled, sell_volume > buy_volume AS sells_dominate_after_launch, quiet AS no_buys_for_x_seconds,
        least(1, coalesce(sold_share, 0) + CASE WHEN quiet THEN 0.3 ELSE 0 END + CASE WHEN fell THEN 0.6 ELSE 0 END + CASE WHEN coalesce(top1_share, 0) >= 0.35 THEN 0.2 ELSE 0 END) AS rug_probability_score, least(1, trades / 20) AS rug_confidence FROM y""")
def f10_rug_columns(spark, sf_dir):
    return P.rug_columns(table(spark, sf_dir, "orders").selectExpr(*[f"{v} as {n}" for n, v in _RUG.items()]))


@query(with_views("ev", sql="""o AS (SELECT mint, wallet, count(*) FILTER (side = 'buy') AS b, coalesce(sum(tokens) FILTER (side = 'sell'), 0) AS s FROM ev GROUP BY 1, 2), t AS (SELECT wallet, sum(s) AS a FROM o GROUP BY 1), x AS (SELECT mint, CASE WHEN b > 0 AND a > s THEN a - s END AS e FROM o JOIN t USING (wallet)),
    g AS (SELECT mint, count(e) AS n, coalesce(sum(e), 0) AS m FROM x GROUP BY 1), v AS (SELECT mint, coalesce(sum(quote) FILTER (side = 'sell'), 0) AS sv FROM ev GROUP BY 1)
    SELECT mint, n AS wallets_sold_other_token_then_bought_this_count, m AS net_capital_rotated_into_this_from_other_launches, n / (SELECT count(DISTINCT wallet) FROM ev) AS smart_capital_rotation_score, n > 0 AND m > sv AS this_token_becoming_primary_capital_destination_flag FROM g JOIN v USING (mint)"""))
def f12_rotation_columns(spark, sf_dir):
    return P.rotation_columns(ev_trades(spark, sf_dir))


@query(with_views("ev", sql=_LEDGER + """, m AS (SELECT mint, arg_max(price, (us, seq)) AS price, coalesce(sum(quote) FILTER (side = 'sell'), 0) AS sv FROM ev GROUP BY mint), x AS (SELECT p.*, sv, held * price - cost AS u, realised > 0 AS tp, sold > 0 AND held <= 0 AS rt FROM p JOIN m USING (mint)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY held DESC, wallet) AS r, held / nullif(sum(held) OVER (PARTITION BY mint), 0) AS share, row_number() OVER (PARTITION BY mint ORDER BY u) - 1 AS k, count(*) OVER (PARTITION BY mint) AS n FROM x),
    g AS (SELECT mint, any_value(sv) AS sv, avg(u) AS mean, max(u) FILTER (k = (n - 1) * 50 // 100) AS med, max(u) FILTER (k = (n - 1) * 90 // 100) AS p90, CASE WHEN sum(held) > 0 THEN coalesce(sum(held) FILTER (u > 0), 0) / sum(held) END AS pr, CASE WHEN sum(held) > 0 THEN coalesce(sum(held) FILTER (u < 0), 0) / sum(held) END AS un, CASE WHEN sum(held) > 0 THEN coalesce(sum(held) FILTER (abs(u) <= 0.0001), 0) / sum(held) END AS br,
        CASE WHEN sum(held) > 0 THEN coalesce(sum(held) FILTER (tp), 0) / sum(held) END AS fr, coalesce(sum(u) FILTER (r <= 5 AND held > 0), 0) AS u5, coalesce(sum(u) FILTER (r <= 10 AND held > 0), 0) AS u10, sum(greatest(realised, 0)) / nullif(sum(abs(realised)), 0) AS rate, count(*) FILTER (tp) AS io, count(*) FILTER (rt) AS fe, coalesce(sum(share) FILTER (r <= 1), 0) AS t1, coalesce(sum(share) FILTER (r <= 5), 0) AS t5 FROM rk GROUP BY mint)
    SELECT mint, mean AS holder_unrealized_pnl_mean, med AS holder_unrealized_pnl_median, p90 AS holder_unrealized_pnl_p90, pr AS unrealized_profit_supply_pct, un AS underwater_supply_pct, br AS breakeven_supply_pct, fr AS free_rolling_supply_pct, u5 AS top5_unrealized_pnl, u10 AS top10_unrealized_pnl, rate AS realized_profit_taking_rate,
        least(1, 0.35 * coalesce(pr, 0) + 0.35 * coalesce(fr, 0) + 0.15 * least(1, greatest(0, (t1 - 0.45) / 0.55)) + 0.15 * least(1, greatest(0, (t5 - 0.80) / 0.20))) AS profit_overhang_score, least(1, coalesce(un, 0) + sv / 100) AS underwater_capitulation_risk, least(1, coalesce(fr, 0) + t5 / 2) AS free_roll_dump_risk_score, io AS holders_taking_initials_out_count, fe AS holders_fully_exiting_count FROM g""").replace("WITH", "WITH RECURSIVE", 1))
def f13_cost_columns(spark, sf_dir):
    from ..operators import ledger as L

    t = ev_trades(spark, sf_dir)
    marked = L.marked(L.positions(t), t.groupBy("mint").agg(F.max_by("price", F.struct("us", "seq")).alias("price")))
    return P.cost_columns(marked, t.groupBy("mint").agg(F.coalesce(F.sum(F.when(F.col("side") == "sell", F.col("quote"))), F.lit(0.0)).alias("sell_volume")))


_TX = {
    "compute_limit": "CASE WHEN seq % 5 = 0 THEN NULL ELSE (wallet % 7) * 100000 END", "compute_price": "CASE WHEN seq % 4 = 0 THEN NULL ELSE (wallet % 5) * 3000 END", "account_count": "CASE WHEN seq % 6 = 0 THEN NULL ELSE wallet % 9 + 10 END", "instruction_count": "CASE WHEN mint % 6 = 0 OR seq % 7 = 0 THEN NULL ELSE wallet % 4 + 2 END",
    "fingerprint": "CASE WHEN seq % 3 = 0 THEN NULL ELSE concat('f', wallet % 6) END",
}
_mode = lambda name, cols, where="true", src="t": f"{name} AS (SELECT mint, max(n) AS mx, sum(n) AS nn, count(*) AS g FROM (SELECT mint, {', '.join(cols)}, count(*) AS n FROM {src} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)} AND {where} GROUP BY ALL) GROUP BY mint)"
_med = lambda c: f"(SELECT mint, max({c}) FILTER (i = (n - 1) * 50 // 100) AS v FROM (SELECT mint, {c}, row_number() OVER (PARTITION BY mint ORDER BY {c}) - 1 AS i, count(*) OVER (PARTITION BY mint) AS n FROM t WHERE {c} IS NOT NULL) GROUP BY mint)"


@query(with_views("ev", sql=f"""bl AS (SELECT mint, wallet, sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) AS b FROM ev GROUP BY 1, 2), tp AS (SELECT mint, wallet FROM bl WHERE b > 0 QUALIFY row_number() OVER (PARTITION BY mint ORDER BY b DESC, wallet) <= 5),
    t AS (SELECT ev.*, {', '.join(f'{v} AS {n}' for n, v in _TX.items())}, row_number() OVER (PARTITION BY mint, side ORDER BY us, seq) AS r, (mint, wallet) IN (SELECT (mint, wallet) FROM tp) AS it FROM ev), {_mode('pf', ['compute_limit', 'compute_price'])}, {_mode('pb', ['compute_limit', 'compute_price'], "side = 'buy' AND r <= 8")}, {_mode('sq', ['instruction_count'])},
    {_mode('pt', ['account_count'])}, {_mode('cl', ['fingerprint'])}, {_mode('cb', ['fingerprint'], "side = 'buy' AND r <= 8")}, {_mode('ct', ['fingerprint'], 'it')}, m AS (SELECT DISTINCT mint FROM ev)
    SELECT m.mint, ac.v AS tx_account_count, ic.v AS tx_instruction_count, CASE WHEN ic.v IS NOT NULL THEN 0 END AS tx_inner_instruction_count, li.v IS NOT NULL OR pr.v IS NOT NULL AS compute_budget_instruction_present, li.v AS compute_unit_limit, (li.v >= 100000)::INT + (li.v >= 200000)::INT + (li.v >= 400000)::INT AS compute_unit_limit_bucket, pr.v AS compute_unit_price,
        (pr.v >= 1000)::INT + (pr.v >= 5000)::INT + (pr.v >= 10000)::INT AS compute_unit_price_bucket, coalesce(pf.mx, 1) - 1 AS duplicate_compute_profile_count, coalesce(pb.mx, 1) - 1 AS duplicate_compute_profile_among_first_buyers, coalesce(sq.mx, 1) - 1 AS duplicate_instruction_sequence_count, coalesce(pt.mx, 1) - 1 AS duplicate_account_pattern_count,
        coalesce(cl.mx / cl.nn, 0) AS identical_client_fingerprint_score, coalesce(cb.mx / cb.nn, 0) AS first_buyers_same_client_fingerprint_pct, coalesce(ct.mx / ct.nn, 0) AS top_holders_same_client_fingerprint_pct, coalesce(cl.mx / cl.nn, 0) AS bot_family_dominance_score, coalesce(cl.g / cl.nn, 0) AS bot_family_diversity_score
    FROM m LEFT JOIN {_med('account_count')} AS ac USING (mint) LEFT JOIN {_med('instruction_count')} AS ic USING (mint) LEFT JOIN {_med('compute_limit')} AS li USING (mint) LEFT JOIN {_med('compute_price')} AS pr USING (mint) LEFT JOIN pf USING (mint) LEFT JOIN pb USING (mint) LEFT JOIN sq USING (mint) LEFT JOIN pt USING (mint) LEFT JOIN cl USING (mint) LEFT JOIN cb USING (mint) LEFT JOIN ct USING (mint)"""))
def f16_fingerprint_columns(spark, sf_dir):
    t = ev_trades(spark, sf_dir).withColumns({n: F.expr(v) for n, v in _TX.items()})
    held = t.groupBy("mint", "wallet").agg(F.sum(F.when(F.col("side") == "buy", F.col("tokens")).otherwise(-F.col("tokens"))).alias("b")).where("b > 0")
    top = held.withColumn("r", F.expr("row_number() over (partition by mint order by b desc, wallet)")).where("r <= 5").select("mint", "wallet")
    return P.fingerprint_columns(t, top)


@query(with_views("ev", sql="""h AS (SELECT mint, wallet, sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) AS balance, CASE WHEN wallet % 7 = 0 THEN NULL ELSE min(us) END AS fs FROM ev GROUP BY 1, 2), c AS (SELECT mint, max(us) + 7000000 AS ob, CASE WHEN mint % 5 = 0 THEN NULL ELSE min(us) END AS la, (mint % 8) / 10 AS hhi FROM ev GROUP BY 1),
    x AS (SELECT h.*, ob, (ob - fs) // 1000000 AS age, greatest(balance, 0) AS b FROM h JOIN c USING (mint)), a AS (SELECT mint, avg(age) AS mean, sum(age * b) / nullif(sum(b), 0) AS wt, count(*) FILTER (b > 0) AS nz, count(*) FILTER (ob - fs <= 259200000000) AS n0, count(*) FILTER (ob - fs >= 259200000000) AS o0, count(*) FILTER (ob - fs <= 864000000000) AS n1, count(*) FILTER (ob - fs >= 864000000000) AS o1 FROM x GROUP BY 1),
    md AS (SELECT mint, max(age) FILTER (i = (n - 1) * 50 // 100) AS med FROM (SELECT mint, age, row_number() OVER (PARTITION BY mint ORDER BY age) - 1 AS i, count(*) OVER (PARTITION BY mint) AS n FROM x WHERE age IS NOT NULL) GROUP BY 1),
    f AS (SELECT mint, wallet, min(us) AS us, arg_min(seq, (us, seq)) AS seq FROM ev WHERE side = 'buy' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY us, seq) AS p FROM f), r AS (SELECT k.mint, count(h.mint) FILTER (p <= 10) / count(*) FILTER (p <= 10) AS r10, count(h.mint) / count(*) AS r20 FROM k LEFT JOIN h ON h.mint = k.mint AND h.wallet = k.wallet AND balance > 0 WHERE p <= 20 GROUP BY 1),
    ht AS (SELECT mint, avg(greatest(0, s - b) / 1000000) AS t FROM (SELECT mint, wallet, min(us) FILTER (side = 'buy') AS b, min(us) FILTER (side = 'sell') AS s FROM ev GROUP BY 1, 2) WHERE b IS NOT NULL AND s IS NOT NULL GROUP BY 1), e AS (SELECT mint, count(DISTINCT wallet) AS ex FROM ev WHERE side = 'sell' GROUP BY 1),
    z AS (SELECT c.mint, mean, med, wt, CASE WHEN greatest(n0, o0) > 0 THEN o0 / greatest(n0, o0) ELSE 0 END AS s0, CASE WHEN greatest(n1, o1) > 0 THEN o1 / greatest(n1, o1) ELSE 0 END AS s1, coalesce(r10, 0) AS r10, coalesce(r20, 0) AS r20, t, CASE WHEN la IS NULL THEN 0 ELSE (ob - la) // 1000000 END AS la, hhi, n0, coalesce(ex, 0) AS ex, nz FROM c LEFT JOIN a USING (mint) LEFT JOIN md USING (mint) LEFT JOIN r USING (mint) LEFT JOIN ht USING (mint) LEFT JOIN e USING (mint))
    SELECT mint, mean AS holder_age_mean, med AS holder_age_median, wt AS holder_age_weighted_by_balance, s0 AS new_holder_survival_30s, s1 AS new_holder_survival_1m, r10 AS first_10_buyers_retention, r20 AS first_20_buyers_retention, t AS average_time_to_first_sell_by_holder, la * (1 - r20) AS holder_half_life, 1 - r20 AS holder_decay_rate, least(1, 0.5 * r20 + 0.25 * s0 + 0.25 * (1 - hhi)) AS holder_stickiness_score,
        1 - least(1, 0.5 * r20 + 0.25 * s0 + 0.25 * (1 - hhi)) AS holder_paper_hands_score, least(1, n0 / greatest(ex, 1)) AS healthy_churn_score, least(1, ex / greatest(n0, 1)) AS unhealthy_churn_score, least(1, n0 / greatest(nz, 1)) AS new_holders_replacing_old_holders_score FROM z"""))
def f15_lifecycle_columns(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    h = t.groupBy("mint", "wallet").agg(F.sum(F.when(F.col("side") == "buy", F.col("tokens")).otherwise(-F.col("tokens"))).alias("balance"), F.min("us").alias("first_seen_us"))
    h = h.withColumn("first_seen_us", F.when(F.col("wallet") % 7 != 0, F.col("first_seen_us")))
    c = t.groupBy("mint").agg((F.max("us") + 7_000_000).alias("observed_us"), F.min("us").alias("first")).select("mint", "observed_us", F.when(F.col("mint") % 5 != 0, F.col("first")).alias("launch_us"), ((F.col("mint") % 8) / 10).alias("hhi"))
    return P.lifecycle_columns(h, t, c, (259_200, 864_000))


@query(with_views("ev", sql="""fe AS (SELECT c_nationkey * 100 + o_custkey % 7 AS funder, o_custkey % 100 AS wallet, round(o_totalprice / 1e5) AS amount, epoch_us(o_orderdate) + 915148800000000 + o_orderkey AS us FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT funder, wallet, sum(amount) AS amount, max(us) AS us FROM fe GROUP BY 1, 2), f AS (SELECT wallet, arg_max(funder, (us, funder)) AS funder, max(us) AS f_us FROM g GROUP BY 1),
    l AS (SELECT mint, CASE WHEN mint % 6 = 0 THEN NULL ELSE mint % 90 END AS creator, CASE WHEN mint % 7 = 0 THEN NULL ELSE min(us) END AS launch, max(us) AS ob FROM ev GROUP BY 1), m AS (SELECT l.*, funder, f_us FROM l LEFT JOIN f ON f.wallet = creator), b AS (SELECT mint, wallet, row_number() OVER (PARTITION BY mint ORDER BY us, seq) AS p FROM ev WHERE side = 'buy' QUALIFY p <= 8),
    bf AS (SELECT b.*, f.funder, f.f_us, m.funder AS cf, ob FROM b LEFT JOIN f USING (wallet) JOIN m ON m.mint = b.mint), fi AS (SELECT mint, count(*) FILTER (funder = cf) AS ov, count(funder) AS n, max(f_us) FILTER (p = 1) AS ff, count(*) FILTER (ob - f_us <= 60000000) AS ju FROM bf GROUP BY 1),
    fs AS (SELECT mint, max(n) / sum(n) AS fs FROM (SELECT mint, funder, count(*) AS n FROM bf WHERE funder IS NOT NULL GROUP BY 1, 2) GROUP BY 1), bl AS (SELECT mint, wallet, sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) AS b FROM ev GROUP BY 1, 2), tp AS (SELECT mint, wallet FROM bl WHERE b > 0 QUALIFY row_number() OVER (PARTITION BY mint ORDER BY b DESC, wallet) <= 5),
    ts AS (SELECT mint, max(n) / sum(n) AS ts FROM (SELECT mint, funder, count(*) AS n FROM tp JOIN f USING (wallet) GROUP BY 1, 2) GROUP BY 1), la AS (SELECT funder, count(*) AS la FROM m WHERE funder IS NOT NULL GROUP BY 1), fu AS (SELECT funder, count(*) AS fu FROM g GROUP BY 1), am AS (SELECT funder, max(n) / sum(n) AS am FROM (SELECT funder, round(amount, 4) AS a, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1),
    al AS (SELECT max(n) / sum(n) AS al FROM (SELECT round(amount, 4) AS a, count(*) AS n FROM g GROUP BY 1)), d AS (SELECT least(1, (SELECT count(*) FROM g) / 2500 * 10) AS d), bu AS (SELECT mint, (SELECT count(*) FROM g WHERE g.us <= launch AND g.us >= launch - 300000000) AS bu FROM l WHERE launch IS NOT NULL),
    z AS (SELECT m.*, ov, n, ff, ju, coalesce(fs, 0) AS fs, coalesce(ts, 0) AS ts, la, fu, am, al, d, bu FROM m LEFT JOIN fi USING (mint) LEFT JOIN fs USING (mint) LEFT JOIN ts USING (mint) LEFT JOIN la ON la.funder = m.funder LEFT JOIN fu ON fu.funder = m.funder LEFT JOIN am ON am.funder = m.funder LEFT JOIN bu USING (mint), al, d)
    SELECT mint, funder AS creator_recent_funder, abs(launch - f_us) // 1000000 AS funder_to_creator_edge_age, coalesce(ov, 0) AS buyer_recent_funder_overlap_count, fs AS first_buyers_same_funder_pct, ts AS top_holders_same_funder_pct, CASE WHEN n > 0 THEN abs(launch - ff) // 1000000 END AS funder_to_buyer_edge_age, CASE WHEN funder IS NOT NULL THEN la END AS funder_to_multiple_launches_count,
        CASE WHEN funder IS NULL THEN al ELSE am END AS same_funder_same_amount_pattern, coalesce(bu, 0) AS funding_burst_before_launch, coalesce(ju, 0) AS wallets_funded_just_before_buy_count, coalesce(fu, 0) AS fresh_wallets_funded_by_known_factory, d AS funding_graph_density, least(1, fs + ts + d) / 3 AS funding_graph_suspicion_score, 1 - least(1, fs + ts + d) / 3 AS funding_graph_quality_score FROM z"""))
def f17_funding_columns(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    raw = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select((F.col("c_nationkey") * 100 + F.col("o_custkey") % 7).cast("long").alias("funder"), (F.col("o_custkey") % 100).alias("wallet"), F.round(F.col("o_totalprice") / 1e5).alias("amount"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + 915_148_800_000_000 + F.col("o_orderkey")).alias("us"))
    edges = raw.groupBy("funder", "wallet").agg(F.sum("amount").alias("amount"), F.max("us").alias("us"))
    m = F.col("mint")
    launches_ = t.groupBy("mint").agg(F.min("us").alias("first"), F.max("us").alias("observed_us")).select("mint", F.when(m % 6 != 0, m % 90).alias("creator"), F.when(m % 7 != 0, F.col("first")).alias("launch_us"), "observed_us")
    buyers = t.where("side = 'buy'").withColumn("place", F.expr("row_number() over (partition by mint order by us, seq)")).where("place <= 8").select("mint", "wallet", "place")
    held = t.groupBy("mint", "wallet").agg(F.sum(F.when(F.col("side") == "buy", F.col("tokens")).otherwise(-F.col("tokens"))).alias("b")).where("b > 0")
    top = held.withColumn("r", F.expr("row_number() over (partition by mint order by b desc, wallet)")).where("r <= 5").select("mint", "wallet")
    return P.funding_columns(launches_, edges, buyers, top, 50)


_TOKEN = {
    "mint": "p_partkey", "launch_us": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey * 3000000 + p_size % 5 * 700000 END", "observed_us": "p_partkey * 3000000 + p_size * 1000000", "lifecycle": "CASE p_size % 6 WHEN 0 THEN 'ActiveDeep' WHEN 1 THEN 'SoftDiscarded' WHEN 2 THEN 'RugArchive' WHEN 3 THEN 'InPosition' WHEN 4 THEN 'Discovered' ELSE 'HardDiscarded' END", "unique_buyers": "p_size % 8",
    "buy_volume": "CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(p_size % 30 AS DOUBLE) END", "net_flow": "CAST(p_partkey % 13 AS DOUBLE) - 6", "growth": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_partkey % 7 AS DOUBLE) / 7 END", "price_return": "CAST(p_size % 21 AS DOUBLE) / 10 - 1", "growth_1m": "CAST(p_partkey % 5 AS DOUBLE)", "return_1m": "CAST(p_size % 11 AS DOUBLE) / 5",
    "buy_volume_5s": "CAST(p_size % 6 AS DOUBLE)", "buy_volume_15s": "CAST(p_partkey % 9 AS DOUBLE)",
}
_MEASURES = ["buy_volume", "net_flow", "growth", "price_return", "growth_1m", "return_1m", "buy_volume_5s", "buy_volume_15s"]
_rk = lambda m: f"count(*) FILTER (b.{m} > a.{m} OR b.{m} = a.{m} AND b.mint < a.mint) + 1"
_pairs = lambda s: f"FROM t AS a JOIN t AS b ON abs(a.launch_us - b.launch_us) <= {s} * 1000000 AND b.launch_us <= a.observed_us OR a.launch_us IS NULL AND a.mint = b.mint GROUP BY a.mint"


@query(f"""WITH x AS (SELECT {', '.join(f'{v} AS {n}' for n, v in _TOKEN.items())} FROM part), t AS (SELECT * REPLACE ({', '.join(f'coalesce({m}, 0) AS {m}' for m in _MEASURES)}) FROM x),
    c AS (SELECT a.mint, count(*) AS n, count(*) FILTER (b.lifecycle IN ('ActiveDeep', 'InPosition')) AS ac, count(*) FILTER (b.lifecycle IN ('SoftDiscarded', 'HardDiscarded')) AS di, count(*) FILTER (b.lifecycle = 'RugArchive') AS ru, {_rk('buy_volume')} AS r1, {_rk('net_flow')} AS r2, {_rk('growth')} AS r3, {_rk('price_return')} AS r4, sum(b.buy_volume) AS v, max(b.buy_volume) AS best, sum(b.unique_buyers) AS ub, any_value(a.buy_volume) AS mine, any_value(a.unique_buyers) AS mub,
        avg((b.buy_volume <= a.buy_volume)::INT) AS p1, avg((b.net_flow <= a.net_flow)::INT) AS p2, avg((b.growth_1m <= a.growth_1m)::INT) AS p3, avg((b.return_1m <= a.return_1m)::INT) AS p4 {_pairs(30)}), f AS (SELECT a.mint, {_rk('buy_volume_5s')} AS k5 {_pairs(5)}), g AS (SELECT a.mint, {_rk('buy_volume_15s')} AS k15 {_pairs(15)}),
    s AS (SELECT *, CASE WHEN n <= 1 THEN 1 ELSE least(1, greatest(0, 1 - (r1 + r2 + r3 + r4 - 4) / ((n - 1) * 4))) END AS st, k15 - k5 AS ve FROM c JOIN f USING (mint) JOIN g USING (mint))
    SELECT x.mint, n AS cohort_launch_count, ac AS cohort_active_count, di / n AS cohort_discard_rate, ru / n AS cohort_rug_rate, r1 AS token_rank_by_buy_volume_30s, r2 AS token_rank_by_net_flow_30s, r3 AS token_rank_by_holder_growth_30s, r4 AS token_rank_by_price_return_30s, st AS token_relative_strength_score, 1 - st AS token_relative_weakness_score, CASE WHEN v > 0 THEN mine / v END AS cohort_attention_share,
        CASE WHEN n > 0 THEN greatest(best - mine, 0) END AS best_launch_in_cohort_distance, CASE WHEN v > 0 THEN mine / v END AS this_token_share_of_all_launch_buy_volume, CASE WHEN ub > 0 THEN mub / ub END AS this_token_share_of_all_unique_buyers, p1 AS token_percentile_buy_volume_30s, p2 AS token_percentile_net_flow_30s, p3 AS token_percentile_holder_growth_1m, p4 AS token_percentile_price_return_1m, r1 = 1 AND r4 <= 2 AS token_is_cohort_leader_flag,
        r1 = n AND r4 = n AS token_is_cohort_laggard_flag, CASE WHEN n > 0 THEN least(1, greatest(-ve, 0)) END AS token_improving_rank_velocity, CASE WHEN n > 0 THEN least(1, greatest(ve, 0)) END AS token_losing_rank_velocity FROM x LEFT JOIN s USING (mint)""")
def f11_cohort_columns(spark, sf_dir):
    return P.cohort_columns(table(spark, sf_dir, "part").selectExpr(*[f"{v} as {n}" for n, v in _TOKEN.items()]))
