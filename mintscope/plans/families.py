"""Feature families at full width: every registered name a column, NULL where it can't be known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.math import clamp01, quotient
from ..functions.text import distinct_ratio, non_ascii_ratio, uri_host, uri_scheme
from ..operators import aggregates as A
from ..operators import cohorts as C
from ..operators import windows as W
from ..sources.shared import cut

# The placeholders, the economic supply of a curve, and the texts that name what was divided by.
PLACEHOLDERS = [
    "wallet_behavior_vector", "wallet_risk_vector", "wallet_alpha_vector", "wallet_toxicity_vector", "buyer_cohort_similarity_to_past_winners", "creator_launch_factory_score", "same_launch_instruction_shape_score", "same_compute_budget_pattern_score", "client_fingerprint_cluster_id", "client_fingerprint_historical_win_rate",
    "first_10_event_sequence", "event_bigram_counts", "event_sequence_similarity_to_winners", "motif_id", "motif_historical_expected_pnl", "price_path_shape_id", "combined_multivariate_path_similarity", "dynamic_time_warp_distance_price_to_winner_templates", "higher_low_accumulation_score", "hazard_rug_next_10s",
    "survival_probability_30s", "expected_safe_hold_time", "anomaly_score_positive", "anomaly_requires_deep_tracking_flag",
]
SUPPLY = 1_000_000_000
HOLDER_SUPPLY, PROGRESS_SUPPLY, SUPPLY_POLICY = "token_supply_curve_economic_or_protocol_constant", "bonding_curve_real_reserves_and_curve_economic_supply", "phase102.supply_denominator.v1"


def launch_identity(launches: DataFrame) -> DataFrame:
    """F1, 30 columns. launches: mint, launch_slot, launch_us, observed_us and the texts and counts of the create event.

    A name, symbol or URI counts as seen before if another mint has the same, and isn't empty.
    """
    passed = ["mint", "launch_slot", "quote_mint", "creator_wallet", "payer_wallet", "bonding_curve_pubkey", "associated_bonding_curve_pubkey", "metadata_pubkey", "create_instruction_variant", "launch_same_tx_buy_count", "launch_same_slot_buy_count", "launch_tx_client_fingerprint"]
    texts = ("name", "symbol", "uri")
    x = launches
    for c in texts:
        x = A.count_alike(x.withColumn("__given", F.when(F.col(c) != "", F.col(c))), "__given", "__n").withColumn(f"duplicate_{c}_seen_historically", F.greatest(F.col("__n") - 1, F.lit(0))).drop("__given", "__n")
    t = {c: F.coalesce(F.col(c), F.lit("")) for c in texts}
    return x.select(
        *passed,
        F.greatest(F.lit(0), F.expr("(observed_us - launch_us) div 1000")).alias("time_since_launch_ms"),
        *[F.lower(c).alias(c) for c in ("quote_asset_type", "token_program_type", "first_seen_source")],
        *[F.char_length(v).alias(f"{c}_length") for c, v in t.items()],
        *[(v == "").alias(f"has_empty_{c}") for c, v in t.items()],
        *[distinct_ratio(v).alias(f"{c}_entropy") for c, v in t.items()],
        *[f"duplicate_{c}_seen_historically" for c in texts],
        F.greatest(*[non_ascii_ratio(v) for v in t.values()]).alias("suspicious_unicode_score"),
        uri_scheme(t["uri"]).alias("uri_scheme"),
    )


def creator(launches: DataFrame, clusters: DataFrame | None = None, hour_us: int = 3_600_000_000, wave: int = 3) -> DataFrame:
    """F2, 7 columns, at observed_us, which no launch is later than; launches: mint, creator, payer, uri, launch_us, observed_us; clusters: (wallet, cluster)."""
    host = uri_host(F.col("uri"))
    x = A.count_alike(launches.withColumn("host", host), "host", "host_n")
    by, payer = Window.partitionBy("creator"), Window.partitionBy("creator", "payer")
    # launches in the hour before a row's own time of observation: a merge of times of both kinds, counted in order
    t = x.select("creator", F.col("launch_us").alias("t"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("mint"), F.lit(1).alias("kind"))
    asks = x.where("observed_us is not null").select("creator", F.explode(F.array(F.struct((F.col("observed_us") - hour_us).alias("t"), F.lit(0).alias("kind")), F.struct(F.col("observed_us").alias("t"), F.lit(2).alias("kind")))).alias("a"), "mint").select("creator", "a.t", F.lit(0).alias("n"), "mint", "a.kind")
    upto = Window.partitionBy("creator").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counts = t.select("creator", "t", "n", "mint", "kind").union(asks).withColumn("c", F.sum("n").over(upto)).where("mint is not null").groupBy("mint").agg((F.max("c") - F.min("c")).alias("creator_launches_last_1h"))
    first = F.min("launch_us").over(by)
    out = x.withColumn("first_us", first).withColumns({
        "creator_age_in_local_index": F.expr("greatest(0, (observed_us - first_us) div 1000000)"),
        "creator_total_launches_seen": F.count(F.lit(1)).over(by),
        "creator_reuses_same_payer": F.count(F.lit(1)).over(payer) > 1,
        "creator_reuses_same_metadata_domain": F.col("host_n") > 1,
    })
    out = out.join(counts, "mint", "left")
    out = out.join(clusters.select(F.col("wallet").alias("creator"), F.col("cluster").alias("creator_cluster_id")), "creator", "left") if clusters is not None else out.withColumn("creator_cluster_id", F.lit(None).cast("string"))
    out = out.withColumn("creator_launching_spam_wave_flag", F.col("creator_launches_last_1h") >= wave)
    return out.select("mint", "creator_age_in_local_index", "creator_total_launches_seen", "creator_launches_last_1h", "creator_cluster_id", "creator_reuses_same_payer", "creator_reuses_same_metadata_domain", "creator_launching_spam_wave_flag")


def developer(state: DataFrame) -> DataFrame:
    """F3, 24 columns. state: mint, launch_us, observed_us, initial, owner_balance (NULL if no balance row), net_tokens, net_quote, first_sell_us, sold_share, rank, circulating.

    Amounts after a time are those of now, shown once that time has passed. A balance above the supply fails and leaves its shares NULL.
    """
    balance = F.greatest(F.coalesce("owner_balance", "net_tokens"), F.lit(0.0))
    x = state.withColumn("dev_balance", balance).withColumn("ok", F.col("dev_balance") <= SUPPLY)
    total = F.when(F.col("ok"), F.col("dev_balance") / SUPPLY)
    past = lambda s: F.coalesce(F.col("observed_us") >= F.col("launch_us") + s * 1_000_000, F.lit(False))
    after = {f"creator_net_{n}_after_{name}": F.when(past(s), F.col(c)) for n, c in (("tokens", "net_tokens"), ("quote_flow", "net_quote")) for name, s in (("10s", 10), ("30s", 30), ("1m", 60), ("5m", 300))}
    top = {f"creator_is_top{n}_holder": F.coalesce(F.col("rank") <= n, F.lit(False)) for n in (1, 3, 5, 10)}
    return x.select(
        "mint",
        F.col("initial").alias("creator_initial_token_balance"),
        "dev_balance",
        F.when(F.col("initial") > 0, clamp01(F.col("dev_balance") / F.col("initial"))).alias("creator_retained_supply_pct"),
        total.alias("dev_holding_pct_total_supply"),
        total.alias("dev_holding_pct_curve_economic_supply"),
        F.when(F.col("ok") & (F.col("circulating") > 0), F.col("dev_balance") / F.col("circulating")).alias("dev_holding_pct_circulating"),
        total.alias("creator_ownership_pct"),
        F.when(F.col("ok"), HOLDER_SUPPLY).alias("token_supply_selected_for_holder_pct"),
        *[c.alias(n) for n, c in after.items()],
        F.col("first_sell_us").isNotNull().alias("creator_has_sold"),
        F.when(F.col("first_sell_us").isNotNull() & F.col("launch_us").isNotNull(), F.greatest(F.lit(0), F.expr("(first_sell_us - launch_us) div 1000"))).alias("creator_first_sell_time_ms"),
        F.coalesce("sold_share", F.lit(0.0)).alias("creator_dump_velocity"),
        F.col("rank").alias("creator_balance_rank"),
        *[c.alias(n) for n, c in top.items()],
    )


def curve(rows: DataFrame) -> DataFrame:
    """F4, 26 columns, of each mint's latest curve row.

    rows: mint, virtual_quote, virtual_token, real_quote, real_token, token_decimals, price_raw, price, price_confidence, latest_price, launch_price, cap_1b, cap_total,
    cap_confidence, complete, progress, completion, progress_confidence, updated_us, observed_us, top1_share, dev_sold.
    """
    k = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    depth = clamp01((k("real_quote") + k("virtual_quote")) / 100)
    return rows.select(
        "mint",
        F.col("virtual_quote").alias("virtual_quote_reserves"),
        F.col("virtual_token").alias("virtual_token_reserves"),
        F.col("real_quote").alias("real_quote_reserves"),
        F.col("real_token").alias("real_token_reserves"),
        "token_decimals",
        F.col("price_raw").alias("price_lamports_per_raw_token"),
        F.col("price").alias("price_sol_per_token"),
        F.col("price_confidence").alias("reserve_price_confidence"),
        F.coalesce("price", "latest_price").alias("price_current"),
        F.col("launch_price").alias("price_launch"),
        F.when(F.col("launch_price") > 0, (F.col("latest_price") - F.col("launch_price")) / F.col("launch_price")).alias("price_change_from_launch_pct"),
        F.col("cap_1b").alias("market_cap_quote_1b"),
        F.coalesce("cap_total", F.col("price") * SUPPLY).alias("market_cap_quote_total_supply"),
        F.lit(SUPPLY).cast("double").alias("token_supply_curve_economic_ui"),
        F.lit(SUPPLY).cast("double").alias("token_supply_protocol_constant_ui"),
        F.lit(HOLDER_SUPPLY).alias("token_supply_selected_for_market_cap"),
        F.lit(PROGRESS_SUPPLY).alias("token_supply_selected_for_curve_progress"),
        F.lit(SUPPLY_POLICY).alias("supply_denominator_policy_version"),
        F.col("cap_confidence").alias("market_cap_confidence"),
        F.col("complete").alias("curve_complete_flag"),
        F.col("progress").alias("curve_progress_pct"),
        F.coalesce("progress", "completion").alias("curve_completion_pct"),
        F.col("progress_confidence").alias("curve_progress_confidence"),
        F.when(F.col("updated_us").isNotNull(), F.greatest(F.lit(0), F.expr("(observed_us - updated_us) div 1000"))).alias("curve_staleness_ms"),
        depth.alias("quote_asset_specific_depth_score"),
        clamp01(depth * (1 - k("top1_share")) * (1 - k("dev_sold"))).alias("quote_asset_specific_curve_health"),
    )


def fee_competition(trades: DataFrame, returns: DataFrame) -> DataFrame:
    """F18, 11 columns. trades: mint, side, us, seq, quote, priority_fee and base_fee in lamports (NULL where not seen); returns: (mint, return_pct_30s)."""
    known = trades.where("priority_fee is not null").withColumn("fee", F.col("priority_fee").cast("double"))
    ranked = trades.where("side = 'buy'").withColumn("r", F.row_number().over(Window.partitionBy("mint").orderBy("us", "seq"))).where("r <= 8 and priority_fee is not null").withColumn("fee", F.col("priority_fee").cast("double"))
    p = A.percentiles(known, ["mint"], "fee", [50, 90]).select("mint", F.col("p50").alias("all"), F.col("p90").alias("high"))
    one = lambda df, name: A.percentiles(df, ["mint"], "fee", [50]).select("mint", F.col("p50").alias(name))
    x = trades.groupBy("mint").agg(F.sum("quote").alias("notional"), F.sum(F.coalesce("priority_fee", F.lit(0)) + F.coalesce("base_fee", F.lit(0))).alias("paid"))
    for part in (p, one(known.where("side = 'buy'"), "buy"), one(known.where("side = 'sell'"), "sell"), one(ranked, "first"), returns):
        x = x.join(part, "mint", "left")
    war = clamp01(F.coalesce("high", F.lit(0.0)) / 10_000)
    move = F.when(F.col("notional") > 0, F.col("paid") / 1_000_000_000 / F.col("notional")).otherwise(F.lit(0.0))
    edge = F.coalesce("return_pct_30s", F.lit(0.0)) - move
    return x.select(
        "mint",
        F.col("all").alias("launch_priority_fee_median"),
        F.col("high").alias("launch_priority_fee_p90"),
        F.col("buy").alias("pump_buy_priority_fee_median"),
        F.col("sell").alias("pump_sell_priority_fee_median"),
        F.col("first").alias("first_buyers_priority_fee_median"),
        F.coalesce((F.col("all") > 0) & (F.col("high") / F.nullif(F.col("all"), F.lit(0.0)) >= 2), F.lit(False)).alias("priority_fee_spike_near_launch"),
        F.col("all").alias("our_required_priority_fee_estimate"),
        war.alias("fee_war_score"),
        move.alias("minimum_move_to_cover_observed_fees"),
        edge.alias("edge_minus_fee_war_cost"),
        ((war >= 0.5) & (edge <= 0)).alias("high_fee_low_edge_warning"),
    )


def execution(rows: DataFrame) -> DataFrame:
    """F19, 8 columns; the first two are registered and never set. rows: mint, first_seen_source, launch_slot, trades, latest_price, history_price, organic_flow_score, rug_probability_score."""
    k = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return rows.select(
        "mint",
        F.lit(None).cast("long").alias("first_seen_by_shred_ns"),
        F.lit(None).cast("double").alias("shred_lead_time_ms"),
        F.coalesce(F.col("first_seen_source").isin("ShredTentative", "DeshredTentative"), F.lit(False)).alias("token_signal_available_before_geyser_flag"),
        F.coalesce("launch_slot", F.lit(0)).cast("long").alias("slot_id"),
        clamp01(k("trades") / 50).alias("competition_intensity_score"),
        F.when(F.col("history_price").isNotNull(), F.col("latest_price") - F.col("history_price")).otherwise(F.lit(0.0)).alias("counterfactual_buy_after_100ms_pnl"),
        clamp01(k("organic_flow_score") - k("rug_probability_score")).alias("latency_adjusted_trade_eligibility"),
    )


def data_quality(features: DataFrame, gap: str = "gap", tentative: str = "tentative", source: str = "first_seen_source", critical: tuple[str, ...] = ("price_current", "buy_volume_quote", "holder_count_current", "bundle_risk_score", "rug_probability_score")) -> DataFrame:
    """F20, 7 columns, over the other columns of features but mint, the two flags and the source."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    cols = [c for c in features.columns if c not in ("mint", gap, tentative, source)]
    add = lambda cs: sum((c for c in cs[1:]), cs[0])
    there = add([F.col(c).isNotNull().cast("int") for c in cols]) / len(cols)
    missing = add([F.col(c).isNull().cast("int") for c in critical])
    x = features.withColumns({"there": there, "missing": missing})
    quality = clamp01(F.col("there") - F.col("missing") / 10 - F.when(flag(tentative), 0.2).otherwise(0.0) - F.when(flag(gap), 0.5).otherwise(0.0))
    return x.select(
        "mint",
        F.lit(True).alias("geyser_connected_flag"),
        F.coalesce(F.col(source).isin("ShredTentative", "DeshredTentative"), F.lit(False)).alias("shred_connected_flag"),
        (flag(gap) | flag(tentative)).alias("source_disagreement_flag"),
        F.col("missing").cast("long").alias("critical_feature_missing_count"),
        F.col("there").alias("feature_completeness_pct"),
        quality.alias("data_quality_score"),
        ((quality >= 0.5) & ~flag(gap)).alias("trade_allowed_data_quality_flag"),
    )


def placeholders(rows: DataFrame, key: str = "mint") -> DataFrame:
    """(key, feature, status) of the 24 groups that are always unavailable; no value is made up."""
    return rows.select(key, F.explode(F.array(*[F.lit(p) for p in PLACEHOLDERS])).alias("feature"), F.lit("unavailable").alias("status"))


def price_path(trades: DataFrame, starts: DataFrame) -> DataFrame:
    """W6, part of F5: drawdowns from the high and from launch, and the time below the launch price; starts: (mint, start_us, start_price)."""
    upto = W._w("mint").rowsBetween(Window.unboundedPreceding, 0)
    x = trades.join(starts, "mint").where("us >= start_us").withColumns({"run": F.max("price").over(upto), "next_us": F.lead("us").over(W._w("mint"))})
    below = F.when((F.col("price") < F.col("start_price")) & F.col("next_us").isNotNull(), F.col("next_us") - F.col("us")).otherwise(F.lit(0))
    last = F.max_by("price", F.struct("us", "seq"))
    return x.groupBy("mint").agg(
        F.max(quotient(F.col("run") - F.col("price"), F.col("run"))).alias("max_drawdown"),
        (1 - quotient(last, F.max("price"))).alias("drawdown_from_ath"),
        F.when(F.min("start_price") > 0, F.greatest(F.lit(0.0), (F.min("start_price") - last) / F.min("start_price"))).alias("drawdown_from_launch"),
        F.sum(below).alias("below_launch_us"),
    )


WINDOWS = {"30s": 30, "1m": 60, "5m": 300}


def price_columns(trades: DataFrame, anchors: DataFrame, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """F5, 14 columns, at each mint's observed_us; anchors: mint, observed_us, launch_us, launch_price; windows: seconds by name (volatility of the first two, velocity of the first)."""
    order = Window.partitionBy("mint").orderBy("us", "seq")
    x = trades.join(anchors, "mint").where("us <= observed_us").withColumns({"p0": F.lag("price").over(order), "u0": F.lag("us").over(order), "run": F.max("price").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    price, at = F.col("price"), F.struct("us", "seq")
    since = lambda s: F.col("us") >= F.col("observed_us") - s * 1_000_000
    first = {n: F.min_by(F.when(since(s), F.struct("price", "us")), F.when(since(s), at)).alias(f"first_{n}") for n, s in windows.items()}
    names = list(windows)
    moves = {n: F.avg(F.when((F.col("u0") >= F.col("observed_us") - windows[n] * 1_000_000) & (F.col("p0") > 0), F.abs((price - F.col("p0")) / F.col("p0")))).alias(f"realized_volatility_{n}") for n in names[:2]}
    y = x.groupBy("mint", "observed_us", "launch_us", "launch_price").agg(
        F.max("price").alias("price_high"), F.min("price").alias("price_low"), F.max_by("price", at).alias("latest"), F.min_by("us", F.struct((-price).alias("p"), "us", "seq")).alias("ath_us"),
        F.count_if((price > 0) & (price > F.coalesce("run", F.lit(0.0)))).alias("new_ath_frequency"), F.avg((price < F.col("launch_price")).cast("double")).alias("below"), F.bool_or(F.col("side") == "sell").alias("sold"), *first.values(), *moves.values(),
    )
    latest, high, launch = F.col("latest"), F.col("price_high"), F.col("launch_price")
    v = names[0]
    elapsed = F.expr(f"(observed_us - first_{v}.us) div 1000")
    return y.select(
        "mint", "price_high", "price_low", F.when(high > 0, (high - latest) / high).alias("drawdown_from_ath_pct"), F.when(launch > 0, F.greatest(launch - latest, F.lit(0.0)) / launch).alias("drawdown_from_launch_pct"),
        *[F.when(F.col(f"first_{n}.price") > 0, (latest - F.col(f"first_{n}.price")) / F.col(f"first_{n}.price")).alias(f"return_pct_{n}") for n in names], *[f"realized_volatility_{n}" for n in names[:2]],
        F.when(elapsed > 0, (latest - F.col(f"first_{v}.price")) / elapsed).alias(f"price_velocity_{v}"), F.when(F.col("launch_us").isNotNull(), F.greatest(F.lit(0), F.expr("(ath_us - launch_us) div 1000"))).alias("time_to_ath_ms"),
        F.when(launch > 0, F.col("below")).otherwise(F.lit(0.0)).alias("time_below_launch_price_pct"), "new_ath_frequency", F.when((high > 0) & F.col("sold"), F.greatest(high - latest, F.lit(0.0))).alias("post_ath_selloff_velocity"),
    )


def flow_columns(trades: DataFrame, shares: DataFrame) -> DataFrame:
    """F6, 20 columns; shares: mint, top5_share, dev_sold (missing counts as 0). Medians and p90 are lower ranks."""
    s = A.trade_stats(trades)
    big = trades.groupBy("mint").agg(F.max(F.when(F.col("side") == "buy", F.col("quote"))).alias("largest_buy_quote"), F.max(F.when(F.col("side") == "sell", F.col("quote"))).alias("largest_sell_quote"))
    x = s.join(big, "mint")
    for side in ("buy", "sell"):
        x = x.join(A.percentiles(trades.where(F.col("side") == side), ["mint"], "quote", [50, 90]).select("mint", F.col("p50").alias(f"median_{side}_size_quote"), F.col("p90").alias(f"p90_{side}_size_quote")), "mint", "left")
    ten = W.first_trades(trades, 10).groupBy("mint").agg(F.avg((F.col("side") == "buy").cast("double")).alias("first_10_trades_buy_ratio"))
    gap = W.price_path(trades).select("mint", F.expr("coalesce(longest_gap_us, 0) div 1000").alias("no_buy_gap_longest_ms"))
    x = x.join(ten, "mint", "left").join(gap, "mint", "left").join(shares, "mint", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    breadth = F.when(F.col("buys") > 0, F.col("unique_buyers") / F.col("buys")).otherwise(F.lit(0.0))
    organic = clamp01(breadth * clamp01(1 - zero("top5_share")))
    return x.select(
        "mint", F.col("buys").alias("buy_count"), F.col("sells").alias("sell_count"), (F.col("buys") + F.col("sells")).alias("trade_count"), "unique_buyers", "unique_sellers", F.col("buy_volume").alias("buy_volume_quote"), F.col("sell_volume").alias("sell_volume_quote"), (F.col("buy_volume") - F.col("sell_volume")).alias("net_flow_quote"),
        F.when(F.col("sells") > 0, F.col("buys") / F.col("sells")).alias("buy_sell_count_ratio"), F.when(F.col("sell_volume") > 0, F.col("buy_volume") / F.col("sell_volume")).alias("buy_sell_volume_ratio"), "largest_buy_quote", "largest_sell_quote", "median_buy_size_quote", "median_sell_size_quote", "p90_buy_size_quote", "p90_sell_size_quote",
        "first_10_trades_buy_ratio", "no_buy_gap_longest_ms", organic.alias("organic_flow_score"), clamp01(1 - organic + zero("dev_sold")).alias("toxic_flow_score"),
    )


COUNTERS = ["holder_updates_seen", "holder_updates_applied", "holder_updates_deduped", "holder_owner_changes", "holder_missing_owner_mapping", "holder_fallback_trade_updates_used"]


def holder_columns(held: DataFrame, context: DataFrame, supply: float = SUPPLY) -> DataFrame:
    """F7 (32 columns) and F8 (5). held: mint, wallet, balance in whole tokens; only positive balances count.

    context, one row a mint: creator, curve, associated_curve (wallets to leave out), reliable, net_tokens, creator_sold, growth, missing_owners and the six counters. What needs a supply is NULL unless
    the context is reliable and what is observed doesn't exceed it.
    """
    own = held.where("balance > 0")
    c = A.concentration(own)
    p = A.percentiles(own, ["mint"], "balance", [50, 90]).select("mint", F.col("p50").alias("median_holder_balance"), F.col("p90").alias("p90_holder_balance"))
    x = own.join(context.select("mint", "creator", "curve", "associated_curve"), "mint")
    same = lambda n: F.coalesce(F.col("wallet") == F.col(n), F.lit(False))
    on_curve = same("curve") | same("associated_curve")
    place = Window.partitionBy("mint").orderBy(F.desc("balance"), "wallet")
    x = x.withColumns({"share": F.col("balance") / F.sum("balance").over(Window.partitionBy("mint")), "r": F.row_number().over(place)})
    whale = (F.col("share") >= 0.1) & (F.col("r") <= 20)
    counts = x.groupBy("mint").agg(
        F.count_if(~on_curve).alias("holder_count_excluding_curve"), F.count_if(~on_curve & ~same("creator")).alias("holder_count_excluding_curve_and_dev"), F.max(F.when(~on_curve, F.col("balance"))).alias("first"), F.max(F.when(same("creator"), F.col("balance"))).alias("dev"),
        F.count_if(whale).alias("whale_count"), F.coalesce(F.sum(F.when(whale, F.col("share"))), F.lit(0.0)).alias("whale_holding_pct"), F.coalesce(F.bool_or(F.when(F.col("r") == 1, same("creator"))), F.lit(False)).alias("top1_is_creator"),
    )
    y = context.join(c, "mint", "left").join(p, "mint", "left").join(counts, "mint", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    n = F.coalesce("holders", F.lit(0))
    reliable = F.coalesce("reliable", F.lit(False))
    circulating = F.greatest(F.lit(float(supply)) - F.greatest(F.coalesce("dev", "net_tokens", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    good = reliable & (zero("supply") <= supply + 1e-6)
    top = {k: zero(f"top{k}_pct") / 100 for k in (1, 3, 5, 10, 20)}
    of_total, of_rest = zero("first") / supply, F.when(circulating > 0, zero("first") / circulating).otherwise(F.lit(0.0))
    diverse = clamp01(F.greatest(n, F.lit(1)) / 5)
    risk = clamp01(0.45 * clamp01((top[1] - 0.30) / 0.40) + 0.30 * clamp01((top[5] - 0.75) / 0.25) * diverse + 0.15 * zero("creator_sold") + 0.10 * zero("gini"))
    zeroed = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return y.select(
        "mint", n.alias("holder_count_current"), n.alias("holders_with_nonzero_balance"), n.alias("holder_count_owner_wallets"), *[zeroed(k) for k in COUNTERS], zeroed("holder_count_excluding_curve"), zeroed("holder_count_excluding_curve_and_dev"),
        F.when(good, zero("supply")).alias("observed_holder_supply"), F.when(reliable, circulating).alias("circulating_holder_supply"), F.col("growth").alias("holder_growth_rate"), F.when(F.col("growth").isNotNull(), clamp01(F.col("growth"))).alias("sustained_holder_growth_score"),
        F.when(n > 0, F.col("supply") / n).alias("average_holder_balance"), "median_holder_balance", "p90_holder_balance", zero("gini").alias("holder_balance_gini"), zero("hhi").alias("holder_balance_hhi"), top[1].alias("top1_holder_pct"), top[1].alias("top1_holder_pct_observed"),
        F.when(good, of_total).alias("top1_holder_pct_total_supply"), F.when(good, of_total).alias("top1_holder_pct_curve_economic_supply"), F.when(good & (of_rest <= 1 + 1e-6), of_rest).alias("top1_holder_pct_circulating"), F.when(good, HOLDER_SUPPLY).alias("token_supply_selected_for_holder_pct"),
        *[top[k].alias(f"top{k}_holder_pct") for k in (3, 5, 10, 20)], F.when(~reliable, 0.3).when(F.coalesce("missing_owners", F.lit(0)) == 0, 0.9).otherwise(0.5).alias("holder_metric_confidence"), zeroed("missing_owners").alias("missing_owner_mapping_count"),
        (clamp01(1 - top[5] + F.greatest(zero("gini"), F.lit(0.0))) / 2).alias("holder_distribution_improvement_score"), zeroed("whale_count"), F.coalesce("whale_holding_pct", F.lit(0.0)).alias("whale_holding_pct"), F.coalesce("top1_is_creator", F.lit(False)).alias("top1_is_creator"), risk.alias("concentration_risk_score"), (top[1] >= 0.55).alias("one_wallet_controls_market_flag"),
    )


def rug_columns(rows: DataFrame) -> DataFrame:
    """F10, 9 columns. rows: mint, first_sell_us, sold_share, drawdown_from_ath_pct, drawdown_from_launch_pct, launch_us, observed_us, growth, buy_volume, sell_volume, last_buy_us, top1_share, trades."""
    k = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    early = F.coalesce(F.col("observed_us") <= F.col("launch_us") + 300_000_000, F.lit(False))
    fell = early & (k("drawdown_from_launch_pct") >= 0.7)
    quiet = F.coalesce(F.col("observed_us") - F.col("last_buy_us") >= 20_000_000, F.lit(True))
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    return rows.select(
        "mint", F.col("first_sell_us").isNotNull().alias("dev_sold_flag"), k("sold_share").alias("dev_sold_pct"), (k("drawdown_from_ath_pct") >= 0.5).alias("price_drop_50pct_from_ath"), fell.alias("price_drop_70pct_from_launch_within_5m"), F.coalesce(F.col("growth") <= 0, F.lit(False)).alias("holder_growth_stalled"),
        (k("sell_volume") > k("buy_volume")).alias("sells_dominate_after_launch"), quiet.alias("no_buys_for_x_seconds"), clamp01(k("sold_share") + one(quiet, 0.3) + one(fell, 0.6) + one(k("top1_share") >= 0.35, 0.2)).alias("rug_probability_score"), clamp01(F.least(k("trades"), F.lit(20.0)) / 20).alias("rug_confidence"),
    )


def rotation_columns(trades: DataFrame) -> DataFrame:
    """F12, 4 columns: wallets that bought a mint and sold others, what they sold there, their part of all wallets, and whether that is more than was sold here."""
    own = trades.groupBy("mint", "wallet").agg(F.count_if(F.col("side") == "buy").alias("buys"), F.coalesce(F.sum(F.when(F.col("side") == "sell", F.col("tokens"))), F.lit(0.0)).alias("sold"))
    total = own.groupBy("wallet").agg(F.sum("sold").alias("all_sold"))
    wallets = own.agg(F.count_distinct("wallet").alias("wallets"))
    x = own.join(total, "wallet").withColumn("elsewhere", F.when((F.col("buys") > 0) & (F.col("all_sold") > F.col("sold")), F.col("all_sold") - F.col("sold")))
    here = trades.groupBy("mint").agg(F.coalesce(F.sum(F.when(F.col("side") == "sell", F.col("quote"))), F.lit(0.0)).alias("sell_volume"))
    y = x.groupBy("mint").agg(F.count("elsewhere").alias("n"), F.coalesce(F.sum("elsewhere"), F.lit(0.0)).alias("moved")).join(here, "mint").join(F.broadcast(wallets))  # wallets is one row
    return y.select("mint", F.col("n").alias("wallets_sold_other_token_then_bought_this_count"), F.col("moved").alias("net_capital_rotated_into_this_from_other_launches"), clamp01(F.col("n") / F.greatest("wallets", F.lit(1))).alias("smart_capital_rotation_score"), ((F.col("n") > 0) & (F.col("moved") > F.col("sell_volume"))).alias("this_token_becoming_primary_capital_destination_flag"))


def cost_columns(positions: DataFrame, volumes: DataFrame) -> DataFrame:
    """F13, 15 columns. positions: mint, wallet, held, realised, unrealised, taken_profit, round_trip; volumes: (mint, sell_volume)."""
    x = positions.withColumns({"held": F.greatest("held", F.lit(0.0)), "r": F.row_number().over(Window.partitionBy("mint").orderBy(F.desc("held"), "wallet")), "share": F.greatest("held", F.lit(0.0)) / F.nullif(F.sum(F.greatest("held", F.lit(0.0))).over(Window.partitionBy("mint")), F.lit(0.0))})
    held, pnl = F.col("held"), F.col("unrealised")
    part = lambda c: F.when(F.sum("held") > 0, F.coalesce(F.sum(F.when(c, held)), F.lit(0.0)) / F.sum("held"))
    top = lambda c, n: F.coalesce(F.sum(F.when((F.col("r") <= n) & (held > 0), F.col(c))), F.lit(0.0))
    y = x.groupBy("mint").agg(
        F.avg(pnl).alias("holder_unrealized_pnl_mean"), part(pnl > 0).alias("unrealized_profit_supply_pct"), part(pnl < 0).alias("underwater_supply_pct"), part(F.abs(pnl) <= 0.0001).alias("breakeven_supply_pct"), part(F.col("taken_profit")).alias("free_rolling_supply_pct"), top("unrealised", 5).alias("top5_unrealized_pnl"), top("unrealised", 10).alias("top10_unrealized_pnl"),
        (F.sum(F.greatest("realised", F.lit(0.0))) / F.nullif(F.sum(F.abs("realised")), F.lit(0.0))).alias("realized_profit_taking_rate"), F.count_if("taken_profit").alias("holders_taking_initials_out_count"), F.count_if("round_trip").alias("holders_fully_exiting_count"), top("share", 1).alias("t1"), top("share", 5).alias("t5"),
    )
    p = A.percentiles(positions, ["mint"], "unrealised", [50, 90]).select("mint", F.col("p50").alias("holder_unrealized_pnl_median"), F.col("p90").alias("holder_unrealized_pnl_p90"))
    z = y.join(p, "mint", "left").join(volumes, "mint", "left")
    k = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    over = clamp01(0.35 * k("unrealized_profit_supply_pct") + 0.35 * k("free_rolling_supply_pct") + 0.15 * clamp01((F.col("t1") - 0.45) / 0.55) + 0.15 * clamp01((F.col("t5") - 0.80) / 0.20))
    return z.select(
        "mint", "holder_unrealized_pnl_mean", "holder_unrealized_pnl_median", "holder_unrealized_pnl_p90", "unrealized_profit_supply_pct", "underwater_supply_pct", "breakeven_supply_pct", "free_rolling_supply_pct", "top5_unrealized_pnl", "top10_unrealized_pnl", "realized_profit_taking_rate",
        over.alias("profit_overhang_score"), clamp01(k("underwater_supply_pct") + k("sell_volume") / 100).alias("underwater_capitulation_risk"), clamp01(k("free_rolling_supply_pct") + F.col("t5") / 2).alias("free_roll_dump_risk_score"), "holders_taking_initials_out_count", "holders_fully_exiting_count",
    )


def _groups(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """(mint, <name>_max, <name>_n, <name>_groups): the largest group of equal values, all rows, and how many groups; rows with a NULL are out."""
    x = rows
    for c in columns:
        x = x.where(F.col(c).isNotNull())
    g = x.groupBy("mint", *columns).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("mint").agg(F.max("n").alias(f"{name}_max"), F.sum("n").alias(f"{name}_n"), F.count(F.lit(1)).alias(f"{name}_groups"))


def fingerprint_columns(trades: DataFrame, top: DataFrame) -> DataFrame:
    """F16, 17 columns. trades: mint, wallet, side, us, seq, compute_limit, compute_price, account_count, instruction_count, fingerprint (NULL where not seen); top: (mint, wallet) of the five largest holders."""
    from ..functions.math import bucket_index

    measures = ["compute_limit", "compute_price", "account_count", "instruction_count"]
    text = lambda *cols: F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    early = (F.col("side") == "buy") & (F.row_number().over(Window.partitionBy("mint", "side").orderBy("us", "seq")) <= 8)
    x = trades.withColumn("early", early).join(top.select("mint", "wallet").distinct().withColumn("on_top", F.lit(True)), ["mint", "wallet"], "left")
    # every value by the part that it counts in, so that one count and one order serve all parts
    parts = [*[(c, (c,), None) for c in measures], ("profile", ("compute_limit", "compute_price"), None), ("first", ("compute_limit", "compute_price"), "early"), ("client", ("fingerprint",), None), ("first_client", ("fingerprint",), "early"), ("top_client", ("fingerprint",), "on_top")]
    cells = []
    for name, cols, only in parts:
        there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("mint", *cols)] + ([F.col(only)] if only else []))
        cells.append(F.when(there, F.struct(F.lit(name).alias("part"), (F.col(cols[0]).cast("double") if name in measures else F.lit(None).cast("double")).alias("v"), text(*cols).alias("k"))))
    long = x.select("mint", F.explode(F.array_compact(F.array(F.struct(F.lit("all").alias("part"), F.lit(None).cast("double").alias("v"), F.lit("").alias("k")), *cells))).alias("c")).select("mint", "c.*")
    counts = long.groupBy("mint", "part", "v", "k").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("mint", "part")
    ranked = counts.withColumns({"upto": F.sum("n").over(by.orderBy("v", "k").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(by)})
    of = lambda name, f, c: f(F.when(F.col("part") == name, c))
    groups = {"profile": "profile", "first": "first", "sequence": "instruction_count", "pattern": "account_count", "client": "client", "first_client": "first_client", "top_client": "top_client"}
    x = ranked.groupBy("mint").agg(
        *[of(c, F.min, F.when(F.col("upto") > F.expr("((total - 1) * 50) div 100"), F.col("v"))).alias(c) for c in measures],
        *[of(p, f, F.col("n")).alias(f"{n}_{e}") for n, p in groups.items() for f, e in ((F.max, "max"), (F.sum, "n"), (F.count, "groups"))],
    )
    again = lambda n: F.greatest(F.coalesce(F.col(f"{n}_max"), F.lit(0)) - 1, F.lit(0)).cast("long")
    share = lambda n, of="max": F.coalesce(F.col(f"{n}_{of}") / F.col(f"{n}_n"), F.lit(0.0))
    return x.select(
        "mint", F.col("account_count").alias("tx_account_count"), F.col("instruction_count").alias("tx_instruction_count"), F.when(F.col("instruction_count").isNotNull(), 0.0).alias("tx_inner_instruction_count"), (F.col("compute_limit").isNotNull() | F.col("compute_price").isNotNull()).alias("compute_budget_instruction_present"),
        F.col("compute_limit").alias("compute_unit_limit"), bucket_index(F.col("compute_limit"), [100_000, 200_000, 400_000]).alias("compute_unit_limit_bucket"), F.col("compute_price").alias("compute_unit_price"), bucket_index(F.col("compute_price"), [1_000, 5_000, 10_000]).alias("compute_unit_price_bucket"),
        again("profile").alias("duplicate_compute_profile_count"), again("first").alias("duplicate_compute_profile_among_first_buyers"), again("sequence").alias("duplicate_instruction_sequence_count"), again("pattern").alias("duplicate_account_pattern_count"), share("client").alias("identical_client_fingerprint_score"),
        share("first_client").alias("first_buyers_same_client_fingerprint_pct"), share("top_client").alias("top_holders_same_client_fingerprint_pct"), share("client").alias("bot_family_dominance_score"), share("client", "groups").alias("bot_family_diversity_score"),
    )


def lifecycle_columns(holders: DataFrame, trades: DataFrame, context: DataFrame, windows: tuple[int, int] = (30, 60)) -> DataFrame:
    """F15, 15 columns, at each mint's observed_us. holders: mint, wallet, balance, first_seen_us; context: mint, observed_us, launch_us, hhi; windows: seconds of a new holder's survival."""
    age = F.greatest(F.lit(0), F.expr("(observed_us - first_seen_us) div 1000000")).cast("double")
    x = holders.join(context.select("mint", "observed_us"), "mint").withColumns({"age": F.when(F.col("first_seen_us").isNotNull(), age), "b": F.greatest("balance", F.lit(0.0)), "us_old": F.col("observed_us") - F.col("first_seen_us")})
    counts = {}
    for i, s in enumerate(windows):
        counts |= {f"new{i}": F.count_if(F.col("us_old") <= s * 1_000_000), f"old{i}": F.count_if(F.col("us_old") >= s * 1_000_000)}
    y = x.groupBy("mint").agg(F.avg("age").alias("holder_age_mean"), (F.sum(F.col("age") * F.col("b")) / F.nullif(F.sum("b"), F.lit(0.0))).alias("holder_age_weighted_by_balance"), F.count_if(F.col("b") > 0).alias("nonzero"), *[v.alias(k) for k, v in counts.items()])
    median = A.percentiles(x.where("age is not null"), ["mint"], "age", [50]).select("mint", F.col("p50").alias("holder_age_median"))
    z = context.join(y, "mint", "left").join(median, "mint", "left")
    for n in (10, 20):
        z = z.join(W.retention(trades, holders, n).withColumnRenamed("retention", f"r{n}"), "mint", "left")
    sold = trades.where("side = 'sell'").groupBy("mint").agg(F.count_distinct("wallet").alias("exited"))
    z = z.join(W.holding_times(trades).select("mint", F.col("mean_seconds").alias("average_time_to_first_sell_by_holder")), "mint", "left").join(sold, "mint", "left")
    k = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    lived = [over(k(f"old{i}"), F.greatest(k(f"new{i}"), k(f"old{i}"))) for i in range(2)]
    launch = F.coalesce(F.greatest(F.lit(0), F.expr("(observed_us - launch_us) div 1000000")).cast("double"), F.lit(0.0))
    launch = F.when(F.col("launch_us").isNotNull(), launch).otherwise(F.lit(0.0))
    sticky = clamp01(0.5 * k("r20") + 0.25 * lived[0] + 0.25 * (1 - k("hhi")))
    return z.select(
        "mint", "holder_age_mean", "holder_age_median", "holder_age_weighted_by_balance", lived[0].alias("new_holder_survival_30s"), lived[1].alias("new_holder_survival_1m"), k("r10").alias("first_10_buyers_retention"), k("r20").alias("first_20_buyers_retention"), "average_time_to_first_sell_by_holder",
        (launch * (1 - k("r20"))).alias("holder_half_life"), (1 - k("r20")).alias("holder_decay_rate"), sticky.alias("holder_stickiness_score"), (1 - sticky).alias("holder_paper_hands_score"), clamp01(k("new0") / F.greatest(k("exited"), F.lit(1.0))).alias("healthy_churn_score"), clamp01(k("exited") / F.greatest(k("new0"), F.lit(1.0))).alias("unhealthy_churn_score"),
        clamp01(k("new0") / F.greatest(k("nonzero"), F.lit(1.0))).alias("new_holders_replacing_old_holders_score"),
    )


def funding_columns(launches: DataFrame, edges: DataFrame, buyers: DataFrame, top: DataFrame, wallets: int) -> DataFrame:
    """F17, 14 columns. launches: mint, creator, launch_us, observed_us; edges: funder, wallet, amount, us (one a pair: its last); buyers: (mint, wallet, place) of the first eight buys; top: (mint, wallet) of five holders.

    wallets: how many are known at all. A wallet's funder is that of its latest edge (ties by name).
    """
    latest = edges.groupBy("wallet").agg(F.max_by(F.struct("funder", F.col("us").alias("f_us")), F.struct("us", "funder")).alias("f")).select("wallet", "f.*")
    mine = launches.join(latest.withColumnRenamed("wallet", "creator"), "creator", "left")
    b = buyers.join(latest, "wallet", "left").join(mine.select("mint", "launch_us", "observed_us", F.col("funder").alias("creator_funder")), "mint")
    first = b.groupBy("mint").agg(
        F.count_if(F.col("funder") == F.col("creator_funder")).alias("overlap"), F.count("funder").alias("n"), F.min_by("f_us", "place").alias("first_f_us"), F.count_if(F.col("observed_us") - F.col("f_us") <= 60_000_000).alias("just"),
    )
    one = lambda df, name: _groups(df.join(latest, "wallet"), name, "funder").select("mint", (F.col(f"{name}_max") / F.col(f"{name}_n")).alias(name))
    many = mine.where("funder is not null").groupBy("funder").agg(F.count(F.lit(1)).alias("launched"))
    funded = edges.groupBy("funder").agg(F.count(F.lit(1)).alias("funded"))
    rounded = F.round("amount", 4).alias("a")
    amounts = edges.groupBy("funder", rounded).agg(F.count(F.lit(1)).alias("m")).groupBy("funder").agg(F.max("m").alias("same"), F.sum("m").alias("all"))
    anyone = edges.groupBy(rounded).agg(F.count(F.lit(1)).alias("m")).agg((F.max("m") / F.sum("m")).alias("of_all"))
    total = edges.agg(F.count(F.lit(1)).alias("edges"))
    # funding in the five minutes before each launch: edges and launches in order of time, counted once
    marks = edges.select(F.col("us").alias("t"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("mint"))
    asks = launches.where("launch_us is not null").select(F.explode(F.array(F.struct((F.col("launch_us") - 300_000_000).alias("t"), F.lit(0).alias("k")), F.struct(F.col("launch_us").alias("t"), F.lit(2).alias("k")))).alias("a"), "mint").select("a.t", "a.k", "mint")
    both = marks.union(asks).withColumn("day", F.expr("t div 86400000000"))
    before = both.where("k = 1").groupBy("day").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.expr("coalesce(sum(c) over (order by day rows between unbounded preceding and 1 preceding), 0)"))  # one row a day
    days = both.select("day").distinct().join(before, "day", "left").withColumn("before", F.expr("coalesce(before, max(before + c) over (order by day rows between unbounded preceding and 1 preceding), 0)")).select("day", "before")
    counted = both.join(F.broadcast(days), "day").withColumn("c", F.col("before") + F.sum((F.col("k") == 1).cast("long")).over(Window.partitionBy("day").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0)))
    burst = counted.where("mint is not null").groupBy("mint").agg((F.max("c") - F.min("c")).alias("burst"))
    x = mine.join(first, "mint", "left").join(one(buyers, "fs"), "mint", "left").join(one(top, "ts"), "mint", "left").join(many, "funder", "left").join(funded, "funder", "left").join(amounts, "funder", "left").join(burst, "mint", "left").join(F.broadcast(total)).join(F.broadcast(anyone))  # total and anyone are one row each
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    dense = clamp01(F.col("edges") / F.lit(float(max(1, wallets) ** 2)) * 10)
    suspicion = clamp01(z("fs") + z("ts") + dense) / 3
    age = lambda us: F.expr(f"abs(launch_us - {us}) div 1000000")
    return x.select(
        "mint", F.col("funder").alias("creator_recent_funder"), age("f_us").alias("funder_to_creator_edge_age"), z("overlap").cast("long").alias("buyer_recent_funder_overlap_count"), z("fs").cast("double").alias("first_buyers_same_funder_pct"), z("ts").cast("double").alias("top_holders_same_funder_pct"), F.when(F.col("n") > 0, age("first_f_us")).alias("funder_to_buyer_edge_age"),
        F.when(F.col("funder").isNotNull(), z("launched")).alias("funder_to_multiple_launches_count"), F.coalesce(F.when(F.col("funder").isNotNull(), F.col("same") / F.col("all")).otherwise(F.col("of_all")), F.lit(0.0)).alias("same_funder_same_amount_pattern"), z("burst").cast("long").alias("funding_burst_before_launch"), z("just").cast("long").alias("wallets_funded_just_before_buy_count"), z("funded").cast("long").alias("fresh_wallets_funded_by_known_factory"),
        dense.alias("funding_graph_density"), suspicion.alias("funding_graph_suspicion_score"), (1 - suspicion).alias("funding_graph_quality_score"),
    )


def cohort_columns(tokens: DataFrame, seconds: tuple[int, int, int] = (30, 5, 15)) -> DataFrame:
    """F11, 22 columns. tokens: mint, launch_us, observed_us, lifecycle, unique_buyers and the measures buy_volume, net_flow, growth, price_return, growth_1m, return_1m, buy_volume_5s, buy_volume_15s (missing counts as 0).

    A cohort is what was launched within seconds[0] of a mint, and before its observed_us. Ranks fall with the measure, ties by mint. A token without a launch is a cohort of its own.
    """
    measures = ["buy_volume", "net_flow", "growth", "price_return", "growth_1m", "return_1m", "buy_volume_5s", "buy_volume_15s"]
    t = cut(tokens.select("mint", "launch_us", "observed_us", "lifecycle", F.coalesce("unique_buyers", F.lit(0)).cast("long").alias("unique_buyers"), *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in measures]), "tokens")
    launched, alone = t.where("launch_us is not null"), t.where("launch_us is null")
    places, found = C.stretches(launched, list(seconds), "observed_us")
    life = lambda *v: (F.col("lifecycle").isin(*v).cast("long"), "sum")
    parts = {"active": life("ActiveLight", "ActiveDeep", "TradeCandidate", "InPosition", "ExitPending"), "discarded": life("SoftDiscarded", "HardDiscarded"), "rugs": life("RugArchive"), "volume": (F.col("buy_volume"), "sum"), "best": (F.col("buy_volume"), "max"), "buyers": (F.col("unique_buyers"), "sum")}
    # (measure, band, kind) of each rank (from 1) and each share of the cohort that isn't above
    ranks = {"r1": ("buy_volume", 0), "r2": ("net_flow", 0), "r3": ("growth", 0), "r4": ("price_return", 0), "rank_0": ("buy_volume_5s", 1), "rank_1": ("buy_volume_15s", 2)}
    shares = {"p1": "buy_volume", "p2": "net_flow", "p3": "growth_1m", "p4": "return_1m"}
    # small cohorts by pairs
    rows = launched.select("mint", *measures, *[v.alias(k) for k, (v, _) in parts.items()])
    met, rest = C.pairs(rows, places, found, list(seconds))
    inside = lambda i: F.col(f"in_{seconds[i]}")
    above = lambda m: F.col(f"o_{m}") > F.col(m)
    before = lambda m: above(m) | ((F.col(f"o_{m}") == F.col(m)) & (F.col("o_mint") < F.col("mint")))
    x = met.groupBy("mint").agg(
        *[F.count_if(inside(i)).alias(n) for i, n in enumerate(("n", "__n1", "__n2"))], *[getattr(F, how)(F.when(inside(0), F.col(f"o_{k}"))).alias(k) for k, (_, how) in parts.items()],
        *[(F.count_if(inside(i) & before(m)) + 1).alias(k) for k, (m, i) in ranks.items()], *[F.count_if(inside(0) & above(m)).alias(k) for k, m in shares.items()],
    ).where("n > 0 and __n1 > 0 and __n2 > 0").drop("__n1", "__n2")
    # large ones by blocks
    rest = cut(rest, "rest")
    if not rest.isEmpty():
        long = launched.select("mint", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("score")) for m in measures])).alias("m")).select("mint", "m.*")
        wanted = [*[(m, seconds[i], "ahead") for m, i in ranks.values()], *[(m, seconds[0], "above") for m in shares.values()]]
        ahead = C.counts_ahead(long, places, rest, wanted)
        one = lambda m, i, kind: F.max(F.when((F.col("measure") == m) & (F.col("band") == seconds[i]) & (F.col("kind") == kind), F.col("n")))
        counts = ahead.groupBy("mint").agg(*[(one(m, i, "ahead") + 1).alias(k) for k, (m, i) in ranks.items()], *[one(m, 0, "above").alias(k) for k, m in shares.items()])
        wide = rest.where(F.col("band") == seconds[0])
        y = wide.select("mint", (F.col("hi") - F.col("lo")).alias("n")).join(C.totals(launched, places, wide, parts).drop("band"), "mint").join(counts, "mint")
        x = x.unionByName(y.where("rank_0 is not null and rank_1 is not null"))
    x = x.withColumns({p: 1 - F.col(p) / F.col("n") for p in shares})
    lone = alone.select("mint", F.lit(1).cast("long").alias("n"), *[v.alias(k) for k, (v, _) in parts.items()], *[F.lit(1).cast("long").alias(k) for k in ranks], *[F.lit(1.0).alias(k) for k in shares])
    x = x.unionByName(lone).join(t.select("mint", "buy_volume", "unique_buyers"), "mint")
    c = F.col
    strength = F.when(c("n") <= 1, 1.0).otherwise(clamp01(1 - (c("r1") + c("r2") + c("r3") + c("r4") - 4) / ((c("n") - 1) * 4)))
    velocity = c("rank_1") - c("rank_0")
    share = F.when(c("volume") > 0, c("buy_volume") / c("volume"))
    out = x.select(
        "mint", c("n").alias("cohort_launch_count"), c("active").alias("cohort_active_count"), (c("discarded") / c("n")).alias("cohort_discard_rate"), (c("rugs") / c("n")).alias("cohort_rug_rate"), c("r1").alias("token_rank_by_buy_volume_30s"), c("r2").alias("token_rank_by_net_flow_30s"), c("r3").alias("token_rank_by_holder_growth_30s"), c("r4").alias("token_rank_by_price_return_30s"),
        strength.alias("token_relative_strength_score"), (1 - strength).alias("token_relative_weakness_score"), share.alias("cohort_attention_share"), F.greatest(c("best") - c("buy_volume"), F.lit(0.0)).alias("best_launch_in_cohort_distance"), share.alias("this_token_share_of_all_launch_buy_volume"), F.when(c("buyers") > 0, c("unique_buyers") / c("buyers")).alias("this_token_share_of_all_unique_buyers"),
        c("p1").alias("token_percentile_buy_volume_30s"), c("p2").alias("token_percentile_net_flow_30s"), c("p3").alias("token_percentile_holder_growth_1m"), c("p4").alias("token_percentile_price_return_1m"), ((c("r1") == 1) & (c("r4") <= 2)).alias("token_is_cohort_leader_flag"), ((c("r1") == c("n")) & (c("r4") == c("n"))).alias("token_is_cohort_laggard_flag"),
        clamp01(F.greatest(-velocity, F.lit(0)).cast("double")).alias("token_improving_rank_velocity"), clamp01(F.greatest(velocity, F.lit(0)).cast("double")).alias("token_losing_rank_velocity"),
    )
    return tokens.select("mint").join(out, "mint", "left")
