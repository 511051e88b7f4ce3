"""R, K, L, P, Q, S: scores, cost model, research tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..adapters import ev_trades, table, with_views
from ..plans import asof as A
from ..plans import costs as K
from ..plans import labels as L
from ..plans import scores as R
from . import query

#: Feature columns for the score queries, by arithmetic on orders: each a share in hundredths, some missing, flags 0 or 1.
_NAMES = sorted({
    "rug_probability_score", "dev_sold_pct", "dev_sold_flag", "price_drop_70pct_from_launch_within_5m", "drawdown_from_ath_pct", "holder_growth_stalled", "sells_dominate_after_launch", "concentration_risk_score", "data_quality_score", "malicious_sell_intent_score", "shred_emergency_exit_triggered_flag", "shred_sell_warning_level",
    "bundle_risk_score", "same_slot_multi_buy_count", "first_n_buys_identical_amount_count", "first_n_buys_same_funder_count", "bundle_wallets_top_holder_pct", "tentative_sell_from_bundle_count", "creator_is_top1_holder", "creator_retained_supply_pct", "creator_launches_last_1h", "creator_reuses_same_payer", "creator_launching_spam_wave_flag",
    "developer_in_cluster", "tentative_sell_from_dev_count", "profit_overhang_score", "free_roll_dump_risk_score", "top_holders_same_funder_pct", "top_holders_same_client_fingerprint_pct", "price_up_top_holders_selling", "top1_holder_pct", "tentative_sell_from_top_holder_count", "vertical_move_without_holder_growth", "vertical_move_without_unique_buyers",
    "price_up_no_retail_breadth", "price_up_bundle_selling", "price_up_dev_selling", "price_up_only_one_or_two_large_buys", "price_up_buy_size_concentration_high", "exit_liquidity_trap_score", "momentum_authenticity_score", "absorption_success_score", "holder_stickiness_score", "critical_feature_missing_count", "source_disagreement_flag",
    "shred_signal_stale_flag", "trade_allowed_data_quality_flag", "no_buys_for_x_seconds", "one_wallet_controls_market_flag", "return_pct_30s", "organic_flow_score", "token_relative_strength_score", "sustained_holder_growth_score", "holder_balance_hhi", "organic_survival_score", "quote_asset_specific_depth_score", "latency_adjusted_trade_eligibility",
    "smart_capital_rotation_score", "fee_war_score", "rug_confidence", "bundle_confidence",
})
_RARE = {
    "price_drop_70pct_from_launch_within_5m", "source_disagreement_flag", "shred_signal_stale_flag", "dev_sold_flag", "shred_emergency_exit_triggered_flag", "one_wallet_controls_market_flag", "price_up_top_holders_selling", "no_buys_for_x_seconds", "vertical_move_without_holder_growth", "vertical_move_without_unique_buyers",
    "price_up_no_retail_breadth", "price_up_bundle_selling", "price_up_dev_selling", "price_up_only_one_or_two_large_buys", "price_up_buy_size_concentration_high", "creator_is_top1_holder", "creator_reuses_same_payer", "creator_launching_spam_wave_flag", "developer_in_cluster",
}


def _cell(i: int, name: str) -> str:
    """An expression that both engines read."""
    x = f"((o_orderkey * {2 * i + 3} + o_custkey * {i + 7}) % 101)"
    if name in _RARE:
        v = f"(CASE WHEN {x} < 6 THEN 1.0 ELSE 0.0 END)"
    elif name.endswith("_count") or name.endswith("_level"):
        v = f"(CASE WHEN {x} < 60 THEN 0.0 ELSE {x} % 5 END)"
    elif name == "dev_sold_pct" or name == "drawdown_from_ath_pct":
        v = f"(CASE WHEN {x} < 80 THEN 0.0 ELSE {x} / 100.0 END)"
    elif name in ("data_quality_score", "trade_allowed_data_quality_flag"):
        v = f"(CASE WHEN {x} < 70 THEN 1.0 - {x} / 400.0 ELSE 0.0 END)"
    elif name.startswith("rug_") or name.startswith("bundle_") or name in ("top1_holder_pct", "concentration_risk_score"):
        v = f"(CAST({x} AS DOUBLE) / 180)"
    else:
        v = f"({x} / 100.0)"
    return f"CASE WHEN {x} % 17 = 5 THEN NULL ELSE CAST({v} AS DOUBLE) END AS {name}"


_STATES = ["Discovered", "FirstPass", "ActiveLight", "ActiveDeep", "InPosition", "ActiveDeep", "ActiveDeep", "Completed", "ActiveLight", "ActiveDeep", "SoftDiscarded"]
_STRATEGIES = ["LaunchMomentumScalp", "HolderGrowthContinuation", "SellAbsorptionBounce", "SmartCapitalRotation", "OrganicSlowGrind", "DefensiveNoTrade"]
_pick = lambda names, x: "CASE " + " ".join(f"WHEN {x} % {len(names)} = {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
_CELLS = [_cell(i, n) for i, n in enumerate(_NAMES)] + [
    "CASE WHEN o_custkey % 9 = 1 THEN NULL ELSE CAST(o_custkey % 40 + 1 AS DOUBLE) / 1000 END AS latest_price",
    "CASE WHEN o_custkey % 8 = 2 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 700 AS DOUBLE) + 30 END AS depth_quote",
    "CAST(o_orderkey % 90 AS DOUBLE) AS buy_volume", "CAST(o_orderkey % 70 AS DOUBLE) AS sell_volume", "o_orderkey % 7 AS unique_buyers", "o_custkey % 6 AS holders", f"{_pick(_STATES, 'o_orderkey')} AS lifecycle",
    "CASE WHEN o_orderkey % 5 = 1 THEN CAST(o_custkey % 5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS early_level", "CAST(o_custkey % 10 AS DOUBLE) / 10 AS early_confidence",
]
_FEATURES = f"f AS (SELECT o_orderkey AS mint, {', '.join(_CELLS)} FROM orders)"


def score_features(spark, sf_dir):
    # the table is one small file, and its two columns become seventy: spread over all cores first
    narrow = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(spark.sparkContext.defaultParallelism)
    return narrow.selectExpr("o_orderkey as mint", *_CELLS)


_k = lambda c: f"coalesce({c}, 0)"
_clamp = lambda e: f"least(1.0, greatest(0.0, {e}))"


def _mean_of(total: float, *terms: tuple[float, str]) -> str:
    """SQL of a weighted mean; the weights are written out where this is called, not taken from the plan."""
    return f"(({' + '.join(f'{w} * {e}' for w, e in terms)}) / {total})"


_SOLD = f"greatest({_k('dev_sold_pct')}, {_k('dev_sold_flag')})"
_ATH = _clamp(f"({_k('drawdown_from_ath_pct')} - 0.70) / 0.30")
_WARN = f"({_k('shred_sell_warning_level')} / 4)"
_count = lambda c, n: _clamp(f"{_k(c)} / {n}.0")
_RUG = _mean_of(1.18, (0.35, _k("rug_probability_score")), (0.20, _SOLD), (0.20, f"greatest({_k('price_drop_70pct_from_launch_within_5m')}, {_ATH})"), (0.08, _k("holder_growth_stalled")), (0.07, _k("sells_dominate_after_launch")), (0.05, _k("concentration_risk_score")), (0.05, f"(1 - {_k('data_quality_score')})"), (0.08, _k("malicious_sell_intent_score")), (0.10, f"greatest({_k('shred_emergency_exit_triggered_flag')}, {_WARN})"))
_BUNDLE = _mean_of(1.25, (0.50, _k("bundle_risk_score")), (0.15, _count("same_slot_multi_buy_count", 8)), (0.15, _count("first_n_buys_identical_amount_count", 8)), (0.10, _count("first_n_buys_same_funder_count", 8)), (0.10, _k("bundle_wallets_top_holder_pct")), (0.15, _count("tentative_sell_from_bundle_count", 4)), (0.10, _WARN))
_DEV = _mean_of(1.40, (0.40, _SOLD), (0.15, _k("creator_is_top1_holder")), (0.15, _k("creator_retained_supply_pct")), (0.10, _count("creator_launches_last_1h", 5)), (0.10, _k("creator_reuses_same_payer")), (0.10, _k("creator_launching_spam_wave_flag")), (0.10, f"0.1 * {_k('developer_in_cluster')}"), (0.20, _count("tentative_sell_from_dev_count", 3)), (0.10, _WARN))
_TOP = _mean_of(1.15, (0.30, _k("concentration_risk_score")), (0.20, _k("profit_overhang_score")), (0.15, _k("free_roll_dump_risk_score")), (0.10, _k("top_holders_same_funder_pct")), (0.10, _k("top_holders_same_client_fingerprint_pct")), (0.10, _k("price_up_top_holders_selling")), (0.05, _k("top1_holder_pct")), (0.15, _count("tentative_sell_from_top_holder_count", 4)))
_EXTREME = _clamp(f"({_k('top1_holder_pct')} - 0.65) / 0.35")
_FAKE = _mean_of(1.33, (0.18, _k("vertical_move_without_holder_growth")), (0.15, _k("vertical_move_without_unique_buyers")), (0.15, _k("price_up_no_retail_breadth")), (0.15, _k("price_up_top_holders_selling")), (0.10, _k("price_up_bundle_selling")), (0.10, _k("price_up_dev_selling")), (0.07, _k("price_up_only_one_or_two_large_buys")), (0.05, _k("price_up_buy_size_concentration_high")),
    (0.08, _k("exit_liquidity_trap_score")), (0.07, _EXTREME), (0.05, _k("dev_sold_flag")), (0.07, f"(1 - {_k('momentum_authenticity_score')})"), (0.05, f"{_k('rug_probability_score')} / 2"), (0.06, _WARN)) + " - " + _mean_of(0.32, (0.20, _k("absorption_success_score")), (0.12, _k("holder_stickiness_score")))
_QUALITY_RISK = _mean_of(1.10, (0.60, f"(1 - {_k('data_quality_score')})"), (0.25, _count("critical_feature_missing_count", 5)), (0.15, _k("source_disagreement_flag")), (0.10, _k("shred_signal_stale_flag")))
_severe = lambda c: f"CASE WHEN {c} >= 0.85 THEN 'critical' WHEN {c} >= 0.65 THEN 'high' WHEN {c} >= 0.35 THEN 'medium' ELSE 'low' END"
_RISKS = f"""{_FEATURES},
    a AS (SELECT *, {_clamp(_RUG)} AS rug, {_clamp(_BUNDLE)} AS bundle, {_clamp(_DEV)} AS dev, {_clamp(_TOP)} AS top_holder, {_clamp(_FAKE)} AS fake_momentum, {_clamp(_QUALITY_RISK)} AS data_quality,
        {_k('price_drop_70pct_from_launch_within_5m')} > 0 OR {_ATH} >= 0.5 AS collapsed, {_SOLD} > 0 AS sold, greatest({_k('source_disagreement_flag')}, {_k('shred_signal_stale_flag')}) > 0 AS gap, {_k('trade_allowed_data_quality_flag')} = 0 AS stopped, {_k('first_n_buys_same_funder_count')} > 0 AS shared,
        greatest({_k('vertical_move_without_holder_growth')}, {_k('vertical_move_without_unique_buyers')}, {_k('price_up_no_retail_breadth')}, {_k('price_up_top_holders_selling')}, {_k('price_up_bundle_selling')}, {_k('price_up_dev_selling')}, {_k('price_up_buy_size_concentration_high')}) > 0 OR ({_EXTREME} > 0 AND {_k('dev_sold_flag')} > 0) AS faked FROM f),
    p AS (SELECT *, {_clamp('rug * 0.30 + bundle * 0.15 + dev * 0.15 + top_holder * 0.15 + fake_momentum * 0.15 + data_quality * 0.10')} AS overall, gap AND ({_k('data_quality_score')} < 0.50 OR stopped) AS gap_stop,
        0.30 * greatest({_k('rug_confidence')}, 0.5) + 0.15 * greatest({_k('bundle_confidence')}, 0.5) + 0.15 * 0.75 + 0.15 * 0.8 + 0.15 * 0.7 + 0.10 * 0.9 AS overall_confidence FROM a),
    q AS (SELECT *, CASE WHEN gap_stop THEN 'DataGapStop' WHEN rug >= 0.85 OR collapsed THEN CASE WHEN dev >= 0.6 THEN 'RugArchive' ELSE 'HardDiscard' END WHEN sold AND (top_holder >= 0.30 OR fake_momentum >= 0.40 OR rug >= 0.25) THEN 'SoftDiscard'
        WHEN bundle >= 0.75 OR top_holder >= 0.75 OR fake_momentum >= 0.70 THEN 'SoftDiscard' WHEN rug >= 0.60 OR dev >= 0.65 THEN 'ResearchSample' ELSE 'Keep' END AS policy FROM p),
    r AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN sold THEN 'DevSoldEarly' END, CASE WHEN collapsed THEN 'PriceCollapse70' END, CASE WHEN {_k('no_buys_for_x_seconds')} > 0 THEN 'NoBuyGap' END, CASE WHEN {_k('shred_sell_warning_level')} >= 3 OR {_k('shred_emergency_exit_triggered_flag')} > 0 THEN 'ShredSellImpactHigh' END,
        CASE WHEN rug >= 0.7 THEN 'HighRugRisk' END, CASE WHEN shared THEN 'BundleConcentration' END, CASE WHEN {_k('tentative_sell_from_bundle_count')} > 0 THEN 'ShredBundleExitWarning' END, CASE WHEN bundle >= 0.40 THEN 'HighBundleRisk' END, CASE WHEN {_k('tentative_sell_from_dev_count')} > 0 THEN 'ShredDevSellWarning' END,
        CASE WHEN {_k('one_wallet_controls_market_flag')} > 0 OR {_k('price_up_top_holders_selling')} > 0 OR {_k('top1_holder_pct')} >= 0.55 THEN 'TopHolderDump' END, CASE WHEN {_k('tentative_sell_from_top_holder_count')} > 0 THEN 'ShredTopHolderSellWarning' END, CASE WHEN top_holder >= 0.7 THEN 'HighTopHolderRisk' END,
        CASE WHEN faked THEN 'HighFakeMomentumRisk' END, CASE WHEN stopped AND gap OR policy = 'DataGapStop' THEN 'DataGapActive' END, CASE WHEN policy = 'SoftDiscard' THEN 'SoftDiscarded' WHEN policy = 'HardDiscard' THEN 'HardDiscarded' END], lambda x: x IS NOT NULL))) AS reasons FROM q)"""


def _risk_rows(spark, sf_dir):
    return R.risks(score_features(spark, sf_dir))


def _one_risk(name: str, confidence: str, reasons: list[tuple[str, str]], needed: list[str], action: str) -> str:
    codes = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in reasons)
    missing = " + ".join(f"({c} IS NULL)::INT" for c in needed)
    return f"WITH {_RISKS} SELECT mint, {name} AS score, {confidence} AS confidence, {_severe(name)} AS severity, concat_ws('|', {codes}) AS reasons, ({missing}) / {len(needed)} AS missing_penalty, {action} AS action FROM r"


def _risk_of(spark, sf_dir, name):
    r = F.col(f"{name}_risk")
    return _risk_rows(spark, sf_dir).select("mint", F.col(name).alias("score"), r["confidence"].alias("confidence"), r["severity"].alias("severity"), F.array_join(r["reasons"], "|").alias("reasons"), r["missing_penalty"].alias("missing_penalty"), r["action"].alias("action"))


@query(_one_risk("rug", f"greatest({_k('rug_confidence')}, 0.5)", [("DevSoldEarly", "sold"), ("PriceCollapse70", "collapsed"), ("NoBuyGap", f"{_k('no_buys_for_x_seconds')} > 0"), ("ShredSellImpactHigh", f"{_k('shred_sell_warning_level')} >= 3 OR {_k('shred_emergency_exit_triggered_flag')} > 0"), ("HighRugRisk", "rug >= 0.7")],
    ["rug_probability_score", "dev_sold_pct"], "CASE WHEN collapsed OR rug >= 0.9 THEN 'HardDiscard' WHEN rug >= 0.75 THEN 'RugArchive' WHEN rug >= 0.60 THEN 'SoftDiscard' ELSE 'KeepWatching' END"))
def r1_rug_risk(spark, sf_dir):
    return _risk_of(spark, sf_dir, "rug")


@query(_one_risk("bundle", f"greatest({_k('bundle_confidence')}, 0.5)", [("BundleConcentration", "shared"), ("ShredBundleExitWarning", f"{_k('tentative_sell_from_bundle_count')} > 0"), ("HighBundleRisk", "bundle >= 0.40")], ["bundle_risk_score"], "CASE WHEN bundle >= 0.85 THEN 'HardDiscard' WHEN bundle >= 0.70 THEN 'SoftDiscard' ELSE 'KeepWatching' END"))
def r2_bundle_risk(spark, sf_dir):
    return _risk_of(spark, sf_dir, "bundle")


@query(_one_risk("dev", "0.75", [("DevSoldEarly", "sold"), ("ShredDevSellWarning", f"{_k('tentative_sell_from_dev_count')} > 0")], ["dev_sold_pct"], "CASE WHEN dev >= 0.75 THEN 'SoftDiscard' ELSE 'KeepWatching' END"))
def r3_dev_risk(spark, sf_dir):
    return _risk_of(spark, sf_dir, "dev")


@query(_one_risk("top_holder", "0.8", [("TopHolderDump", f"{_k('one_wallet_controls_market_flag')} > 0 OR {_k('price_up_top_holders_selling')} > 0 OR {_k('top1_holder_pct')} >= 0.55"), ("ShredTopHolderSellWarning", f"{_k('tentative_sell_from_top_holder_count')} > 0"), ("HighTopHolderRisk", "top_holder >= 0.7")],
    ["top1_holder_pct", "profit_overhang_score", "free_roll_dump_risk_score"], "CASE WHEN top_holder >= 0.8 THEN 'SoftDiscard' ELSE 'KeepWatching' END"))
def r4_top_holder_risk(spark, sf_dir):
    return _risk_of(spark, sf_dir, "top_holder")


@query(_one_risk("fake_momentum", "0.7", [("HighFakeMomentumRisk", "faked")], ["vertical_move_without_holder_growth", "momentum_authenticity_score"], "CASE WHEN fake_momentum >= 0.8 THEN 'SoftDiscard' ELSE 'KeepWatching' END"))
def r5_fake_momentum_risk(spark, sf_dir):
    return _risk_of(spark, sf_dir, "fake_momentum")


@query(_one_risk("data_quality", "0.9", [("DataGapActive", "stopped AND gap")], ["data_quality_score", "critical_feature_missing_count"], "CASE WHEN gap_stop THEN 'DataGapStop' ELSE 'KeepWatching' END"))
def r6_data_quality_risk(spark, sf_dir):
    return _risk_of(spark, sf_dir, "data_quality")


@query(f"WITH {_RISKS} SELECT mint, rug, bundle, dev, top_holder, fake_momentum, data_quality, overall, overall_confidence, {_severe('overall')} AS severity, policy, array_to_string(reasons, '|') AS reasons FROM r")
def r7_assessment(spark, sf_dir):
    return _risk_rows(spark, sf_dir).select("mint", *R.RISKS, "overall", "overall_confidence", "severity", "policy", F.array_join("reasons", "|").alias("reasons"))


_RISE = f"greatest({_k('return_pct_30s')}, 0)"


def _trip(size: str, price: str, exit_: str, depth: str) -> tuple[str, str, str]:
    """SQL of (proceeds, impact of the buy, impact of the sale)."""
    tokens = f"({size} / ({price} * (1 + {size} / {depth} + 0.01)))"
    return f"({tokens} * {exit_} / (1 + {tokens} * {exit_} / {depth} + 0.01))", f"({size} / {depth})", f"({tokens} * {exit_} / {depth})"


_SCORES = ["momentum", "holder_quality", "fee_adjusted_edge", "liquidity", "latency", "relative_strength", "stickiness", "absorption", "rotation", "overhang", "authenticity", "anti_rug", "eligibility"]
_adj = lambda name, raw, pen: f"{_clamp(raw)} AS {name}_raw, {_clamp(f'{raw} - ({pen}) / 2')} AS {name}, {_clamp(f'1 - ({pen})')} AS {name}_confidence"
_COMPOSITES = f"""{_RISKS}, c0 AS (SELECT *, greatest({_k('latest_price')}, 1e-9) AS lp, CASE WHEN depth_quote > 0 THEN depth_quote ELSE 100.0 END AS dq FROM r), c1 AS (SELECT *, {_trip('25.0', 'lp', f'(lp * (1 + {_RISE}))', 'dq')[0]} AS back FROM c0),
    c2 AS (SELECT *, {_adj('momentum', f"(0.45 * {_k('return_pct_30s')} + 0.35 * {_k('organic_flow_score')} + 0.20 * {_k('token_relative_strength_score')})", 'fake_momentum / 2')}, {_adj('holder_quality', f"(0.5 * {_k('sustained_holder_growth_score')} + 0.3 * (1 - {_k('concentration_risk_score')}) + 0.2 * (1 - {_k('holder_balance_hhi')}))", 'top_holder / 2')},
        {_adj('fee_adjusted_edge', _clamp('((back - 25.0 - 0.00004 - (25.0 + back) * 0.0125) / 25.0 + 1) / 2'), 'bundle / 3')}, {_adj('liquidity', _k('quote_asset_specific_depth_score'), '0')}, {_adj('latency', _k('latency_adjusted_trade_eligibility'), '0')}, {_adj('relative_strength', _k('token_relative_strength_score'), '0')},
        {_adj('stickiness', _k('holder_stickiness_score'), '0')}, {_adj('absorption', _k('absorption_success_score'), '0')}, {_adj('rotation', _k('smart_capital_rotation_score'), '0')}, {_adj('overhang', f"(1 - {_k('profit_overhang_score')})", 'top_holder / 3')}, {_adj('authenticity', _k('momentum_authenticity_score'), 'fake_momentum / 3')},
        {_adj('anti_rug', f"(0.7 * {_k('organic_survival_score')} + 0.3 * (1 - rug))", 'rug / 2')} FROM c1),
    c AS (SELECT *, {_adj('eligibility', '((0.20 * momentum + 0.20 * holder_quality + 0.20 * fee_adjusted_edge + 0.10 * liquidity + 0.05 * latency + 0.10 * relative_strength + 0.10 * stickiness + 0.05 * absorption + 0.05 * rotation + 0.05 * overhang + 0.05 * authenticity + 0.05 * anti_rug) / 1.2)', '0.35 * rug + 0.20 * bundle + 0.15 * top_holder + 0.15 * fake_momentum + 0.15 * data_quality')} FROM c2)"""


@query(f"WITH {_COMPOSITES} SELECT mint, {', '.join(f'{n}_raw, {n}, {n}_confidence' for n in _SCORES)} FROM c")
def r10_composites(spark, sf_dir):
    return R.composites(_risk_rows(spark, sf_dir)).select("mint", *[f"{n}{e}" for n in _SCORES for e in ("_raw", "", "_confidence")])


_STRATEGY = f"""CASE WHEN rug >= 0.7 OR data_quality >= 0.75 THEN 'DefensiveNoTrade' WHEN holder_quality >= 0.36 AND {_k('holder_stickiness_score')} >= 0.22 AND {_k('organic_survival_score')} >= 0.30 AND {_k('token_relative_strength_score')} >= 0.45 AND fake_momentum < 0.30 AND NOT faked THEN 'HolderGrowthContinuation'
    WHEN momentum >= 0.48 AND {_k('momentum_authenticity_score')} >= 0.45 AND fake_momentum < 0.30 AND NOT faked THEN 'LaunchMomentumScalp' WHEN {_k('absorption_success_score')} >= 0.22 AND {_k('holder_stickiness_score')} >= 0.15 AND bundle < 0.65 AND top_holder < 0.75 AND fake_momentum < 0.60 THEN 'SellAbsorptionBounce'
    WHEN {_k('smart_capital_rotation_score')} >= 0.12 AND momentum >= 0.15 THEN 'SmartCapitalRotation' WHEN {_k('organic_survival_score')} >= 0.30 AND holder_quality >= 0.25 AND bundle < 0.60 THEN 'OrganicSlowGrind' ELSE 'DefensiveNoTrade' END"""
_DECIDE = f"""{_COMPOSITES}, s AS (SELECT *, {_STRATEGY} AS strategy FROM c),
    e0 AS (SELECT *, CASE strategy WHEN 'LaunchMomentumScalp' THEN 0.25 * {_RISE} + 0.20 * {_k('token_relative_strength_score')} + 0.30 * {_k('momentum_authenticity_score')} + 0.25 * {_k('organic_flow_score')}
            WHEN 'HolderGrowthContinuation' THEN 0.30 * {_k('sustained_holder_growth_score')} + 0.30 * {_k('holder_stickiness_score')} + 0.20 * {_k('token_relative_strength_score')} + 0.20 * {_k('organic_survival_score')}
            WHEN 'SellAbsorptionBounce' THEN 0.40 * {_k('absorption_success_score')} + 0.25 * {_k('momentum_authenticity_score')} + 0.20 * {_k('holder_stickiness_score')} + 0.15 * {_k('organic_flow_score')}
            WHEN 'SmartCapitalRotation' THEN 0.35 * {_k('smart_capital_rotation_score')} + 0.25 * {_k('token_relative_strength_score')} + 0.20 * {_k('holder_stickiness_score')} + 0.20 * {_k('momentum_authenticity_score')}
            WHEN 'OrganicSlowGrind' THEN 0.35 * {_k('organic_survival_score')} + 0.25 * {_k('holder_stickiness_score')} + 0.20 * {_k('sustained_holder_growth_score')} + 0.20 * (1 - bundle) ELSE 0 END AS q,
        0.30 * rug + 0.15 * bundle + 0.15 * top_holder + 0.20 * fake_momentum + 0.10 * {_k('profit_overhang_score')} + 0.10 * {_k('fee_war_score')} AS pen,
        CASE strategy WHEN 'LaunchMomentumScalp' THEN 0.18 WHEN 'HolderGrowthContinuation' THEN 0.28 WHEN 'SellAbsorptionBounce' THEN 0.14 WHEN 'SmartCapitalRotation' THEN 0.20 ELSE 0.24 END AS take, CASE WHEN depth_quote > 0 THEN depth_quote ELSE buy_volume + sell_volume + 50 END AS de FROM s),
    e1 AS (SELECT *, {_clamp("q * 0.60 + (1 - pen) * 0.20 + coalesce(data_quality_score, 0.5) * 0.20")} AS edge_confidence, {_clamp(f"take * {_clamp('q')} * {_clamp('1 - pen / 2')}")} AS expected_move FROM e0),
    e2 AS (SELECT *, {_trip('1.5', 'lp', '(lp * (1 + expected_move))', 'de')[0]} AS eback, 1.5 * ({_trip('1.5', 'lp', '(lp * (1 + expected_move))', 'de')[1]} + {_trip('1.5', 'lp', '(lp * (1 + expected_move))', 'de')[2]}) AS impact_drag FROM e1),
    e3 AS (SELECT *, 0.00004 + (1.5 + eback) * 0.0125 AS fee_drag, 1.5 * (1 - coalesce(latency_adjusted_trade_eligibility, 0.5)) * 0.10 * 1.20 AS latency_drag FROM e2),
    e4 AS (SELECT *, (fee_drag + 0.03 + impact_drag + latency_drag) / 1.5 AS required_move, eback - 1.5 - fee_drag - (fee_drag + 0.03 + impact_drag) * 0.20 - latency_drag AS net_edge_quote FROM e3),
    g AS (SELECT *, CASE WHEN gap_stop THEN 'data_gap' WHEN rug >= 0.45 OR bundle >= 0.55 OR fake_momentum >= 0.50 THEN 'risk' WHEN {_k('data_quality_score')} < 0.75 THEN 'data_quality' WHEN fee_adjusted_edge_raw < 0.008 THEN 'fee_edge' WHEN lifecycle IN ('Completed', 'SoftDiscarded') THEN 'lifecycle' END AS blocked_by,
        early_level >= 2 AS warned, early_confidence < 0.55 AS unsure FROM e4),
    d AS (SELECT *, CASE WHEN blocked_by IN ('data_gap', 'risk') THEN CASE WHEN lifecycle = 'InPosition' THEN 'EmergencyExit' ELSE 'StopTracking' END WHEN blocked_by = 'data_quality' THEN 'WatchLight' WHEN blocked_by = 'fee_edge' THEN 'WatchDeep' WHEN blocked_by = 'lifecycle' THEN 'StopTracking'
        WHEN strategy <> 'DefensiveNoTrade' AND eligibility >= 0.30 AND (unique_buyers >= 3 OR holders >= 3) AND bundle < 0.45 AND NOT shared AND bundle < 0.40 AND NOT faked AND (NOT warned OR unsure) AND {_k('holder_stickiness_score')} >= 0.20 AND {_k('momentum_authenticity_score')} >= 0.15 AND {_k('profit_overhang_score')} <= 0.90
            AND net_edge_quote > 0.02 AND net_edge_quote / 1.5 > 0.01 AND edge_confidence >= 0.35 THEN 'EnterPaper' WHEN strategy = 'DefensiveNoTrade' THEN 'WatchLight' WHEN eligibility >= 0.15 THEN 'WatchDeep' ELSE 'WatchLight' END AS decision FROM g)"""


def _decided(spark, sf_dir):
    return R.decide(R.composites(_risk_rows(spark, sf_dir)))


@query(f"WITH {_DECIDE} SELECT mint, strategy FROM s")
def r11_strategies(spark, sf_dir):
    return R.composites(_risk_rows(spark, sf_dir)).select("mint", R.strategy().alias("strategy"))


@query(f"""WITH {_DECIDE} SELECT mint, strategy, expected_move, fee_drag, 0.03 AS slippage_drag, impact_drag, latency_drag, required_move, net_edge_quote, net_edge_quote / 1.5 AS net_edge_pct, edge_confidence,
    concat_ws('|', CASE WHEN net_edge_quote <= 0.02 OR net_edge_quote / 1.5 <= 0.01 THEN 'FeeAdjustedEdgeTooLow' END, CASE WHEN fee_war_score >= 0.60 THEN 'FeeWarTooExpensive' END) AS edge_reasons FROM e4""")
def r12_expected_edge(spark, sf_dir):
    x = R.expected_edge(R.composites(_risk_rows(spark, sf_dir)).withColumn("strategy", R.strategy()))
    return x.select("mint", "strategy", "expected_move", "fee_drag", "slippage_drag", "impact_drag", "latency_drag", "required_move", "net_edge_quote", "net_edge_pct", "edge_confidence", F.array_join("edge_reasons", "|").alias("edge_reasons"))


@query(f"WITH {_COMPOSITES} SELECT mint, least(50.0 * eligibility * {_clamp('(CASE WHEN depth_quote > 0 THEN depth_quote ELSE buy_volume + sell_volume + 25 END) / 500')} * {_clamp('1 - (0.4 * rug + 0.2 * bundle + 0.2 * top_holder + 0.2 * fake_momentum)')}, 250.0, 1.5) AS size FROM c")
def r13_position_sizes(spark, sf_dir):
    return R.composites(_risk_rows(spark, sf_dir)).select("mint", R.position_size().alias("size"))


_WHY = """array_to_string(list_sort(list_distinct(list_concat(reasons, list_filter([CASE WHEN blocked_by IN ('data_gap', 'data_quality') THEN 'DataGapActive' END, CASE WHEN blocked_by = 'risk' AND rug >= 0.45 THEN 'HighRugRisk' END, CASE WHEN blocked_by = 'risk' AND bundle >= 0.55 THEN 'HighBundleRisk' END,
        CASE WHEN blocked_by = 'risk' AND fake_momentum >= 0.50 THEN 'HighFakeMomentumRisk' END, CASE WHEN blocked_by = 'fee_edge' THEN 'FeeAdjustedEdgeTooLow' END, CASE WHEN blocked_by IS NULL AND warned AND NOT unsure THEN 'EarlyIntentSellWarning' END, CASE WHEN decision = 'EnterPaper' THEN 'EnterPaper' WHEN decision = 'EmergencyExit' THEN 'ExitPaper' END, 'LiveDisabled'],
        lambda x: x IS NOT NULL)))), '|')"""


@query(f"WITH {_DECIDE} SELECT mint, strategy, decision, blocked_by, {_WHY} AS decision_reasons FROM d")
def r14_entry_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("mint", "strategy", "decision", "blocked_by", F.array_join("decision_reasons", "|").alias("decision_reasons"))


_POSITION = {
    "own": _pick(_STRATEGIES, "o_custkey"), "size_quote": "CASE WHEN o_orderkey % 19 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 40 AS DOUBLE) / 10 + 1 END", "size_tokens": "CAST(o_orderkey % 300 AS DOUBLE) + 100", "entry_fees": "CAST(o_custkey % 5 AS DOUBLE) / 100",
    "best_gain": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o_custkey % 30 AS DOUBLE) / 30 END", "held_ms": "CAST(o_orderkey % 200 AS BIGINT) * 1000", "exit_triggered": "o_orderkey % 37 = 1", "exit_armed": "o_orderkey % 23 = 2", "k": "o_orderkey",
}


@query(f"""WITH {_RISKS}, o AS (SELECT {', '.join(f'{v} AS {n}' for n, v in _POSITION.items())} FROM orders), x AS (SELECT *, CASE WHEN size_quote > 0 THEN (size_tokens * {_k('latest_price')} - size_quote - entry_fees) / size_quote ELSE 0 END AS gain, CASE WHEN size_quote > 0 THEN best_gain / size_quote ELSE 0 END AS best,
        CASE own WHEN 'LaunchMomentumScalp' THEN [0.18, 0.08, 0.09, 20000] WHEN 'HolderGrowthContinuation' THEN [0.28, 0.12, 0.12, 90000] WHEN 'SellAbsorptionBounce' THEN [0.14, 0.07, 0.08, 35000] WHEN 'SmartCapitalRotation' THEN [0.20, 0.10, 0.10, 60000] ELSE [0.24, 0.10, 0.11, 120000] END AS pr FROM r JOIN o ON mint = k),
    y AS (SELECT *, CASE WHEN exit_triggered THEN 'shred_emergency_exit' WHEN exit_armed THEN 'shred_exit_armed' WHEN rug >= 0.75 OR fake_momentum >= 0.75 OR bundle >= 0.80 THEN 'emergency_risk' WHEN gain >= pr[1] THEN 'take_profit' WHEN gain <= -pr[3] THEN 'stop_loss' WHEN best_gain > 0 AND gain <= best - pr[2] THEN 'trailing_stop' WHEN held_ms >= pr[4] THEN 'max_hold'
        WHEN CASE own WHEN 'LaunchMomentumScalp' THEN {_k('momentum_authenticity_score')} < 0.15 OR {_k('return_pct_30s')} < 0 WHEN 'HolderGrowthContinuation' THEN {_k('holder_stickiness_score')} < 0.20 OR {_k('profit_overhang_score')} > 0.90 OR top_holder > 0.55 WHEN 'SellAbsorptionBounce' THEN {_k('absorption_success_score')} < 0.12 OR fake_momentum > 0.55
            WHEN 'SmartCapitalRotation' THEN {_k('smart_capital_rotation_score')} < 0.10 OR {_k('token_relative_strength_score')} < 0.15 WHEN 'OrganicSlowGrind' THEN {_k('organic_survival_score')} < 0.25 OR bundle > 0.60 ELSE true END THEN 'strategy_decay' END AS exit_by FROM x)
    SELECT mint, own AS strategy, gain, exit_by, CASE WHEN exit_by IN ('shred_emergency_exit', 'emergency_risk') THEN 'EmergencyExit' WHEN exit_by IS NULL OR exit_by = 'shred_exit_armed' THEN 'Hold' ELSE 'Exit' END AS decision FROM y""")
def r15_exit_decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr(*[f"{v} as {n}" for n, v in _POSITION.items()])
    x = _risk_rows(spark, sf_dir).withColumn("latest_price", F.coalesce("latest_price", F.lit(0.0))).join(o, F.col("mint") == F.col("k")).withColumnRenamed("own", "strategy")
    return R.exit_decision(x).select("mint", "strategy", "gain", "exit_by", "decision")


_FAMILIES = {"supply": ["top1_holder_pct", "concentration_risk_score"], "developer": ["dev_sold_pct", "creator_retained_supply_pct"], "flow": ["organic_flow_score"], "survival": ["organic_survival_score", "momentum_authenticity_score"]}


def _mean(cols):
    n = " + ".join(f"({c} IS NOT NULL)::INT" for c in cols)
    return f"CASE WHEN {n} > 0 THEN ({' + '.join(_k(c) for c in cols)}) / ({n}) END"


@query(f"""WITH {_FEATURES}, e AS (SELECT mint, {', '.join(f'{_mean(c)} AS {n}' for n, c in _FAMILIES.items())} FROM f),
    t AS (SELECT mint, {' + '.join(f'({n} IS NOT NULL)::INT' for n in _FAMILIES)} AS available, concat_ws(',', {', '.join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in sorted(_FAMILIES))}) AS unavailable, {' + '.join(_k(n) for n in _FAMILIES)} AS s FROM e)
    SELECT mint, available, unavailable, CASE WHEN available > 0 THEN s / available END AS total,
        CASE WHEN available = 0 THEN 'unavailable' WHEN s / available >= 0.6 THEN 'elevated' WHEN s / available >= 0.4 THEN 'mixed' ELSE 'calm' END AS classification FROM t""")
def r_evidence_families(spark, sf_dir):
    return R.evidence(score_features(spark, sf_dir), _FAMILIES, "mint")


@query(with_views("ev", sql="""e AS (SELECT seq AS position, mint, us, price FROM ev WHERE side = 'buy'),
    x AS (SELECT e.position, e.mint, e.us, e.price, m.us AS mu, m.seq AS ms, m.price AS mp, max(m.price) OVER (PARTITION BY e.position ORDER BY m.us, m.seq ROWS UNBOUNDED PRECEDING) AS best FROM e JOIN ev AS m ON m.mint = e.mint AND m.us > e.us),
    r AS (SELECT *, CASE WHEN mp >= price * 1.5 THEN 'take_profit' WHEN mp <= price * 0.7 THEN 'stop_loss' WHEN mp <= best * 0.75 THEN 'trailing_stop' WHEN mu - us >= 864000000000 THEN 'max_hold' END AS rule FROM x),
    h AS (SELECT position, arg_min(rule, (mu, ms)) AS rule, arg_min(mu, (mu, ms)) AS mu, arg_min(mp, (mu, ms)) AS mp FROM r WHERE rule IS NOT NULL GROUP BY 1)
    SELECT e.position, e.mint, coalesce(rule, 'open') AS rule, mu AS exit_us, mp AS exit_price FROM e LEFT JOIN h USING (position)"""))
def r15_exits(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    return K.exits(t.where("side = 'buy'").select(F.col("seq").alias("position"), "mint", "us", "price"), t)


@query(f"""WITH {_FEATURES}, x AS (SELECT *, mint % 300 AS age FROM f)
    SELECT mint, 'developer_exit' AS rule, CASE WHEN age < 10 THEN 'too_early' WHEN dev_sold_pct IS NULL THEN 'unavailable' WHEN dev_sold_pct >= 0.8 THEN 'hit' ELSE 'miss' END AS outcome FROM x
    UNION ALL SELECT mint, 'collapse', CASE WHEN age < 60 THEN 'too_early' WHEN drawdown_from_ath_pct IS NULL OR top1_holder_pct IS NULL THEN 'unavailable' WHEN drawdown_from_ath_pct >= 0.8 AND top1_holder_pct > 0.3 THEN 'hit' ELSE 'miss' END FROM x""")
def r16_table_rules(spark, sf_dir):
    x = score_features(spark, sf_dir).withColumn("age_seconds", F.col("mint") % 300)
    return R.rules(x, [("developer_exit", ["dev_sold_pct"], F.col("dev_sold_pct") >= 0.8, 10), ("collapse", ["drawdown_from_ath_pct", "top1_holder_pct"], (F.col("drawdown_from_ath_pct") >= 0.8) & (F.col("top1_holder_pct") > 0.3), 60)], "mint")


@query("""
    WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side, o_totalprice / 1000 AS size, (o_custkey % 50 + 1) / 10.0 AS price, CASE WHEN o_custkey % 11 = 0 THEN 0.0 ELSE o_custkey * 100.0 END AS depth, o_orderkey % 9 = 0 AS failed FROM orders),
    i AS (SELECT *, CASE WHEN depth > 0 THEN (CASE WHEN side = 'buy' THEN size ELSE size * price END) / depth ELSE 1.0 END AS impact FROM o),
    p AS (SELECT *, CASE WHEN side = 'buy' THEN price * (1 + impact + 0.01) ELSE price / (1 + impact + 0.01) END AS fill_price FROM i),
    n AS (SELECT *, CASE WHEN side = 'buy' THEN size ELSE size * fill_price END AS notional FROM p)
    SELECT k, impact, fill_price, notional, CASE WHEN failed THEN 0 WHEN side = 'buy' THEN size / fill_price ELSE size END AS filled, notional * 30 / 10000 AS creator_fee, notional * 95 / 10000 AS protocol_fee, CASE WHEN failed THEN 0.000005 ELSE 0 END AS failed_fee,
        0.000005 + 0.000015 + notional * 30 / 10000 + notional * 95 / 10000 + CASE WHEN failed THEN 0.000005 ELSE 0 END AS total_fee FROM n""")
def k1_k2_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "if(o_orderstatus = 'F', 'sell', 'buy') as side", "o_totalprice / 1000 as size", "cast((o_custkey % 50 + 1) / 10.0 as double) as price", "if(o_custkey % 11 = 0, 0D, o_custkey * 100D) as depth", "o_orderkey % 9 = 0 as failed")
    return K.orders(o).select("k", "impact", "fill_price", "notional", "filled", "creator_fee", "protocol_fee", "failed_fee", "total_fee")


_TRIPS = """
    WITH o AS (SELECT o_totalprice / 10000 AS size, o_custkey % 50 + 1.0 AS a, o_orderkey % 60 + 1.0 AS z, o_custkey * 100.0 + 1 AS depth FROM orders),
    b AS (SELECT *, size / (a * (1 + size / depth + 0.01)) AS tokens FROM o), s AS (SELECT *, tokens * (z / (1 + tokens * z / depth + 0.01)) AS proceeds FROM b),
    n AS (SELECT *, proceeds - size AS gross, 0.00004 + (size + proceeds) * 125 / 10000 AS fees, (size + proceeds) * 0.01 AS slip FROM s)
    SELECT count(*) AS trades, sum(gross) AS total_pnl, sum(gross - fees) AS net_pnl, sum(fees) AS fee_drag, sum(slip) AS slippage_drag, avg((gross - fees > 0)::INT) AS hit_rate FROM n"""


@query(_TRIPS)
def k3_k4_backtest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_totalprice / 10000 as size", "cast(o_custkey % 50 + 1 as double) as entry_price", "cast(o_orderkey % 60 + 1 as double) as exit_price", "o_custkey * 100D + 1 as depth")
    return K.backtest(K.round_trips(o))


@query(with_views("ev", sql="""b AS (SELECT seq AS position, mint, tokens, quote AS cost FROM ev WHERE side = 'buy'), s AS (SELECT DISTINCT b.position FROM b JOIN ev ON ev.mint = b.mint AND ev.side = 'sell' AND ev.seq % 10 = b.position % 10), p AS (SELECT mint, arg_max(price, (us, seq)) AS price FROM ev GROUP BY 1)
    SELECT position, mint, tokens, price, tokens * price AS value, tokens * price - cost AS pnl FROM b JOIN p USING (mint) WHERE position NOT IN (SELECT position FROM s)"""))
def k5_k7_mark_to_market(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    b = t.where("side = 'buy'").select(F.col("seq").alias("position"), "mint", "tokens", F.col("quote").alias("cost"))
    s = b.select("position", "mint", (F.col("position") % 10).alias("d")).join(t.where("side = 'sell'").select("mint", (F.col("seq") % 10).alias("d")).distinct(), ["mint", "d"])
    return K.mark_to_market(b, s, t.groupBy("mint").agg(F.max_by("price", F.struct("us", "seq")).alias("price")))


_DAY = 86_400_000_000
_ASOF = """l AS (SELECT mint, min(us) AS first_us, (SELECT max(us) FROM ev) AS last_us FROM ev GROUP BY mint), h AS (SELECT *, unnest([1, 3, 7, 14, 28]) AS horizon FROM l),
    a AS (SELECT h.mint, horizon, first_us + horizon * 86400000000 AS asof_us, first_us + horizon * 86400000000 <= last_us AS reached, count(ev.mint) FILTER (side = 'buy') AS buys, count(ev.mint) FILTER (side = 'sell') AS sells, coalesce(sum(quote), 0) AS volume,
        coalesce(sum(CASE WHEN side = 'buy' THEN quote ELSE -quote END), 0) AS net_flow, count(DISTINCT wallet) AS wallets FROM h LEFT JOIN ev ON ev.mint = h.mint AND us >= first_us AND us <= first_us + horizon * 86400000000 GROUP BY ALL),
    asof_ AS (SELECT mint, horizon, asof_us, reached, CASE WHEN reached THEN buys END AS buys, CASE WHEN reached THEN sells END AS sells, CASE WHEN reached THEN volume END AS volume, CASE WHEN reached THEN net_flow END AS net_flow, CASE WHEN reached THEN wallets END AS wallets FROM a)"""


def asof(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    labels = t.groupBy("mint").agg(F.min("us").alias("first_us")).join(t.agg(F.max("us").alias("last_us")))
    return L.asof_features(t, labels, [1, 3, 7, 14, 28], _DAY)


@query(with_views("ev", sql=_ASOF + " SELECT * FROM asof_"))
def l2_asof_features(spark, sf_dir):
    return asof(spark, sf_dir)


_OUTCOME = _ASOF + """, w AS (SELECT *, last_value(wallets) OVER w - wallets AS wallets_forward, last_value(volume) OVER w - volume AS volume_forward, last_value(net_flow) OVER w - net_flow AS flow_forward, max(wallets) OVER w AS wallets_peak
        FROM asof_ WINDOW w AS (PARTITION BY mint ORDER BY horizon ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    o AS (SELECT mint, horizon, wallets * 2.5 AS ce, wallets_peak * 2.5 AS cm, flow_forward / 100 AS bs, volume_forward AS vf, wallets_forward AS hg, net_flow AS lq FROM w),
    s AS (SELECT mint, horizon, CASE WHEN coalesce(ce >= 75 OR cm >= 80 OR (bs >= 10 AND vf > 0 AND hg >= 5) OR (lq > 0 AND ce >= 50), false) THEN 'HIGH'
            WHEN coalesce(ce >= 35 OR cm >= 45 OR (bs >= 3 AND vf > 0) OR (lq > 0 AND bs > 0) OR (hg >= 3 AND bs > 0), false) THEN 'POSITIVE' WHEN coalesce(ce >= 28 OR bs >= 2 OR (vf > 0 AND hg > 0), false) THEN 'NEAR_POSITIVE' ELSE 'LOW' END AS strength FROM o)"""


def _outcomes(spark, sf_dir):
    x = L.forward_deltas(asof(spark, sf_dir), ["mint"], ["wallets", "volume", "net_flow"])
    strength, _ = L.positive_outcome(F.col("wallets") * 2.5, (F.col("wallets") + F.col("wallets_peak")) * 2.5, F.col("net_flow_forward") / 100, F.col("volume_forward"), F.col("wallets_forward"), F.col("net_flow"))
    return x.select("mint", "horizon", strength.alias("strength"))


@query(with_views("ev", sql=_OUTCOME + " SELECT * FROM s"))
def l5_positive_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query(with_views("ev", sql=_OUTCOME + """, k AS (SELECT *, list_position(['HIGH', 'POSITIVE', 'NEAR_POSITIVE', 'LOW'], strength) AS rank FROM s), b AS (SELECT mint, min(rank) AS rank, count(*) AS horizons FROM k GROUP BY mint)
    SELECT b.mint, ['HIGH', 'POSITIVE', 'NEAR_POSITIVE', 'LOW'][b.rank] AS strength, any_value(horizons) AS horizons, min(horizon) AS first_horizon, max(horizon) AS last_horizon, CASE b.rank WHEN 1 THEN 'winner' WHEN 2 THEN 'candidate' ELSE 'rest' END AS class
    FROM b JOIN k ON k.mint = b.mint AND k.rank = b.rank GROUP BY b.mint, b.rank"""))
def l8_best_label(spark, sf_dir):
    return L.best_label(_outcomes(spark, sf_dir), ["HIGH", "POSITIVE", "NEAR_POSITIVE", "LOW"])


@query("""WITH d AS (SELECT o_custkey AS mint, max(CASE WHEN o_totalprice > 400000 THEN 3 WHEN o_totalprice > 300000 THEN 2 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS s FROM orders GROUP BY 1), m AS (SELECT unnest(range(s + 1)) AS i FROM d), c AS (SELECT i, count(*) AS mints FROM m GROUP BY i)
    SELECT ['seen', 'tracked', 'candidate', 'entered'][i + 1] AS stage, mints, mints / lag(mints) OVER (ORDER BY i) AS step_ratio FROM c""")
def p13_funnel_stages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey as mint", "case when o_totalprice > 400000 then 3 when o_totalprice > 300000 then 2 when o_orderstatus = 'F' then 1 else 0 end as stage")
    return L.funnel(o, ["seen", "tracked", "candidate", "entered"])


@query("""WITH b AS (SELECT list_filter([CASE WHEN l_discount >= 0.08 THEN 'discount' END, CASE WHEN l_tax >= 0.07 THEN 'tax' END, CASE WHEN l_quantity < 5 THEN 'size' END], lambda x: x IS NOT NULL) AS b, (l_extendedprice - 40000) / 40000 AS r FROM lineitem)
    SELECT b[1] AS blocker, count(*) AS blocked, count(*) FILTER (r > 0.25) AS recovered_winners, count(*) FILTER (r <= -0.5) AS admitted_losers FROM b WHERE len(b) = 1 GROUP BY 1""")
def p16_ablation(spark, sf_dir):
    b = F.array_compact(F.array(F.when(F.col("l_discount") >= 0.08, "discount"), F.when(F.col("l_tax") >= 0.07, "tax"), F.when(F.col("l_quantity") < 5, "size")))
    return L.ablation(table(spark, sf_dir, "lineitem").select(b.alias("b"), ((F.col("l_extendedprice") - 40000) / 40000).alias("r")), "b", "r", 0.25, -0.5)


@query(with_views("ev", sql=_ASOF + """, x AS (SELECT mint, horizon, net_flow IS NOT NULL AND buys > 0 AS complete FROM asof_), c AS (SELECT mint, count(*) FILTER (complete) AS n, max(horizon) FILTER (complete) AS reached, arg_min(horizon, horizon) FILTER (NOT complete) AS first_gap FROM x GROUP BY mint)
    SELECT mint, n AS complete_horizons, reached, CASE WHEN n = 5 THEN 'included' WHEN n = 0 THEN 'no_complete_horizon' WHEN first_gap <= 3 THEN 'early_gap' ELSE 'late_gap' END AS status FROM c"""))
def p_complete_horizons(spark, sf_dir):
    x = asof(spark, sf_dir).withColumn("complete", F.col("net_flow").isNotNull() & (F.col("buys") > 0))
    x = x.withColumn("complete", F.coalesce("complete", F.lit(False)))
    c = x.groupBy("mint").agg(F.count_if("complete").alias("complete_horizons"), F.max(F.when(F.col("complete"), F.col("horizon"))).alias("reached"), F.min(F.when(~F.col("complete"), F.col("horizon"))).alias("gap"))
    return c.select("mint", "complete_horizons", "reached", L.first_match([("included", F.col("complete_horizons") == 5), ("no_complete_horizon", F.col("complete_horizons") == 0), ("early_gap", F.col("gap") <= 3)], "late_gap").alias("status"))


_SPLIT = """f AS (SELECT user_id AS mint, min(epoch_us(ts)) AS first_us FROM events GROUP BY 1), i AS (SELECT mint, row_number() OVER (ORDER BY first_us, mint) - 1 AS i, count(*) OVER () AS n FROM f),
    s AS (SELECT mint, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.6) + 5 THEN NULL WHEN i < floor(n * 0.8) THEN 'validation' WHEN i < floor(n * 0.8) + 5 THEN NULL ELSE 'test' END AS split FROM i)"""


def _split(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("mint"), F.unix_micros(F.col("ts").cast("timestamp")).alias("first_us"))
    return L.walk_forward(e)


@query(f"WITH {_SPLIT} SELECT mint, split FROM s WHERE split IS NOT NULL")
def s1_walk_forward(spark, sf_dir):
    return _split(spark, sf_dir)


@query(f"""WITH {_SPLIT}, x AS (SELECT user_id AS mint, date_diff('day', TIMESTAMP '2024-01-01', ts) AS horizon, epoch_us(ts) AS feature_us, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS first_us FROM events WHERE event_type = 'view'),
    t AS (SELECT mint, split FROM s WHERE split IS NOT NULL UNION ALL SELECT mint, 'test' FROM s WHERE split = 'train' AND mint % 11 = 0)
    SELECT 'forbidden_column' AS check, 'first_us' AS key UNION ALL SELECT 'late_feature', concat_ws(':', mint, horizon) FROM x WHERE feature_us > first_us + horizon * 86400000000
    UNION ALL SELECT 'two_splits', mint::VARCHAR FROM t GROUP BY mint HAVING count(DISTINCT split) > 1""")
def q1_q3_leakage_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("mint"), F.datediff("ts", F.lit("2024-01-01")).alias("horizon"), F.unix_micros(F.col("ts").cast("timestamp")).alias("feature_us"))
    x = e.withColumn("first_us", F.expr("min(feature_us) over (partition by mint)"))
    s = _split(spark, sf_dir)
    twice = s.union(s.where("split = 'train' and mint % 11 = 0").select("mint", F.lit("test").alias("split")))
    return L.leakage_audit(x, ["first_us", "final_outcome"], 0, twice, _DAY)


@query("""WITH c AS (SELECT count(*) FILTER (o_totalprice > 300000) AS positive, count(*) FILTER (o_totalprice <= 300000) AS negative, count(DISTINCT o_custkey) AS mints, avg((o_orderstatus <> 'P')::INT) AS completeness FROM orders)
    SELECT *, concat_ws('|', CASE WHEN positive < 100 THEN 'positive' END, CASE WHEN negative < 500000 THEN 'negative' END, CASE WHEN completeness < 0.8 THEN 'completeness' END) AS blockers,
        CASE WHEN positive >= 100 AND negative >= 500000 AND completeness >= 0.8 THEN 'ready' ELSE 'not_ready' END AS decision FROM c""")
def s3_readiness(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = o.agg(F.count_if(F.col("o_totalprice") > 300000).alias("positive"), F.count_if(F.col("o_totalprice") <= 300000).alias("negative"), F.count_distinct("o_custkey").alias("mints"), F.avg((F.col("o_orderstatus") != "P").cast("double")).alias("completeness"))
    return L.readiness(c, {"positive": 100, "negative": 500000, "completeness": 0.8})


@query()
def s4_freeze(spark, sf_dir):
    return L.freeze(table(spark, sf_dir, "orders"), "orders").union(L.freeze(table(spark, sf_dir, "lineitem"), "lineitem"))


@query(with_views("ev", sql="""s AS (SELECT mint, min(us) AS su, arg_min(price, (us, seq)) AS sp, arg_max(price, (us, seq)) AS lp FROM ev GROUP BY mint), m AS (SELECT ev.mint, max(price / sp - 1) FILTER (us <= su + 604800000000) AS mr, min(price / sp - 1) AS low FROM ev JOIN s USING (mint) WHERE us >= su AND sp > 0 GROUP BY ev.mint),
    x AS (SELECT mint, sp, unnest(['oracle', 'real']) AS kind, unnest([sp * (1 + mr), lp]) AS z, low FROM s JOIN m USING (mint)), t AS (SELECT *, 1.0 / (sp * (1 + 1.0 / 50 + 0.01)) AS tokens FROM x), p AS (SELECT *, tokens * (z / (1 + tokens * z / 50 + 0.01)) AS proceeds FROM t),
    n AS (SELECT mint, low, max(proceeds - 1 - 0.00004 - (1 + proceeds) * 0.0125) FILTER (kind = 'oracle') AS o, max(proceeds - 1 - 0.00004 - (1 + proceeds) * 0.0125) FILTER (kind = 'real') AS r FROM p GROUP BY 1, 2)
    SELECT mint, o AS oracle_pnl, r AS realistic_pnl, o > 0 AS scalpable, low <= -0.5 AS rug, r > 0 AS profitable FROM n"""))
def k5_token_labels(spark, sf_dir):
    return K.token_labels(ev_trades(spark, sf_dir), 1.0, 50.0, 604800)


@query(with_views("ev", sql=_ASOF + """, k AS (SELECT mint, horizon, volume AS v FROM asof_ WHERE volume IS NOT NULL), p AS (SELECT a.mint, a.horizon, any_value(a.v) AS v, max(b.v) AS hi, min(b.v) AS lo, min(b.horizon) FILTER (b.v = m.hi) AS at_ FROM k AS a JOIN k AS b ON a.mint = b.mint AND b.horizon >= a.horizon
        JOIN (SELECT x.mint, x.horizon, max(y.v) AS hi FROM k AS x JOIN k AS y ON x.mint = y.mint AND y.horizon >= x.horizon GROUP BY 1, 2) AS m ON m.mint = a.mint AND m.horizon = a.horizon GROUP BY 1, 2)
    SELECT mint, horizon, hi - v AS favourable, lo - v AS adverse, at_ - horizon AS time_to_peak, hi > v AND at_ - horizon >= 4 AS could_exit FROM p"""))
def l6_validation_rows(spark, sf_dir):
    return L.validation_rows(asof(spark, sf_dir), ["mint"], "volume", 4)


#: Horizons of the as-of features, in days.
_DAYS = [1, 3, 7, 14, 28]


@query(with_views("ev", sql=f"""
    la AS (SELECT mint, min(us) AS first_us FROM ev GROUP BY 1), g AS (SELECT mint, first_us, unnest({_DAYS}) AS horizon FROM la), z AS (SELECT max(us) AS last_us FROM ev), h AS (SELECT *, first_us + horizon * 86400000000 AS asof_us, first_us + horizon * 86400000000 <= last_us AS reached, lag(first_us + horizon * 86400000000) OVER (PARTITION BY mint ORDER BY horizon) AS prev_us FROM g, z),
    x AS (SELECT *, sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) OVER o AS bal, sum(CASE WHEN side = 'buy' THEN quote ELSE -quote END) OVER m AS liq, sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) OVER m AS res FROM ev WINDOW o AS (PARTITION BY mint, wallet ORDER BY us, seq ROWS UNBOUNDED PRECEDING), m AS (PARTITION BY mint ORDER BY us, seq ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT *, coalesce(lag(round(bal, 6)) OVER (PARTITION BY mint, wallet ORDER BY us, seq), 0) AS was FROM x), cr AS (SELECT mint, min(wallet) AS dev FROM ev WHERE side = 'buy' GROUP BY 1),
    t AS (SELECT h.mint, horizon, asof_us, reached, b.* EXCLUDE mint, us > coalesce(prev_us, first_us - 1) AS fresh FROM h LEFT JOIN b ON b.mint = h.mint AND us <= asof_us),
    w AS (SELECT mint, horizon, wallet, arg_max(round(bal, 6), (us, seq)) AS bal FROM t WHERE wallet IS NOT NULL GROUP BY 1, 2, 3),
    hs AS (SELECT mint, horizon, count(*) FILTER (bal > 0) AS holders, sum(greatest(bal, 0)) AS supply, max(bal) AS top, max(greatest(bal, 0)) FILTER (wallet = dev) AS dv, count(*) AS wallets FROM w LEFT JOIN cr USING (mint) GROUP BY 1, 2),
    pk AS (SELECT *, max(holders) OVER (PARTITION BY mint ORDER BY horizon) AS peak FROM hs),
    a AS (SELECT mint, horizon, any_value(asof_us) AS asof_us, any_value(reached) AS reached, count(seq) AS n, count(*) FILTER (side = 'buy') AS nb, count(*) FILTER (side = 'sell') AS ns, coalesce(sum(quote), 0) AS v, max(us) AS last_us, count(*) FILTER (fresh) AS recent, count(*) FILTER (round(bal, 6) > 0 AND was <= 0) AS come, count(*) FILTER (round(bal, 6) <= 0 AND was > 0) AS go,
        count(*) FILTER (seq % 2 = 0) AS vaults, count(*) FILTER (seq % 2 = 1) AS curves, arg_max(liq, (us, seq)) - arg_min(liq, (us, seq)) AS dl, arg_max(res, (us, seq)) - arg_min(res, (us, seq)) AS dr, arg_max(least(100, greatest(0, res / 10)), (us, seq)) AS progress, arg_max(liq, (us, seq)) AS ll, max(liq) AS lt, arg_max(price, (us, seq)) AS lp, arg_min(price, (us, seq)) AS fp FROM t GROUP BY 1, 2)
    SELECT mint, horizon, asof_us, reached, {', '.join(f'CASE WHEN reached THEN {v} END AS {n}' for n, v in {
        'trade_update_count_asof': 'n', 'buy_count_delta_asof': 'nb', 'sell_count_delta_asof': 'ns', 'net_buy_sell_delta_asof': 'nb - ns', 'volume_delta_asof': 'v', 'unique_trade_accounts_asof': 'coalesce(wallets, 0)', 'last_trade_age_ms_asof': '(asof_us - last_us) // 1000', 'trade_burst_score_asof': 'CASE WHEN n > 0 THEN recent / n END',
        'trade_direction_imbalance_asof': 'CASE WHEN n > 0 THEN (nb - ns) / n END', 'holder_update_count_asof': 'n', 'unique_holder_accounts_seen_asof': 'coalesce(wallets, 0)', 'top_holder_concentration_asof': 'CASE WHEN supply > 0 THEN top / supply END', 'dev_or_creator_holding_proxy_asof': 'CASE WHEN supply > 0 THEN coalesce(dv, 0) / supply END',
        'holder_churn_proxy_asof': 'CASE WHEN come > 0 THEN go / come END', 'holder_collapse_proxy_asof': 'CASE WHEN peak > 0 THEN 1 - holders / peak END', 'new_holder_count_delta_asof': 'come', 'exiting_holder_count_delta_asof': 'go', 'vault_update_count_asof': 'vaults', 'bonding_curve_update_count_asof': 'curves', 'liquidity_delta_asof': 'dl', 'reserve_delta_asof': 'dr',
        'curve_progress_proxy_asof': 'progress', 'liquidity_exit_proxy_asof': 'CASE WHEN lt > 0 THEN 1 - ll / lt END', 'price_or_curve_move_proxy_asof': 'CASE WHEN fp > 0 THEN lp / fp - 1 END'}.items())}
    FROM a LEFT JOIN pk USING (mint, horizon)"""))
def l3_alpha_features(spark, sf_dir):
    """The curve's state after each trade is what the trades have put in and taken out; even event ids change the vault, odd ones the curve account."""
    from ..operators.ledger import balance_history

    t = ev_trades(spark, sf_dir)
    labels = t.groupBy("mint").agg(F.min("us").alias("first_us")).join(t.agg(F.max("us").alias("last_us")))
    order = Window.partitionBy("mint").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    signed = lambda c: F.sum(F.when(F.col("side") == "buy", F.col(c)).otherwise(-F.col(c))).over(order)
    curve = t.select("mint", "us", "seq", (F.col("seq") % 2 == 0).alias("vault"), signed("quote").alias("liquidity"), signed("tokens").alias("reserve"), "price").withColumn("progress", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("reserve") / 10)))
    creators = t.where("side = 'buy'").groupBy("mint").agg(F.min("wallet").alias("wallet"))
    return A.alpha_features(t, balance_history(t), curve, creators, labels, _DAYS, _DAY)


@query("SELECT 'orders' AS dataset, count(*) AS rows, sum(o_orderkey) AS keys FROM orders UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey) FROM lineitem")
def s4_freeze_counts(spark, sf_dir):
    """The manifest's counts, and the sum of each dataset's keys, which SQL can rebuild; the hash is in s4_freeze."""
    count = lambda name, key: L.freeze(table(spark, sf_dir, name), name).select("dataset", "rows").join(table(spark, sf_dir, name).agg(F.sum(key).alias("keys")))  # noqa: E731, one row each
    return count("orders", "o_orderkey").union(count("lineitem", "l_orderkey"))
