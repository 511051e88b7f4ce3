"""Risk, composite and decision scores as row expressions over a wide feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import clamp01, known
from .costs import FEES, trip

# The weights of each risk over its parts; a part is a feature, or is built from features in _PARTS below.
WEIGHTS: dict[str, dict[str, float]] = {
    "rug": {"rug_probability_score": 0.35, "dev_sold": 0.20, "collapse": 0.20, "holder_growth_stalled": 0.08, "sells_dominate_after_launch": 0.07, "concentration_risk_score": 0.05, "poor_data": 0.05, "malicious_sell_intent_score": 0.08, "early_exit": 0.10},
    "bundle": {"bundle_risk_score": 0.50, "same_slot_multi_buy_count/8": 0.15, "first_n_buys_identical_amount_count/8": 0.15, "first_n_buys_same_funder_count/8": 0.10, "bundle_wallets_top_holder_pct": 0.10, "tentative_sell_from_bundle_count/4": 0.15, "warning": 0.10},
    "dev": {"dev_sold": 0.40, "creator_is_top1_holder": 0.15, "creator_retained_supply_pct": 0.15, "creator_launches_last_1h/5": 0.10, "creator_reuses_same_payer": 0.10, "creator_launching_spam_wave_flag": 0.10, "clustered": 0.10, "tentative_sell_from_dev_count/3": 0.20, "warning": 0.10},
    "top_holder": {"concentration_risk_score": 0.30, "profit_overhang_score": 0.20, "free_roll_dump_risk_score": 0.15, "top_holders_same_funder_pct": 0.10, "top_holders_same_client_fingerprint_pct": 0.10, "price_up_top_holders_selling": 0.10, "top1_holder_pct": 0.05, "tentative_sell_from_top_holder_count/4": 0.15},
    "fake_momentum": {"vertical_move_without_holder_growth": 0.18, "vertical_move_without_unique_buyers": 0.15, "price_up_no_retail_breadth": 0.15, "price_up_top_holders_selling": 0.15, "price_up_bundle_selling": 0.10, "price_up_dev_selling": 0.10, "price_up_only_one_or_two_large_buys": 0.07, "price_up_buy_size_concentration_high": 0.05, "exit_liquidity_trap_score": 0.08, "extreme": 0.07, "dev_sold_flag": 0.05, "unauthentic": 0.07, "rug_overlap": 0.05, "warning": 0.06},
    "fake_momentum_relief": {"absorption_success_score": 0.20, "holder_stickiness_score": 0.12},
    "data_quality": {"poor_data": 0.60, "critical_feature_missing_count/5": 0.25, "source_disagreement_flag": 0.15, "shred_signal_stale_flag": 0.10},
    "overall": {"rug": 0.30, "bundle": 0.15, "dev": 0.15, "top_holder": 0.15, "fake_momentum": 0.15, "data_quality": 0.10},
    "momentum": {"return_pct_30s": 0.45, "organic_flow_score": 0.35, "token_relative_strength_score": 0.20},
    "holder_quality": {"sustained_holder_growth_score": 0.5, "1-concentration_risk_score": 0.3, "1-holder_balance_hhi": 0.2},
    "anti_rug": {"organic_survival_score": 0.7, "1-rug": 0.3},
    "eligibility": {"momentum": 0.20, "holder_quality": 0.20, "fee_adjusted_edge": 0.20, "liquidity": 0.10, "latency": 0.05, "relative_strength": 0.10, "stickiness": 0.10, "absorption": 0.05, "rotation": 0.05, "overhang": 0.05, "authenticity": 0.05, "anti_rug": 0.05},
    "edge_penalty": {"rug": 0.30, "bundle": 0.15, "top_holder": 0.15, "fake_momentum": 0.20, "profit_overhang_score": 0.10, "fee_war_score": 0.10},
    "size_penalty": {"rug": 0.4, "bundle": 0.2, "top_holder": 0.2, "fake_momentum": 0.2},
    "eligibility_penalty": {"rug": 0.35, "bundle": 0.20, "top_holder": 0.15, "fake_momentum": 0.15, "data_quality": 0.15},
}
# Features that each risk misses, thresholds of the discard policy, of the entry gates, of what an edge must reach, and sizes in quote units.
NEEDED = {"rug": ["rug_probability_score", "dev_sold_pct"], "bundle": ["bundle_risk_score"], "dev": ["dev_sold_pct"], "top_holder": ["top1_holder_pct", "profit_overhang_score", "free_roll_dump_risk_score"], "fake_momentum": ["vertical_move_without_holder_growth", "momentum_authenticity_score"], "data_quality": ["data_quality_score", "critical_feature_missing_count"]}
POLICY = {"hard_rug": 0.85, "soft_bundle": 0.75, "top_holder": 0.75, "fake_momentum": 0.70, "min_quality": 0.50}
ENTRY = {"max_rug": 0.45, "max_bundle": 0.55, "max_fake": 0.50, "min_quality": 0.75, "min_fee_edge": 0.008, "min_eligibility": 0.30, "min_stickiness": 0.20, "min_authenticity": 0.15, "max_overhang": 0.90}
EDGE = {"min_quote": 0.02, "min_pct": 0.01, "min_confidence": 0.35, "fee_margin": 1.20, "latency_margin": 1.20}
SIZES = {"max_daily_loss": 500.0, "max_position": 1.50}
# Take profit, trailing stop, stop loss and longest holding time of each strategy.
PROFILES = {
    "LaunchMomentumScalp": (0.18, 0.08, 0.09, 20_000),
    "HolderGrowthContinuation": (0.28, 0.12, 0.12, 90_000),
    "SellAbsorptionBounce": (0.14, 0.07, 0.08, 35_000),
    "SmartCapitalRotation": (0.20, 0.10, 0.10, 60_000),
    "OrganicSlowGrind": (0.24, 0.10, 0.11, 120_000),
    "DefensiveNoTrade": (0.24, 0.10, 0.11, 120_000),
}
# What each strategy's expected edge is a weighted mean of.
MIXES: dict[str, dict[str, float]] = {
    "LaunchMomentumScalp": {"rise": 0.25, "token_relative_strength_score": 0.20, "momentum_authenticity_score": 0.30, "organic_flow_score": 0.25},
    "HolderGrowthContinuation": {"sustained_holder_growth_score": 0.30, "holder_stickiness_score": 0.30, "token_relative_strength_score": 0.20, "organic_survival_score": 0.20},
    "SellAbsorptionBounce": {"absorption_success_score": 0.40, "momentum_authenticity_score": 0.25, "holder_stickiness_score": 0.20, "organic_flow_score": 0.15},
    "SmartCapitalRotation": {"smart_capital_rotation_score": 0.35, "token_relative_strength_score": 0.25, "holder_stickiness_score": 0.20, "momentum_authenticity_score": 0.20},
    "OrganicSlowGrind": {"organic_survival_score": 0.35, "holder_stickiness_score": 0.25, "sustained_holder_growth_score": 0.20, "1-bundle": 0.20},
}


def _f(name: str) -> Column:
    return known(F.col(name))


_PARTS = {
    "dev_sold": lambda: F.greatest(_f("dev_sold_pct"), _f("dev_sold_flag")),
    "collapse": lambda: F.greatest(_f("price_drop_70pct_from_launch_within_5m"), clamp01((_f("drawdown_from_ath_pct") - 0.70) / 0.30)),
    "poor_data": lambda: 1 - _f("data_quality_score"),
    "early_exit": lambda: F.greatest(_f("shred_emergency_exit_triggered_flag"), _f("shred_sell_warning_level") / 4),
    "warning": lambda: _f("shred_sell_warning_level") / 4,
    "clustered": lambda: F.lit(0.1) * _f("developer_in_cluster"),
    "extreme": lambda: clamp01((_f("top1_holder_pct") - 0.65) / 0.35),
    "unauthentic": lambda: 1 - _f("momentum_authenticity_score"),
    "rug_overlap": lambda: _f("rug_probability_score") / 2,
    "rise": lambda: F.greatest(_f("return_pct_30s"), F.lit(0.0)),
}


def part(name: str) -> Column:
    """A weight's part: a named build, `x/n` a count by n within 0 to 1, `1-x`, or a feature; missing counts as 0."""
    if name in _PARTS:
        return _PARTS[name]()
    if "/" in name:
        feature, n = name.split("/")
        return clamp01(_f(feature) / float(n))
    return 1 - _f(name[2:]) if name.startswith("1-") else _f(name)


def weighted_score(table: str | dict[str, float]) -> Column:
    w = WEIGHTS[table] if isinstance(table, str) else table
    return sum((part(p) * x for p, x in list(w.items())[1:]), part(next(iter(w))) * next(iter(w.values()))) / sum(w.values())


def severity(score: Column) -> Column:
    return F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.35, "medium").otherwise("low")


def missing_penalty(names: list[str]) -> Column:
    """The part of the needed features that is missing."""
    return sum((F.col(n).isNull().cast("double") for n in names[1:]), F.col(names[0]).isNull().cast("double")) / float(len(names))


def _codes(**table: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in table.items()]))


def _ladder(score: Column, *steps: tuple[float, str], other: str = "KeepWatching") -> Column:
    out = F.when(F.lit(False), other)
    for at, name in steps:
        out = out.when(score >= at, name)
    return out.otherwise(other)


RISKS = ["rug", "bundle", "dev", "top_holder", "fake_momentum", "data_quality"]


def risks(features: DataFrame) -> DataFrame:
    """Adds the six risks' scores, a struct `<risk>_risk` of each (confidence, severity, reasons, missing_penalty, action), and the overall
    score and confidence, discard policy and sorted reasons. Features that were never registered count as 0 where absent."""
    features.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")  # rows this wide make longer methods, which the JVM doesn't compile
    extra = [c for c in ("rug_confidence", "bundle_confidence", "account_update_gap_flag", "transaction_stream_gap_flag", "slot_status_gap_flag") if c not in features.columns]
    x = features.withColumns({c: F.lit(None).cast("double") for c in extra}) if extra else features
    x = x.withColumns({n: clamp01(weighted_score(n)) for n in RISKS if n != "fake_momentum"} | {"fake_momentum": clamp01(weighted_score("fake_momentum") - weighted_score("fake_momentum_relief"))})
    on = lambda c: _f(c) > 0
    sold, warned = _PARTS["dev_sold"]() > 0, _f("shred_sell_warning_level")
    collapse = on("price_drop_70pct_from_launch_within_5m") | (clamp01((_f("drawdown_from_ath_pct") - 0.70) / 0.30) >= 0.5)
    gap = on("account_update_gap_flag") | on("transaction_stream_gap_flag") | on("slot_status_gap_flag") | on("source_disagreement_flag") | on("shred_signal_stale_flag")
    stopped = _f("trade_allowed_data_quality_flag") == 0
    extreme = (clamp01((_f("top1_holder_pct") - 0.65) / 0.35) > 0) & on("dev_sold_flag")
    faked = on("vertical_move_without_holder_growth") | on("vertical_move_without_unique_buyers") | on("price_up_no_retail_breadth") | on("price_up_top_holders_selling") | on("price_up_bundle_selling") | on("price_up_dev_selling") | on("price_up_buy_size_concentration_high") | extreme
    s = {n: F.col(n) for n in RISKS}
    reasons = {
        "rug": _codes(DevSoldEarly=sold, PriceCollapse70=collapse, NoBuyGap=on("no_buys_for_x_seconds"), ShredSellImpactHigh=(warned >= 3) | on("shred_emergency_exit_triggered_flag"), HighRugRisk=s["rug"] >= 0.7),
        "bundle": _codes(BundleConcentration=on("first_n_buys_same_funder_count"), ShredBundleExitWarning=on("tentative_sell_from_bundle_count"), HighBundleRisk=s["bundle"] >= 0.40),
        "dev": _codes(DevSoldEarly=sold, ShredDevSellWarning=on("tentative_sell_from_dev_count")),
        "top_holder": _codes(TopHolderDump=on("one_wallet_controls_market_flag") | on("price_up_top_holders_selling") | (_f("top1_holder_pct") >= 0.55), ShredTopHolderSellWarning=on("tentative_sell_from_top_holder_count"), HighTopHolderRisk=s["top_holder"] >= 0.7),
        "fake_momentum": _codes(HighFakeMomentumRisk=faked),
        "data_quality": _codes(DataGapActive=stopped & gap),
    }
    half = lambda c: F.greatest(_f(c), F.lit(0.5))
    confidence = {"rug": half("rug_confidence"), "bundle": half("bundle_confidence"), "dev": F.lit(0.75), "top_holder": F.lit(0.8), "fake_momentum": F.lit(0.7), "data_quality": F.lit(0.9)}
    action = {
        "rug": F.when(collapse | (s["rug"] >= 0.9), "HardDiscard").otherwise(_ladder(s["rug"], (0.75, "RugArchive"), (0.60, "SoftDiscard"))),
        "bundle": _ladder(s["bundle"], (0.85, "HardDiscard"), (0.70, "SoftDiscard")),
        "dev": _ladder(s["dev"], (0.75, "SoftDiscard")),
        "top_holder": _ladder(s["top_holder"], (0.8, "SoftDiscard")),
        "fake_momentum": _ladder(s["fake_momentum"], (0.8, "SoftDiscard")),
        "data_quality": F.when(gap & ((_f("data_quality_score") < POLICY["min_quality"]) | stopped), "DataGapStop").otherwise("KeepWatching"),
    }
    x = x.withColumns({f"{n}_risk": F.struct(confidence[n].alias("confidence"), severity(s[n]).alias("severity"), reasons[n].alias("reasons"), missing_penalty(NEEDED[n]).alias("missing_penalty"), action[n].alias("action")) for n in RISKS})
    r = {n: F.col(f"{n}_risk") for n in RISKS}
    policy = (
        F.when(r["data_quality"]["action"] == "DataGapStop", "DataGapStop")
        .when((s["rug"] >= POLICY["hard_rug"]) | F.array_contains(r["rug"]["reasons"], "PriceCollapse70"), F.when(s["dev"] >= 0.6, "RugArchive").otherwise("HardDiscard"))
        .when(F.array_contains(r["dev"]["reasons"], "DevSoldEarly") & ((s["top_holder"] >= 0.30) | (s["fake_momentum"] >= 0.40) | (s["rug"] >= 0.25)), "SoftDiscard")
        .when((s["bundle"] >= POLICY["soft_bundle"]) | (s["top_holder"] >= POLICY["top_holder"]) | (s["fake_momentum"] >= POLICY["fake_momentum"]), "SoftDiscard")
        .when((s["rug"] >= 0.60) | (s["dev"] >= 0.65), "ResearchSample")
        .otherwise("Keep")
    )
    w = WEIGHTS["overall"]
    sure = sum((r[n]["confidence"] * w[n] for n in RISKS[1:]), r["rug"]["confidence"] * w["rug"]) / sum(w.values())
    x = x.withColumns({"overall": clamp01(weighted_score("overall")), "overall_confidence": sure, "policy": policy})
    told = F.when(F.col("policy") == "SoftDiscard", F.array(F.lit("SoftDiscarded"))).when(F.col("policy") == "HardDiscard", F.array(F.lit("HardDiscarded"))).when(F.col("policy") == "DataGapStop", F.array(F.lit("DataGapActive"))).otherwise(F.array().cast("array<string>"))
    x = x.withColumns({"severity": severity(F.col("overall")), "reasons": F.array_sort(F.array_distinct(F.concat(*[r[n]["reasons"] for n in RISKS], told)))})
    return x.drop(*extra)


def composites(scored: DataFrame) -> DataFrame:
    """Adds the thirteen composite scores to a table with risks: `<score>_raw`, `<score>` (less half the penalty) and `<score>_confidence`.

    The edge after fees is a round trip of a twentieth of the largest daily loss, out at the price after the last 30 s'
    rise; depth (missing or not positive: 100) is the curve's quote reserves.
    """
    size = SIZES["max_daily_loss"] / 20
    price = F.greatest(_f("latest_price"), F.lit(1e-9))
    depth = F.when(_f("depth_quote") > 0, _f("depth_quote")).otherwise(F.lit(100.0))
    net = trip(F.lit(size), price, price * (1 + _PARTS["rise"]()), depth)["net_pnl"]
    raw = {
        "momentum": (weighted_score("momentum"), F.col("fake_momentum") / 2),
        "holder_quality": (weighted_score("holder_quality"), F.col("top_holder") / 2),
        "fee_adjusted_edge": (clamp01((net / size + 1) / 2), F.col("bundle") / 3),
        "liquidity": (_f("quote_asset_specific_depth_score"), None),
        "latency": (_f("latency_adjusted_trade_eligibility"), None),
        "relative_strength": (_f("token_relative_strength_score"), None),
        "stickiness": (_f("holder_stickiness_score"), None),
        "absorption": (_f("absorption_success_score"), None),
        "rotation": (_f("smart_capital_rotation_score"), None),
        "overhang": (1 - _f("profit_overhang_score"), F.col("top_holder") / 3),
        "authenticity": (_f("momentum_authenticity_score"), F.col("fake_momentum") / 3),
        "anti_rug": (weighted_score("anti_rug"), F.col("rug") / 2),
    }

    def three(name: str, value: Column, penalty: Column | None) -> dict[str, Column]:
        penalty = F.lit(0.0) if penalty is None else penalty
        return {f"{name}_raw": clamp01(value), name: clamp01(value - penalty / 2), f"{name}_confidence": clamp01(1 - penalty)}

    out: dict[str, Column] = {}
    for name, (value, penalty) in raw.items():
        out |= three(name, value, penalty)
    x = scored.withColumns(out)
    return x.withColumns(three("eligibility", weighted_score("eligibility"), weighted_score("eligibility_penalty")))


def strategy() -> Column:
    """The first strategy whose conditions hold."""
    c, fake = F.col, F.array_contains("reasons", "HighFakeMomentumRisk")
    calm = (c("fake_momentum") < 0.30) & ~fake
    return (
        F.when((c("rug") >= 0.7) | (c("data_quality") >= 0.75), "DefensiveNoTrade")
        .when((c("holder_quality") >= 0.36) & (_f("holder_stickiness_score") >= 0.22) & (_f("organic_survival_score") >= 0.30) & (_f("token_relative_strength_score") >= 0.45) & calm, "HolderGrowthContinuation")
        .when((c("momentum") >= 0.48) & (_f("momentum_authenticity_score") >= 0.45) & calm, "LaunchMomentumScalp")
        .when((_f("absorption_success_score") >= 0.22) & (_f("holder_stickiness_score") >= 0.15) & (c("bundle") < 0.65) & (c("top_holder") < 0.75) & (c("fake_momentum") < 0.60), "SellAbsorptionBounce")
        .when((_f("smart_capital_rotation_score") >= 0.12) & (c("momentum") >= 0.15), "SmartCapitalRotation")
        .when((_f("organic_survival_score") >= 0.30) & (c("holder_quality") >= 0.25) & (c("bundle") < 0.60), "OrganicSlowGrind")
        .otherwise("DefensiveNoTrade")
    )


def _profile(i: int, of: str = "strategy") -> Column:
    out = F.lit(PROFILES["DefensiveNoTrade"][i])
    for name, p in PROFILES.items():
        out = F.when(F.col(of) == name, F.lit(p[i])).otherwise(out)
    return out


def expected_edge(x: DataFrame) -> DataFrame:
    """Adds what a trade of `strategy` is expected to give and cost; x has composites, latest_price, depth_quote, buy_volume, sell_volume."""
    mix = F.lit(0.0)
    for name, weights in MIXES.items():
        mix = F.when(F.col("strategy") == name, weighted_score(weights)).otherwise(mix)
    x = x.withColumns({"qualitative": mix, "edge_penalty": weighted_score("edge_penalty")})
    q, p = F.col("qualitative"), F.col("edge_penalty")
    x = x.withColumns({"edge_confidence": clamp01(q * 0.60 + (1 - p) * 0.20 + F.coalesce(F.col("data_quality_score").cast("double"), F.lit(0.5)) * 0.20), "expected_move": clamp01(_profile(0) * clamp01(q) * clamp01(1 - p / 2))})
    size = max(min(SIZES["max_position"], SIZES["max_daily_loss"] / 10), 0.25)
    price = F.greatest(_f("latest_price"), F.lit(1e-9))
    depth = F.when(_f("depth_quote") > 0, _f("depth_quote")).otherwise(_f("buy_volume") + _f("sell_volume") + 50)
    t = trip(F.lit(size), price, price * (1 + F.col("expected_move")), depth)
    x = x.withColumns({"fee_drag": t["fees"], "impact_drag": size * (t["buy_impact"] + t["sell_impact"]), "trip_net": t["net_pnl"]})
    slip = size * 2 * FEES["slippage_bps"] / 10_000
    late = size * (1 - F.coalesce(F.col("latency_adjusted_trade_eligibility").cast("double"), F.lit(0.5))) * 0.10 * EDGE["latency_margin"]
    failed = 0.0  # a planned trip holds no failed transaction, so its expected cost is nothing
    costs = F.col("fee_drag") + slip + F.col("impact_drag")
    net = F.col("trip_net") - costs * (EDGE["fee_margin"] - 1) - late - failed
    x = x.withColumns({"slippage_drag": F.lit(slip), "latency_drag": late, "required_move": (costs + late + failed) / size, "net_edge_quote": net, "net_edge_pct": net / size})
    short = (F.col("net_edge_quote") <= EDGE["min_quote"]) | (F.col("net_edge_pct") <= EDGE["min_pct"])
    return x.withColumn("edge_reasons", _codes(FeeAdjustedEdgeTooLow=short, FeeWarTooExpensive=_f("fee_war_score") >= 0.60)).drop("qualitative", "edge_penalty", "trip_net")


def position_size() -> Column:
    """Quote units, by eligibility, depth and risk."""
    depth = F.when(_f("depth_quote") > 0, _f("depth_quote")).otherwise(_f("buy_volume") + _f("sell_volume") + 25)
    size = SIZES["max_daily_loss"] / 10 * F.col("eligibility") * clamp01(depth / 500) * clamp01(1 - weighted_score("size_penalty"))
    return F.least(size, F.lit(SIZES["max_daily_loss"] / 2), F.lit(SIZES["max_position"]))


def decide(x: DataFrame, paper: bool = True) -> DataFrame:
    """Adds strategy, the expected edge, size, decision, blocked_by and decision_reasons; gates in order, the first that fails decides.

    x: the rows of `composites` with lifecycle, unique_buyers, holders, early_level (0 none to 4), early_confidence.
    """
    x = expected_edge(x.withColumn("strategy", strategy()))
    c, e = F.col, ENTRY
    in_position = c("lifecycle") == "InPosition"
    stop = F.when(in_position, "EmergencyExit").otherwise("StopTracking")
    risky = (c("rug") >= e["max_rug"]) | (c("bundle") >= e["max_bundle"]) | (c("fake_momentum") >= e["max_fake"])
    ended = c("lifecycle").isin("ExitPending", "Completed", "SoftDiscarded", "HardDiscarded", "RugArchive", "Migrated", "DataGap")
    warned, unsure = _f("early_level") >= 2, _f("early_confidence") < 0.55
    concentrated = F.arrays_overlap(c("bundle_risk")["reasons"], F.array(F.lit("BundleConcentration"), F.lit("HighBundleRisk")))
    ready = (c("net_edge_quote") > EDGE["min_quote"]) & (c("net_edge_pct") > EDGE["min_pct"]) & (c("edge_confidence") >= EDGE["min_confidence"])
    enter = (
        (c("strategy") != "DefensiveNoTrade") & (c("eligibility") >= e["min_eligibility"]) & ((_f("unique_buyers") >= 3) | (_f("holders") >= 3)) & (c("bundle") < max(e["max_bundle"] - 0.10, 0.30)) & ~concentrated
        & ~F.array_contains("reasons", "HighFakeMomentumRisk") & (~warned | unsure) & (_f("holder_stickiness_score") >= e["min_stickiness"]) & (_f("momentum_authenticity_score") >= e["min_authenticity"]) & (_f("profit_overhang_score") <= e["max_overhang"]) & ready
    )
    watch = F.when(c("strategy") == "DefensiveNoTrade", "WatchLight").when(c("eligibility") >= max(e["min_eligibility"] / 2, 0.15), "WatchDeep").otherwise("WatchLight")
    gap = (c("data_quality_risk")["action"] == "DataGapStop") | (c("policy") == "DataGapStop")
    blocked = F.when(gap, "data_gap").when(risky, "risk").when(_f("data_quality_score") < e["min_quality"], "data_quality").when(c("fee_adjusted_edge_raw") < e["min_fee_edge"], "fee_edge").when(ended, "lifecycle")
    x = x.withColumn("blocked_by", blocked)
    decision = F.when(c("blocked_by").isin("data_gap", "risk"), stop).when(c("blocked_by") == "data_quality", "WatchLight").when(c("blocked_by") == "fee_edge", "WatchDeep").when(c("blocked_by") == "lifecycle", "StopTracking").when(enter, "EnterPaper" if paper else "WatchDeep").otherwise(watch)
    x = x.withColumn("decision", decision)
    open_ = c("blocked_by").isNull()
    own = _codes(
        DataGapActive=c("blocked_by").isin("data_gap", "data_quality"),
        HighRugRisk=(c("blocked_by") == "risk") & (c("rug") >= e["max_rug"]),
        HighBundleRisk=(c("blocked_by") == "risk") & (c("bundle") >= e["max_bundle"]),
        HighFakeMomentumRisk=(c("blocked_by") == "risk") & (c("fake_momentum") >= e["max_fake"]),
        FeeAdjustedEdgeTooLow=c("blocked_by") == "fee_edge",
        EarlyIntentSellWarning=open_ & warned & ~unsure,
        EnterPaper=c("decision") == "EnterPaper",
        ExitPaper=c("decision") == "EmergencyExit",
        LiveDisabled=F.lit(True),
    )
    return x.withColumns({"size": position_size(), "decision_reasons": F.array_sort(F.array_distinct(F.concat(own, "reasons")))})


def exit_decision(x: DataFrame) -> DataFrame:
    """Adds decision and exit_by to rows of an open position beside a later snapshot with risks.

    x: size_tokens, size_quote, entry_fees, best_gain (quote units), held_ms, strategy, latest_price, exit_triggered, exit_armed and the features.
    """
    c, e = F.col, ENTRY
    gain = F.when(c("size_quote") > 0, (c("size_tokens") * c("latest_price") - c("size_quote") - c("entry_fees")) / c("size_quote")).otherwise(F.lit(0.0))
    floor = F.when(c("size_quote") > 0, c("best_gain") / c("size_quote")).otherwise(F.lit(0.0)) - _profile(1)
    x = x.withColumns({"gain": gain, "floor": floor})
    armed = F.coalesce(c("exit_armed"), F.lit(False))
    decay = {
        "LaunchMomentumScalp": (_f("momentum_authenticity_score") < 0.15) | (_f("return_pct_30s") < 0),
        "HolderGrowthContinuation": (_f("holder_stickiness_score") < e["min_stickiness"]) | (_f("profit_overhang_score") > e["max_overhang"]) | (c("top_holder") > 0.55),
        "SellAbsorptionBounce": (_f("absorption_success_score") < 0.12) | (c("fake_momentum") > 0.55),
        "SmartCapitalRotation": (_f("smart_capital_rotation_score") < 0.10) | (_f("token_relative_strength_score") < 0.15),
        "OrganicSlowGrind": (_f("organic_survival_score") < 0.25) | (c("bundle") > 0.60),
    }
    fading = F.lit(True)
    for name, cond in decay.items():
        fading = F.when(c("strategy") == name, cond).otherwise(fading)
    by = (
        F.when(F.coalesce(c("exit_triggered"), F.lit(False)), "shred_emergency_exit")
        .when(armed, "shred_exit_armed")
        .when((c("rug") >= 0.75) | (c("fake_momentum") >= 0.75) | (c("bundle") >= 0.80), "emergency_risk")
        .when(c("gain") >= _profile(0), "take_profit")
        .when(c("gain") <= -_profile(2), "stop_loss")
        .when((c("best_gain") > 0) & (c("gain") <= c("floor")), "trailing_stop")
        .when(c("held_ms") >= _profile(3), "max_hold")
        .when(fading, "strategy_decay")
    )
    x = x.withColumn("exit_by", by)
    b = F.col("exit_by")
    return x.withColumn("decision", F.when(b.isin("shred_emergency_exit", "emergency_risk"), "EmergencyExit").when(b.isNull() | (b == "shred_exit_armed"), "Hold").otherwise("Exit"))


def evidence(features: DataFrame, families: dict[str, list[str]], key: str) -> DataFrame:
    """Diagnostic rows: (key, available, unavailable, total, classification) over evidence families (mean of what is known of each)."""
    parts = []
    for name, cols in families.items():
        there = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
        mean = sum((_f(c) for c in cols[1:]), _f(cols[0])) / F.greatest(there, F.lit(1))
        parts.append(F.struct(F.lit(name).alias("name"), F.when(there > 0, mean).alias("value")))
    e = F.array(*parts)
    live = F.filter(e, lambda v: v["value"].isNotNull())
    total = F.when(F.size(live) > 0, F.aggregate(live, F.lit(0.0), lambda a, v: a + v["value"]) / F.size(live))
    gone = F.array_join(F.array_sort(F.transform(F.filter(e, lambda v: v["value"].isNull()), lambda v: v["name"])), ",")
    return features.select(key, F.size(live).alias("available"), gone.alias("unavailable"), total.alias("total"), F.when(total.isNull(), "unavailable").when(total >= 0.6, "elevated").when(total >= 0.4, "mixed").otherwise("calm").alias("classification"))


def rules(features: DataFrame, table: list[tuple[str, list[str], Column, int]], key: str) -> DataFrame:
    """(key, rule, outcome) of table-driven early rules (name, needed columns, predicate, earliest second): hit, miss, too_early or unavailable."""
    out = [F.struct(F.lit(n).alias("rule"), F.when(F.col("age_seconds") < t, "too_early").when(F.greatest(*[F.col(c).isNull() for c in need], F.lit(False)), "unavailable").when(p, "hit").otherwise("miss").alias("outcome")) for n, need, p, t in table]
    return features.select(key, F.explode(F.array(*out)).alias("r")).select(key, "r.*")
