"""Research gates over as-of rows: each gives a decision and its reason codes, as columns.

A gate is a table of reasons (name to condition, in order) and a first-match list of decisions. Flags that are missing
count as false, numbers that are missing as 0 except where a bin says MISSING. No gate decides a trade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import descriptive_bin, risk_bin
from ..functions.text import slug
from .labels import first_match

# The columns that make up a group of as-of features.
GROUPS = {
    "trade_delta": ["trade_update_count_asof", "buy_count_delta_asof", "sell_count_delta_asof"],
    "holder_state": ["holder_update_count_asof", "unique_holder_accounts_seen_asof", "top_holder_concentration_asof"],
    "vault_curve": ["vault_update_count_asof", "bonding_curve_update_count_asof", "curve_progress_proxy_asof"],
}
# Reasons that stand before all others when the first failed gate is named.
GATE_ORDER = [
    "provider_gap_exposed", "relay_gap_exposed", "relay_sequence_gap", "hash_mismatch_exposed", "receiver_backpressure_exposed", "terminal_inconclusive", "degraded_audit_only",
    "insufficient_observation_horizon", "no_survival_to_required_horizon", "early_rejection_reason_volume_evaporated", "early_rejection_reason_no_buy_followthrough",
    "early_rejection_reason_top_holder_or_dev_dumped", "early_rejection_reason_holder_collapse", "early_rejection_reason_rug_like_by_60s", "early_rejection_reason_rug_like_by_300s",
    "early_rejection_reason_liquidity_exit_proxy", "early_rejection_reason_unknown", "missing_trade_delta_features", "missing_holder_snapshot_features", "missing_vault_curve_features",
    "feature_unavailable_in_prior_slices:trade_delta", "feature_unavailable_in_prior_slices:holder_state", "feature_unavailable_in_prior_slices:vault_curve",
    "candidate_checkpoint_absent", "replay_not_countability_allowed", "gate_too_strict_review",
]


def flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def num(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def whole(name: str) -> Column:
    """Counts: cut to whole numbers, 0 where missing."""
    return num(name).cast("long")


def some(*names: str) -> Column:
    """Whether any of these flags is set."""
    out = flag(names[0])
    for n in names[1:]:
        out = out | flag(n)
    return out


def codes(table: dict[str, Column]) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in table.items()]))


def has(reasons: Column, *names: str) -> Column:
    return F.arrays_overlap(reasons, F.array(*[F.lit(n) for n in names]))


def begins(reasons: Column, *prefixes: str) -> Column:
    def one(x):
        out = x.startswith(prefixes[0])
        for p in prefixes[1:]:
            out = out | x.startswith(p)
        return out

    return F.exists(reasons, one)


def available(group: str) -> Column:
    """Whether the horizon's data are complete and the group has at least one value."""
    return flag("data_complete_for_horizon") & F.coalesce(*GROUPS[group]).isNotNull()


def alpha_bins() -> dict[str, Column]:
    """Seven bins of the as-of features; MISSING where the group isn't available."""
    trades, buys, sells, net = whole("trade_update_count_asof"), whole("buy_count_delta_asof"), whole("sell_count_delta_asof"), whole("net_buy_sell_delta_asof")
    holders, new, gone = whole("unique_holder_accounts_seen_asof"), whole("new_holder_count_delta_asof"), whole("exiting_holder_count_delta_asof")
    top, curve = num("top_holder_concentration_asof"), num("curve_progress_proxy_asof")
    updates = whole("vault_update_count_asof") + whole("bonding_curve_update_count_asof")

    def three(group: str, low: Column, high: Column, names=("LOW", "HIGH", "MEDIUM")) -> Column:
        return F.when(~available(group), "MISSING").when(low, names[0]).when(high, names[1]).otherwise(names[2])

    return {
        "trade_delta_bin": three("trade_delta", (trades <= 0) | (buys <= 0), (buys > sells) & (net > 0) & (trades >= 3)),
        "buy_followthrough_bin": three("trade_delta", buys <= 0, (net > 0) & (buys >= 2)),
        "sell_pressure_bin": three("trade_delta", (sells > buys) | (net < 0), sells == 0, ("HIGH", "LOW", "MEDIUM")),
        "holder_growth_bin": three("holder_state", (holders <= 1) | (new <= gone), holders >= 3),
        "holder_risk_bin": three("holder_state", (top >= 0.75) | (num("holder_collapse_proxy_asof") > 0) | (num("dev_or_creator_holding_proxy_asof") > 0) | (gone > new), top >= 0.5, ("HIGH", "MEDIUM", "LOW")),
        "vault_curve_progress_bin": three("vault_curve", (updates <= 0) | (curve <= 0), (curve >= 0.5) | (updates >= 3)),
        "liquidity_risk_bin": F.when(~available("vault_curve"), "MISSING").when((num("liquidity_exit_proxy_asof") > 0) | (num("liquidity_delta_asof") < 0), "HIGH").otherwise("LOW"),
    }


def _answer(df: DataFrame, reasons: Column, decision: Column, **more: Column) -> DataFrame:
    """df with reasons first, so that what follows reads them as a column."""
    return df.withColumn("reasons", reasons).withColumns({"decision": decision, **more})


def early_avoid_v0(df: DataFrame) -> DataFrame:
    """Adds reasons, decision, score."""
    tracked, dead = flag("tracked_at_least_horizon"), flag("label_clean_negative")
    table = {
        "provider_gap_censored": flag("data_quality_provider_gap_exposed"),
        "hash_mismatch_exclusion": flag("data_quality_hash_mismatch"),
        "receiver_backpressure_exclusion": flag("data_quality_receiver_backpressure"),
        "degraded_audit_only": flag("data_quality_degraded_active_mint"),
        "relay_sequence_gap": flag("data_quality_sequence_gap"),
        "insufficient_horizon_observation": ~tracked,
    }
    spoilt = table["provider_gap_censored"] | table["hash_mismatch_exclusion"] | table["receiver_backpressure_exclusion"] | table["relay_sequence_gap"]
    table["historical_clean_negative_pattern"] = ~spoilt & tracked & dead
    decision = first_match([("audit_only", spoilt), ("insufficient_data", ~tracked), ("avoid", dead)], "continue_tracking")
    return _answer(df, codes(table), decision).withColumn("score", F.when(F.col("decision") == "avoid", "HIGH").when(F.col("decision") == "audit_only", "MEDIUM").otherwise("LOW"))


def quality_codes() -> dict[str, Column]:
    """Reasons that the as-of gates v1 and v2 share."""
    degraded = flag("degraded_audit_only_before_horizon")
    return {
        "provider_gap_exposed": flag("provider_gap_exposed"),
        "relay_gap_exposed": flag("relay_gap_exposed"),
        "terminal_inconclusive": flag("terminal_inconclusive_before_horizon"),
        "rejected_before_horizon": flag("rejected_before_horizon"),
        "high_throughput_degraded_audit_only": degraded,
        "high_throughput_clean_observation": ~degraded & flag("high_throughput_before_horizon"),
        "missing_horizon": ~flag("horizon_reached"),
    }


def early_avoid_v1(df: DataFrame) -> DataFrame:
    """P1, as-of rows: adds reasons, decision."""
    table = quality_codes() | {"data_quality_exclusion": flag("data_quality_exclusion")}
    found = codes(table)
    found = F.when(F.size(found) == 0, F.array(F.lit("no_avoid_reason_seen"))).otherwise(found)
    r = F.col("reasons")
    return _answer(df, found, first_match([("censored", has(r, "terminal_inconclusive", "provider_gap_exposed", "relay_gap_exposed")), ("insufficient_data", has(r, "missing_horizon")), ("avoid", has(r, "rejected_before_horizon"))], "continue_tracking"))


def _spoilt_alpha() -> Column:
    return some("provider_gap_exposed", "relay_gap_exposed", "sequence_gap_exposed", "hash_mismatch_exposed", "receiver_backpressure_exposed")


# Fixed values in what follows: reason codes and the conditions they stand for.
def alpha_codes(forbidden: list[str] = []) -> dict[str, Column]:
    """Reasons of the gates that read bins (P3 v2): of quality, of each group's features, of the label; `forbidden` columns must be empty."""
    b = alpha_bins()
    degraded = flag("degraded_audit_only_before_horizon") | flag("label_degraded_active_mint")
    trade, holder, vault = available("trade_delta"), available("holder_state"), available("vault_curve")
    risky = b["holder_risk_bin"] == "HIGH"
    leaked = F.lit(False)
    for c in forbidden:
        leaked = leaked | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return {
        "forbidden_future_leakage_column": leaked,
        "provider_gap_exposed": some("provider_gap_exposed", "label_provider_gap_exposed"),
        "relay_gap_exposed": some("relay_gap_exposed", "label_relay_gap_exposed", "sequence_gap_exposed"),
        "hash_mismatch_exposed": flag("hash_mismatch_exposed"),
        "receiver_backpressure_exposed": flag("receiver_backpressure_exposed"),
        "missing_horizon": ~flag("horizon_reached"),
        "terminal_inconclusive": flag("terminal_inconclusive_before_horizon") | F.coalesce(F.col("final_outcome") == "terminal_inconclusive", F.lit(False)),
        "rejected_before_horizon": flag("rejected_before_horizon"),
        "high_throughput_degraded_audit_only": degraded,
        "high_throughput_clean_observation": ~degraded & flag("high_throughput_before_horizon"),
        "missing_asof_trade_delta": ~trade,
        "insufficient_trade_delta_strength": b["trade_delta_bin"] == "LOW",
        "insufficient_buy_followthrough": b["buy_followthrough_bin"] == "LOW",
        "adverse_sell_pressure": b["sell_pressure_bin"] == "HIGH",
        "missing_asof_holder_state": ~holder,
        "holder_concentration_risk": risky,
        "holder_collapse_risk": risky & (num("holder_collapse_proxy_asof") > 0),
        "dev_or_creator_holding_risk": risky & (num("dev_or_creator_holding_proxy_asof") > 0),
        "weak_holder_growth": b["holder_growth_bin"] == "LOW",
        "missing_asof_vault_curve": ~vault,
        "weak_vault_curve_progress": b["vault_curve_progress_bin"] == "LOW",
        "insufficient_curve_progress": b["vault_curve_progress_bin"] == "LOW",
        "liquidity_exit_risk": b["liquidity_risk_bin"] == "HIGH",
        "candidate_checkpoint_absent": ~flag("candidate_checkpoint_seen"),
        "replay_not_countability_allowed": ~flag("replay_eligible"),
    }


def early_avoid_bins(df: DataFrame) -> DataFrame:
    """P1, bins: adds reasons, decision."""
    b = alpha_bins()
    ended, rejected = flag("terminal_inconclusive_before_horizon"), flag("rejected_before_horizon")
    weak, sold = b["buy_followthrough_bin"] == "LOW", b["sell_pressure_bin"] == "HIGH"
    decision = first_match([("audit_only", _spoilt_alpha() | ended), ("insufficient_data", ~flag("horizon_reached")), ("avoid", rejected | weak | sold)], "continue_tracking")
    avoid = codes({"rejected_before_horizon": rejected, "insufficient_buy_followthrough": weak, "adverse_sell_pressure": sold})
    one = lambda s: F.array(F.lit(s))
    reasons = (
        F.when(_spoilt_alpha(), one("data_quality_exclusion"))
        .when(ended, one("terminal_inconclusive_censored"))
        .when(~flag("horizon_reached"), one("missing_horizon"))
        .when(rejected | weak | sold, avoid)
        .otherwise(one("asof_alpha_no_early_avoid_blocker"))
    )
    return _answer(df, reasons, decision)


def continue_v0(df: DataFrame) -> DataFrame:
    """Adds reasons, decision."""
    table = {
        "insufficient_observation_at_horizon": ~flag("tracked_at_least_horizon"),
        "provider_gap_censored": flag("data_quality_provider_gap_exposed"),
        "relay_gap_censored": flag("data_quality_sequence_gap"),
        "hash_mismatch_censored": flag("data_quality_hash_mismatch"),
        "receiver_backpressure_censored": flag("data_quality_receiver_backpressure"),
        "degraded_audit_only": flag("data_quality_degraded_active_mint"),
        "label_censored_not_dead": flag("label_censored"),
    }
    r = F.col("reasons")
    return _answer(df, codes(table), first_match([("censored", F.exists(r, lambda x: x.contains("censored"))), ("audit_only", has(r, "degraded_audit_only")), ("stop_tracking", has(r, "insufficient_observation_at_horizon"))], "continue_tracking"))


def continue_v1(df: DataFrame) -> DataFrame:
    """P2, as-of rows: adds reasons, decision."""
    table = quality_codes()
    ended, exposed = table["terminal_inconclusive"], some("provider_gap_exposed", "relay_gap_exposed")
    missing, rejected = table["missing_horizon"], table["rejected_before_horizon"]
    told = ~ended & ~exposed & ~missing
    table |= {"stop_tracking_after_rejection": told & rejected, "survived_current_horizon": told & ~rejected}
    return _answer(df, codes(table), first_match([("censored", ended), ("audit_only", exposed), ("insufficient_data", missing), ("avoid", rejected)], "continue_tracking"))


def continue_bins(df: DataFrame) -> DataFrame:
    """P2, bins: adds reasons, decision."""
    b, all_codes = alpha_bins(), alpha_codes()
    censored, degraded = _spoilt_alpha() | flag("terminal_inconclusive_before_horizon"), flag("degraded_audit_only_before_horizon")
    going = b["buy_followthrough_bin"].isin("MEDIUM", "HIGH") & (b["holder_risk_bin"] != "HIGH") & (b["liquidity_risk_bin"] != "HIGH")
    rest = codes({n: c for n, c in all_codes.items() if n not in ("candidate_checkpoint_absent", "replay_not_countability_allowed")})
    one = lambda s: F.array(F.lit(s))
    reasons = (
        F.when(censored, one("data_quality_or_terminal_censored"))
        .when(degraded, one("high_throughput_degraded_audit_only"))
        .when(~flag("horizon_reached"), one("missing_horizon"))
        .when(flag("rejected_before_horizon"), one("rejected_before_horizon"))
        .when(going, one("asof_alpha_continue_observation"))
        .otherwise(F.when(F.size(rest) == 0, one("weak_alpha_profile")).otherwise(rest))
    )
    decision = first_match([("censored", censored), ("audit_only", degraded), ("stop_tracking", ~flag("horizon_reached") | flag("rejected_before_horizon")), ("continue_tracking", going)], "stop_tracking")
    return _answer(df, reasons, decision)


def eligibility_v0(df: DataFrame) -> DataFrame:
    """P3 v0: adds reasons, decision."""
    quality = ["data_quality_sequence_gap", "data_quality_hash_mismatch", "data_quality_receiver_backpressure", "data_quality_provider_gap_exposed", "data_quality_degraded_active_mint"]
    table = {n: flag(n) for n in quality} | {"censored_label": flag("label_censored"), "insufficient_observation": ~flag("tracked_at_least_horizon"), "historical_clean_negative": flag("label_clean_negative")}
    censored = table["censored_label"] | table["data_quality_provider_gap_exposed"] | table["data_quality_sequence_gap"] | table["data_quality_hash_mismatch"]
    return _answer(df, codes(table), first_match([("candidate_eligible_research_only", flag("label_clean_positive")), ("censored", censored)], "not_eligible"))


# Fixed values in what follows: reason codes and the conditions they stand for.
def eligibility_v1(df: DataFrame) -> DataFrame:
    """P3 v1: adds reasons, decision, first_failed_gate. A rejection's reason becomes a code of its own."""
    dead, censored = flag("label_clean_negative"), flag("label_censored")
    tracked = flag("tracked_at_least_horizon")
    named = F.coalesce(F.when(F.col("rejection_reason") != "", F.col("rejection_reason")), F.when(F.col("final_outcome_reason") != "", F.col("final_outcome_reason")))
    first = {
        "provider_gap_exposed": some("data_quality_provider_gap_exposed", "label_provider_gap_exposed"),
        "relay_gap_exposed": some("data_quality_relay_gap_exposed", "label_relay_gap_exposed"),
        "relay_sequence_gap": flag("data_quality_sequence_gap"),
        "hash_mismatch_exposed": flag("data_quality_hash_mismatch"),
        "receiver_backpressure_exposed": flag("data_quality_receiver_backpressure"),
        "terminal_inconclusive": F.coalesce(F.col("final_outcome") == "terminal_inconclusive", F.lit(False)) | censored,
        "degraded_audit_only": some("data_quality_degraded_active_mint", "label_degraded_active_mint"),
        "insufficient_observation_horizon": ~tracked,
        "no_survival_to_required_horizon": ~tracked,
    }
    rejection = F.when(dead, F.array(F.concat(F.lit("early_rejection_reason_"), F.coalesce(slug(named), F.lit("unknown"))))).otherwise(F.array().cast("array<string>"))
    last = {"candidate_checkpoint_absent": ~flag("candidate_checkpoint_seen"), "replay_not_countability_allowed": ~flag("replay_eligible")}
    for group, missing in (("trade_delta", "missing_trade_delta_features"), ("holder_state", "missing_holder_snapshot_features"), ("vault_curve", "missing_vault_curve_features")):
        there = flag(f"asof_alpha_{group}_available")
        last |= {f"feature_available_in_new_asof_alpha_slices:{group}": there, f"feature_unavailable_in_prior_slices:{group}": ~there, missing: ~there}
    last["gate_too_strict_review"] = ~dead & ~censored
    r = F.col("reasons")
    hard = ["provider_gap_exposed", "relay_gap_exposed", "relay_sequence_gap", "hash_mismatch_exposed", "receiver_backpressure_exposed", "terminal_inconclusive", "degraded_audit_only"]
    decision = first_match([("candidate_eligible_research_only", flag("replay_eligible") & (F.size(r) == 0)), ("censored", censored | has(r, *hard))], "not_eligible")
    ordered = F.filter(F.array(*[F.lit(g) for g in GATE_ORDER]), lambda g: F.array_contains(r, g))
    failed = F.coalesce(F.get(ordered, 0), F.get(F.filter(r, lambda x: x.startswith("early_rejection_reason_")), 0), F.lit(""))
    return _answer(df, F.concat(codes(first), rejection, codes(last)), decision, first_failed_gate=failed)


def eligibility_v2_bins(df: DataFrame, forbidden: list[str] = []) -> DataFrame:
    """P3 v2, bins: adds reasons, decision, score."""
    r = F.col("reasons")
    blocking = ["rejected_before_horizon", "insufficient_trade_delta_strength", "insufficient_buy_followthrough", "adverse_sell_pressure", "holder_concentration_risk", "holder_collapse_risk", "dev_or_creator_holding_risk", "weak_holder_growth", "weak_vault_curve_progress", "liquidity_exit_risk", "insufficient_curve_progress"]
    decision = first_match(
        [
            ("audit_only", has(r, "forbidden_future_leakage_column")),
            ("censored", has(r, "provider_gap_exposed", "relay_gap_exposed", "hash_mismatch_exposed", "receiver_backpressure_exposed", "terminal_inconclusive")),
            ("audit_only", has(r, "high_throughput_degraded_audit_only")),
            ("insufficient_data", begins(r, "missing_asof_") | has(r, "missing_horizon")),
            ("eligible", flag("candidate_checkpoint_seen") & flag("replay_eligible") & ~has(r, *blocking)),
        ],
        "not_eligible",
    )
    d = F.col("decision")
    score = first_match(
        [("CENSORED", d == "censored"), ("UNSAFE", (d == "audit_only") | F.exists(r, lambda x: x.endswith("_risk"))), ("MISSING", d == "insufficient_data"), ("HIGH", d == "eligible"), ("LOW", has(r, "candidate_checkpoint_absent", "replay_not_countability_allowed"))],
        "MEDIUM",
    )
    return _answer(df, codes(alpha_codes(forbidden)), decision).withColumn("score", score)


def eligibility_v2_gates(df: DataFrame) -> DataFrame:
    """P3 v2, as-of rows: adds sorted reasons, decision, confidence."""
    trade, holder = _any_null("trade_update_count_asof", "buy_count_delta_asof", "sell_count_delta_asof"), _any_null("holder_update_count_asof", "unique_holder_accounts_seen_asof")
    vault = _any_null("vault_update_count_asof", "bonding_curve_update_count_asof", "curve_progress_proxy_asof")
    buys, sells = whole("buy_count_delta_asof"), whole("sell_count_delta_asof")
    q = quality_codes()
    table = q | {
        "terminal_inconclusive": q["terminal_inconclusive"] | flag("label_censored"),
        "missing_asof_trade_delta": trade,
        "insufficient_buy_followthrough": ~trade & (buys <= 0),
        "adverse_sell_pressure": ~trade & ((sells > buys) | (whole("net_buy_sell_delta_asof") < 0)),
        "insufficient_trade_delta_strength": ~trade & (whole("trade_update_count_asof") <= 0),
        "missing_asof_holder_state": holder,
        "weak_holder_growth": ~holder & (whole("unique_holder_accounts_seen_asof") <= 1),
        "holder_concentration_risk": ~holder & (num("top_holder_concentration_asof") >= 0.75),
        "dev_or_creator_holding_risk": ~holder & (num("dev_or_creator_holding_proxy_asof") != 0),
        "missing_asof_vault_curve": vault,
        "weak_vault_curve_progress": ~vault & (num("curve_progress_proxy_asof") <= 0),
        "insufficient_curve_progress": ~vault & (num("curve_progress_proxy_asof") <= 0),
        "liquidity_exit_risk": ~vault & (num("liquidity_exit_proxy_asof") != 0),
        "candidate_checkpoint_absent": ~flag("candidate_checkpoint_seen"),
        "replay_not_countability_allowed": ~flag("replay_eligible"),
    }
    r = F.col("reasons")
    # Names, order and conditions of the rules.
    rules = [("censored", has(r, "provider_gap_exposed", "relay_gap_exposed", "terminal_inconclusive", "high_throughput_degraded_audit_only")), ("insufficient_data", begins(r, "missing_")), ("candidate_watch", has(r, "candidate_checkpoint_absent", "replay_not_countability_allowed"))]
    confidence = F.create_map(*[F.lit(x) for x in ("censored", "CENSORED", "insufficient_data", "MISSING", "candidate_watch", "LOW", "candidate_review", "MEDIUM")])
    return _answer(df, F.array_sort(codes(table)), first_match(rules, "candidate_review")).withColumn("confidence", confidence[F.col("decision")])


def _any_null(*names: str) -> Column:
    out = F.col(names[0]).isNull()
    for n in names[1:]:
        out = out | F.col(n).isNull()
    return out


def early_burst_v0(df: DataFrame) -> DataFrame:
    """P5: adds sorted reasons, decision, confidence; rows of horizons 5, 10 and 30 are meant."""
    spoilt = some("provider_gap_exposed", "relay_gap_exposed", "data_quality_exclusion")
    ended, late = flag("terminal_inconclusive_before_horizon"), ~flag("horizon_reached")
    buys, sells, net = num("buy_count_delta_asof"), num("sell_count_delta_asof"), num("net_buy_sell_delta_asof")
    growth = F.when(num("new_holder_count_delta_asof") != 0, num("new_holder_count_delta_asof")).otherwise(num("unique_holder_accounts_seen_asof"))
    rejected = flag("rejected_before_horizon")
    early = {
        "early_curve_progress": num("curve_progress_proxy_asof") >= 35,
        "early_buy_sell_followthrough": (net >= 3) | (buys >= 3),
        "early_volume_followthrough": num("volume_delta_asof") > 0,
        "early_holder_growth": growth >= 3,
    }
    adverse, top = (sells > buys) | (net < 0), num("top_holder_concentration_asof") >= 0.85
    started = early["early_curve_progress"] | early["early_buy_sell_followthrough"] | early["early_volume_followthrough"] | early["early_holder_growth"]
    short = ~started & ~adverse & ~top
    table = early | {"adverse_sell_pressure": adverse, "holder_concentration_risk": top, "dev_or_creator_holding_risk": num("dev_or_creator_holding_proxy_asof") != 0, "death_after_burst": rejected, "weak_exit_window": rejected, "insufficient_horizon": short, "replay_not_allowed": F.lit(True)}
    one = lambda s: F.array(F.lit(s))
    reasons = F.when(spoilt, one("data_quality_excluded")).when(ended, one("terminal_inconclusive")).when(late, one("insufficient_horizon")).otherwise(F.array_sort(codes(table)))
    decision = first_match([("audit_only", spoilt), ("censored", ended), ("insufficient_data", late), ("early_burst_watch", started), ("reject", adverse | top)], "insufficient_data")
    confidence = F.create_map(*[F.lit(x) for x in ("audit_only", "UNSAFE", "censored", "CENSORED", "insufficient_data", "MISSING", "early_burst_watch", "LOW", "reject", "UNSAFE")])
    return _answer(df, reasons, decision).withColumn("confidence", confidence[F.col("decision")])


def promotion_bins() -> dict[str, Column]:
    d = lambda c, low, high: descriptive_bin(F.col(c).cast("double"), low, high)
    buys, sells, net = num("buy_count_delta_asof"), F.col("sell_count_delta_asof"), F.col("net_buy_sell_delta_asof")
    sell = F.when(sells.isNull() & net.isNull(), "MISSING").when((num("net_buy_sell_delta_asof") < 0) | F.coalesce(sells >= buys + 2, F.lit(False)), "HIGH").when(num("sell_count_delta_asof") > 0, "MEDIUM").otherwise("LOW")
    return {
        "trade_burst_bin": d("trade_burst_score_asof", 0.1, 0.5),
        "buy_followthrough_bin": d("buy_count_delta_asof", 1, 3),
        "sell_pressure_bin": sell,
        "volume_bin": d("volume_delta_asof", 500_000_000, 5_000_000_000),
        "holder_concentration_risk_bin": d("top_holder_concentration_asof", 0.5, 0.8),
        "dev_creator_holding_risk_bin": d("dev_or_creator_holding_proxy_asof", 0.02, 0.10),
        "curve_progress_bin": d("curve_progress_proxy_asof", 20, 50),
    }


def promotion_priority(df: DataFrame, avoider_decision: str = "avoider_decision", avoider_reasons: str = "avoider_reasons") -> DataFrame:
    """Adds reasons, decision, confidence."""
    x = df.withColumns(promotion_bins())
    avoid, why = F.coalesce(F.col(avoider_decision) == "avoid", F.lit(False)), F.coalesce(F.col(avoider_reasons), F.lit(""))
    spoilt = some("data_quality_exclusion", "provider_gap_exposed", "relay_gap_exposed", "sequence_gap_exposed", "hash_mismatch_exposed", "receiver_backpressure_exposed") | F.coalesce(F.col("positive_outcome_label") == "invalid_quality", F.lit(False))
    ended = flag("terminal_inconclusive_before_horizon") | F.coalesce(F.col("final_outcome") == "terminal_inconclusive", F.lit(False))
    exit_, collapse = (num("liquidity_exit_proxy_asof") != 0) | why.contains("liquidity_exit_proxy"), (num("holder_collapse_proxy_asof") != 0) | why.contains("holder_collapse_proxy")
    trade, buy, sell, volume = F.col("trade_burst_bin"), F.col("buy_followthrough_bin"), F.col("sell_pressure_bin"), F.col("volume_bin")
    holder, dev, curve = F.col("holder_concentration_risk_bin"), F.col("dev_creator_holding_risk_bin"), F.col("curve_progress_bin")
    up = lambda c: c.isin("HIGH", "MEDIUM")
    calm = up(buy) & sell.isin("LOW", "MEDIUM") & ~exit_ & ~collapse & (volume == "HIGH")
    strong, second = calm & (curve == "HIGH"), calm & up(curve) & up(trade)
    dead = exit_ | collapse | (sell == "HIGH") | (avoid & ((buy == "LOW") | (volume == "LOW") | curve.isin("LOW", "MISSING")))
    promoted = codes({
        "sufficient_horizon_coverage": F.lit(True), "early_curve_progress": F.lit(True), "early_volume_followthrough": F.lit(True), "early_buy_sell_followthrough": F.lit(True), "low_adverse_sell_pressure": F.lit(True), "vault_curve_progress": F.lit(True),
        "clean_high_throughput_watch": flag("high_throughput_before_horizon"), "absence_of_holder_dev_risk": ~holder.isin("HIGH", "MISSING") & ~dev.isin("HIGH", "MISSING"), "holder_concentration_risk": holder == "HIGH", "dev_or_creator_holding_risk": dev == "HIGH",
    })
    rejected = codes({"dead_launch_avoider_reject": F.lit(True), "liquidity_exit_proxy": exit_, "adverse_sell_pressure": sell == "HIGH", "holder_concentration_risk": holder == "HIGH", "dev_or_creator_holding_risk": dev == "HIGH", "insufficient_followup": ~up(buy) | ~up(volume)})
    kept = codes({"insufficient_followup": F.lit(True), "dead_launch_avoider_reject": avoid, "early_curve_progress": up(curve), "early_volume_followthrough": up(volume), "early_buy_sell_followthrough": up(buy)})
    one = lambda s: F.array(F.lit(s))
    late = ~flag("horizon_reached")
    reasons = F.when(ended, one("terminal_inconclusive_censored")).when(spoilt, one("data_quality_excluded")).when(late, one("insufficient_followup")).when(strong | second, promoted).when(dead, rejected).otherwise(kept)
    decision = first_match([("censored", ended), ("audit_only", spoilt), ("insufficient_data", late), ("promote_to_rich_tracking_research_only", strong | second), ("reject", dead)], "keep_cheap_followup")
    confidence = first_match([("CENSORED", ended), ("UNSAFE", spoilt), ("MISSING", late), ("HIGH", strong), ("MEDIUM", second), ("UNSAFE", dead)], "LOW")
    return _answer(x, reasons, decision, confidence=confidence).drop(*promotion_bins())


def prefilter() -> tuple[Column, Column]:
    """(decision, reasons) of the dead-launch prefilter, the first rule that holds."""
    # Names, order and conditions of the rules.
    rules = [
        ("audit_only", ["data_quality_excluded"], some("data_quality_exclusion", "provider_gap_exposed", "relay_gap_exposed", "sequence_gap_exposed", "hash_mismatch_exposed", "receiver_backpressure_exposed")),
        ("censored", ["terminal_inconclusive_censored"], flag("terminal_inconclusive_before_horizon")),
        ("audit_only", ["degraded_audit_only"], flag("degraded_audit_only_before_horizon")),
        ("reject", ["dead_launch_avoider_reject", "rejected_before_horizon"], flag("rejected_before_horizon")),
        ("reject", ["dead_launch_avoider_reject", "holder_collapse_risk"], num("holder_collapse_proxy_asof") != 0),
        ("reject", ["dead_launch_avoider_reject", "liquidity_exit_proxy"], num("liquidity_exit_proxy_asof") != 0),
    ]
    decision, reasons = F.when(F.lit(False), ""), F.when(F.lit(False), F.array(F.lit("")))
    for d, r, c in rules:
        decision, reasons = decision.when(c, d), reasons.when(c, F.array(*[F.lit(x) for x in r]))
    return decision.otherwise("continue_observation"), reasons.otherwise(F.array(F.lit("no_obvious_dead_launch_risk_by_fixed_bins")))


def _growth() -> Column:
    return F.when(num("new_holder_count_delta_asof") != 0, F.col("new_holder_count_delta_asof").cast("double")).otherwise(F.col("unique_holder_accounts_seen_asof").cast("double"))


def _owner_risk(medium: float, high: float, unsafe: float) -> Column:
    most = F.greatest(num("top_holder_concentration_asof"), num("dev_or_creator_holding_proxy_asof"))
    return risk_bin(F.when(most != 0, most), medium, high, unsafe)


def _liquidity(high: float) -> Column:
    drawdown = F.greatest(-num("liquidity_delta_asof"), F.lit(0.0))
    return F.when(num("liquidity_exit_proxy_asof") != 0, "UNSAFE").when(drawdown >= high, "HIGH").when(drawdown >= 1, "MEDIUM").otherwise("LOW")


def _reviewed(x: DataFrame, rules: list[tuple[str, Column, Column]], other: tuple[str, Column], review: str) -> DataFrame:
    """First match over (decision, condition, reasons to add), after the prefilter's own; what isn't for review says so."""
    decision, added = F.when(F.lit(False), ""), F.when(F.lit(False), F.array(F.lit("")))
    for d, c, r in rules:
        decision, added = decision.when(c, d), added.when(c, r)
    x = x.withColumn("decision", decision.otherwise(other[0])).withColumn("reasons", F.concat("reasons", added.otherwise(other[1])))
    return x.withColumn("reasons", F.when(F.col("decision") != review, F.array_append("reasons", F.lit("review_only_no_replay_eligibility_created"))).otherwise(F.col("reasons")))


def _top_blocker() -> Column:
    return F.coalesce(F.get(F.filter("reasons", lambda r: r != "no_obvious_dead_launch_risk_by_fixed_bins"), 0), F.lit(""))


def early_burst_in_out_v0(df: DataFrame) -> DataFrame:
    """Adds prefilter, seven bins, decision, reasons, top_blocker; promoted and exit_observed are flags of df."""
    positive = lambda c, medium, high: descriptive_bin(c, medium, high, "MISSING")
    decision, reasons = prefilter()
    x = df.withColumns({
        "prefilter": decision,
        "reasons": reasons,
        "curve_progress_bin": positive(F.col("curve_progress_proxy_asof").cast("double"), 20, 50),
        "buy_sell_followthrough_bin": positive(F.col("net_buy_sell_delta_asof").cast("double"), 2, 5),
        "volume_followthrough_bin": positive(F.col("volume_delta_asof").cast("double"), 1, 1_000_000_000),
        "holder_growth_bin": positive(_growth(), 2, 6),
        "sell_pressure_bin": risk_bin(F.col("sell_count_delta_asof").cast("double"), 2, 5, 8),
        "holder_dev_risk_bin": _owner_risk(0.55, 0.75, 0.9),
        "liquidity_risk_bin": _liquidity(10),
    })
    none = F.array().cast("array<string>")
    one = lambda *s: F.array(*[F.lit(v) for v in s])
    pre, bad = F.col("prefilter"), lambda c: F.col(c).isin("HIGH", "UNSAFE")
    # Names, order and conditions of the rules.
    rules = [
        ("censored", pre == "censored", none),
        ("audit_only", pre == "audit_only", none),
        ("reject", pre == "reject", none),
        ("insufficient_data", ~flag("horizon_reached") | (whole("horizon_seconds") < 5), one("insufficient_followup")),
        ("reject", ~flag("promoted"), one("v1_not_promoted_or_would_promote_absent")),
        ("reject", F.col("curve_progress_bin").isin("MISSING", "LOW"), one("early_curve_progress_weak_or_missing")),
        ("reject", F.col("buy_sell_followthrough_bin") == "MISSING", one("early_buy_sell_followthrough_weak_or_missing")),
        ("reject", F.col("volume_followthrough_bin") == "MISSING", one("early_volume_followthrough_missing")),
        ("reject", bad("sell_pressure_bin"), one("adverse_sell_pressure")),
        ("reject", bad("holder_dev_risk_bin"), one("holder_or_dev_concentration_risk")),
        ("reject", bad("liquidity_risk_bin"), one("liquidity_exit_proxy")),
        ("insufficient_data", ~flag("exit_observed"), one("exit_window_not_observed_or_measurable")),
    ]
    seen = one("v1_promoted_or_would_promote", "early_curve_progress", "early_buy_sell_followthrough", "early_volume_followthrough", "exit_window_observed")
    last = F.when(F.col("buy_sell_followthrough_bin") == "LOW", F.array_append(seen, F.lit("early_buy_sell_followthrough_low_but_present"))).otherwise(seen)
    return _reviewed(x, rules, ("early_burst_candidate_review", last), "early_burst_candidate_review").withColumn("top_blocker", _top_blocker())


def survivor_runner(df: DataFrame) -> DataFrame:
    """Adds prefilter, bins, decision, reasons, top_blocker."""
    positive = lambda c, medium, high: descriptive_bin(c, medium, high, "MISSING")
    decision, reasons = prefilter()
    horizon, top = whole("horizon_seconds"), F.col("top_holder_concentration_asof").cast("double")
    x = df.withColumns({
        "prefilter": decision,
        "reasons": reasons,
        "survival_horizon_bin": F.when(~flag("horizon_reached"), "MISSING").when(horizon >= 900, "HIGH").when(horizon >= 300, "MEDIUM").when(horizon >= 120, "LOW").otherwise("MISSING"),
        "holder_growth_bin": positive(_growth(), 3, 8),
        "holder_stability_bin": F.when(top.isNull(), "MISSING").when(top <= 0.45, "HIGH").when(top <= 0.65, "MEDIUM").when(top <= 0.8, "LOW").otherwise("UNSAFE"),
        "curve_progress_bin": positive(F.col("curve_progress_proxy_asof").cast("double"), 35, 70),
        "sell_pressure_bin": risk_bin(F.col("sell_count_delta_asof").cast("double"), 2, 4, 6),
        "liquidity_risk_bin": _liquidity(5),
        "holder_dev_risk_bin": _owner_risk(0.45, 0.65, 0.85),
    })
    none = F.array().cast("array<string>")
    one = lambda *s: F.array(*[F.lit(v) for v in s])
    pre, bad = F.col("prefilter"), lambda c: F.col(c).isin("HIGH", "UNSAFE")
    # Names, order and conditions of the rules.
    rules = [
        ("censored", pre == "censored", none),
        ("audit_only", pre == "audit_only", none),
        ("reject", pre == "reject", none),
        ("insufficient_data", F.col("survival_horizon_bin") == "MISSING", one("missing_long_horizon")),
        ("continue_observation", F.col("survival_horizon_bin") == "LOW", one("survival_horizon_not_long_enough")),
        ("continue_observation", F.col("holder_growth_bin").isin("MISSING", "LOW"), one("weak_holder_growth")),
        ("reject", F.col("holder_stability_bin").isin("LOW", "UNSAFE") | bad("holder_dev_risk_bin"), one("holder_or_dev_concentration_risk")),
        ("continue_observation", F.col("curve_progress_bin").isin("MISSING", "LOW"), one("weak_vault_curve_progress")),
        ("reject", bad("sell_pressure_bin"), one("adverse_sell_pressure")),
        ("reject", bad("liquidity_risk_bin"), one("liquidity_exit_proxy")),
    ]
    seen = one("long_horizon_survival", "holder_growth_or_stability", "vault_curve_progress", "low_adverse_sell_pressure")
    last = F.when(flag("promoted"), F.array_append(seen, F.lit("v1_promoted_or_would_promote"))).otherwise(seen)
    return _reviewed(x, rules, ("survivor_candidate_review", last), "survivor_candidate_review").withColumn("top_blocker", _top_blocker())


def early_burst_in_out_v1(df: DataFrame) -> DataFrame:
    """P9, on the rows of `early_burst_in_out_v0`: adds v1_decision, v1_reasons, v1_top_blocker, guard_decision, guard_reasons and, for rows under review, replay_blocker."""
    v0 = F.col("decision")
    gone = F.col("reasons")
    censored = flag("censored_label") | F.coalesce(F.col("final_outcome") == "terminal_inconclusive", F.lit(False))
    audit = (v0 == "audit_only") | F.col("top_blocker").isin("data_quality_excluded", "degraded_audit_only")
    checkpoint, observed = flag("candidate_checkpoint_seen"), some("exit_observed", "forward_window_observed")
    present = lambda c: F.col(c).isin("LOW", "MEDIUM", "HIGH")
    evidence = codes({"early_curve_progress": present("curve_progress_bin"), "early_buy_sell_followthrough": present("buy_sell_followthrough_bin"), "early_volume_followthrough": present("volume_followthrough_bin")})
    one = lambda *s: F.array(*[F.lit(v) for v in s])
    gap = F.exists(gone, lambda r: r.contains("gap"))
    decision = first_match([("censored", censored), ("audit_only", audit | checkpoint), ("reject", (F.col("prefilter") == "reject") | ~flag("promoted")), ("insufficient_data", ~observed), ("reject", F.size(evidence) == 0)], "early_burst_candidate_review")
    first = (
        F.when(censored, one("terminal_inconclusive_censored"))
        .when(audit, F.when(gap, one("provider_or_relay_gap_exposed")).otherwise(one("missing_asof_features")))
        .when(checkpoint, one("candidate_checkpoint_audit_only", "replay_not_allowed"))
        .when(F.col("prefilter") == "reject", one("dead_launch_avoider_reject"))
        .when(~flag("promoted"), one("v1_not_promoted_or_would_promote_absent"))
        .when(~observed, one("missing_horizon"))
        .when(F.size(evidence) == 0, one("missing_asof_features"))
        .otherwise(F.concat(one("v1_promoted_or_would_promote"), evidence, one("research_only_not_signal", "replay_not_allowed")))
    )
    x = df.withColumn("v1_decision", decision)
    bad = lambda c: F.col(c).isin("HIGH", "UNSAFE")
    review = F.col("v1_decision") == "early_burst_candidate_review"
    more = codes({
        "adverse_sell_pressure_before_exit": bad("sell_pressure_bin"), "holder_concentration_risk": bad("holder_dev_risk_bin"), "dev_or_creator_holding_risk": bad("holder_dev_risk_bin"), "liquidity_exit_proxy": bad("liquidity_risk_bin"),
        "curve_progress_stall": F.col("curve_progress_bin").isin("MISSING", "LOW") & ~review, "replay_not_allowed": ~review,
    })
    guard = codes({"missing_horizon": ~observed, "adverse_sell_pressure_before_exit": bad("sell_pressure_bin"), "liquidity_exit_proxy": bad("liquidity_risk_bin")})
    x = x.withColumn("v1_reasons", F.array_distinct(F.concat(first, more)))
    return x.withColumns({
        "v1_top_blocker": F.coalesce(F.get(F.filter("v1_reasons", lambda r: r != "research_only_not_signal"), 0), F.lit("")),
        "guard_decision": F.when(observed, "observable_for_review").otherwise("insufficient_data"),
        "guard_reasons": F.when(F.size(guard) == 0, one("exit_window_observable_for_review")).otherwise(guard),
        "replay_blocker": F.when(review, F.when(checkpoint, "candidate_checkpoint_audit_only").otherwise("replay_not_allowed")),
    })


def selected_for_audit() -> Column:
    """P10: which rows are audited at all."""
    label = F.coalesce(F.lower("positive_outcome_label"), F.lit(""))
    return label.isin("positive", "high_positive") | some("high_positive", "early_burst_watch", "candidate_watch", "near_miss", "promoted", "rich_tracked", "all_launch_indexed")


def replay_blocker() -> Column:
    """P10: struct of blocker, root_cause, action by the first rule that holds."""
    why, label = F.coalesce(F.lower("candidate_gate_reason_codes"), F.lit("")), F.coalesce(F.lower("positive_outcome_label"), F.lit(""))
    high = label.isin("positive", "high_positive") | flag("high_positive")
    promoted, rich, checkpoint = flag("promoted"), flag("rich_tracked"), flag("candidate_checkpoint_seen")
    rejected = F.coalesce(F.col("final_outcome") == "early_rejected_dead", F.lit(False)) | (F.coalesce("rejected_reason", F.lit("")) != "") | why.contains("rejected_before_horizon")
    # Names, order and conditions of the rules.
    rules = [
        (flag("replay_eligible"), "none", "REPLAY_POLICY_BLOCK_ONLY", "stop_for_operator_candidate_review_no_replay"),
        (~flag("r2_verified") | ~flag("artifact_consistency_ok"), "r2_or_artifact_blocker", "R2_OR_ARTIFACT_BLOCKED", "fix_artifact_or_r2_before_replay_research"),
        (some("provider_gap_exposed", "relay_gap_exposed"), "provider_or_relay_gap_exposed", "PROVIDER_OR_RELAY_GAP_EXPOSED", "keep_censored_do_not_replay"),
        (some("terminal_inconclusive", "censored"), "terminal_inconclusive_or_censored", "TERMINAL_INCONCLUSIVE_CENSORED", "keep_censored_do_not_replay"),
        (~flag("counted_run") | ~flag("counted_segment"), "countability_false", "COUNTABILITY_POLICY_BLOCK", "inspect_countability_policy_no_replay"),
        (why.contains("missing_asof"), "missing_asof_features", "MISSING_ASOF_FEATURES", "retain_required_asof_features_before_replay_research"),
        (why.contains("missing_horizon") | F.coalesce("cheap_followup_horizons_reached", F.lit("")).isin("", "5", "10"), "missing_required_horizon", "MISSING_HORIZON", "collect_uniform_horizons_only_if_approved"),
        (rejected & high, "positive_outcome_rejected_before_material_candidate_horizon", "SURVIVOR_GATE_MISMATCH_FOR_EARLY_BURST", "review_early_burst_replay_candidate_type"),
        (rejected, "rejected_before_horizon", "REJECTED_BEFORE_HORIZON", "research_only_no_replay"),
        (high & ~checkpoint, "positive_high_without_candidate_checkpoint", "POSITIVE_OUTCOME_NOT_MATERIAL_CANDIDATE", "design_early_burst_replay_candidate_type_proposal"),
        (promoted & ~checkpoint, "v1_promoted_without_candidate_artifact", "V1_PROMOTED_BUT_NO_CANDIDATE_ARTIFACT", "audit_shadow_to_candidate_artifact_mapping"),
        (~rich & promoted, "promotion_budget_or_policy_miss", "PROMOTION_BUDGET_OR_POLICY_MISS", "review_shadow_control_proof_before_collection"),
        (~rich, "rich_tracking_not_reached", "RICH_TRACKING_NOT_REACHED", "no_replay_candidate_without_rich_tracking_or_new_artifact_type"),
        (~checkpoint, "candidate_checkpoint_absent", "CANDIDATE_CHECKPOINT_ABSENT", "diagnose_candidate_gate_mapping"),
        (why.contains("replay_not_countability_allowed"), "replay_not_countability_allowed", "COUNTABILITY_POLICY_BLOCK", "keep_replay_blocked"),
    ]
    named = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("blocker", "root_cause", "action"), strict=True)])
    out = F.when(rules[0][0], named(*rules[0][1:]))
    for c, *v in rules[1:]:
        out = out.when(c, named(*v))
    return out.otherwise(named("no_candidate_like_behavior_seen", "NO_CANDIDATE_BEHAVIOR_SEEN", "continue_research_without_replay"))


def continue_gap(reasons: str = "reasons") -> Column:
    """Why a mint that is still tracked is no candidate, by the reasons of `eligibility_v1`."""
    r = F.col(reasons)
    return first_match(
        [
            ("DATA_QUALITY_EXCLUDED", has(r, "provider_gap_exposed", "relay_gap_exposed", "relay_sequence_gap", "hash_mismatch_exposed", "receiver_backpressure_exposed")),
            ("CENSORED_OR_INCOMPLETE", flag("label_censored") | has(r, "terminal_inconclusive")),
            ("FAILED_BEHAVIOR", begins(r, "early_rejection_reason_")),
            ("MISSING_ASOF_FEATURES", begins(r, "missing_", "feature_unavailable_in_prior_slices")),
            ("GATE_TOO_STRICT_REVIEW", has(r, "gate_too_strict_review")),
        ],
        "UNKNOWN_NEEDS_TELEMETRY",
    )


def discovery(rows: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, horizons_reached, decision, top_reasons, why, next_data) for every key of rows (keys, horizon_seconds, horizon_reached).

    scored has (keys, decision, reasons, label_censored), one row a key at most; a key without one has insufficient data.
    """
    reached = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(flag("horizon_reached"), F.col("horizon_seconds").cast("long")))).alias("reached"))  # as many as there are horizons
    x = reached.join(scored.select(*keys, "decision", "reasons", "label_censored"), keys, "left")
    r, d = F.coalesce("reasons", F.array().cast("array<string>")), F.coalesce("decision", F.lit("insufficient_data"))
    # Names, order and conditions of the rules.
    rules = [
        (d == "eligible", "candidate_discovery_passed_research_only", "operator_review_before_replay_or_backtesting"),
        (flag("label_censored"), "censored_or_incomplete_observation", "clean_uninterrupted_survivor_observation"),
        (begins(r, "missing_asof") | has(r, "missing_horizon"), "insufficient_horizon_or_missing_alpha_features", "more as-of-alpha-complete slices at required horizons"),
        (has(r, "candidate_checkpoint_absent"), "no_candidate_checkpoint_observed", "fresh survivor-extension collection under same caps"),
    ]
    why, need = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for c, a, b in rules:
        why, need = why.when(c, a), need.when(c, b)
    return x.select(*keys, F.array_join("reached", "|").alias("horizons_reached"), d.alias("decision"), F.array_join(F.slice(r, 1, 5), "|").alias("top_reasons"), why.otherwise("failed_behavior_or_conservative_gate").alias("why"), need.otherwise("more clean survivor examples; do not loosen gates without evidence").alias("next_data"))


# The blockers of the decision funnel, in the order that breaks ties.
BLOCKERS = ["LiveDisabled", "TopHolderDump", "NoBuyGap", "HighFakeMomentumRisk", "DataGapActive", "DevSoldEarly"]


def token_funnel(decisions: DataFrame, labels: DataFrame, key: str = "mint") -> DataFrame:
    """Per token how far it came, what blocked it most, and whether it was a missed winner.

    decisions: (key, at, decision_type, strategy, reasons, edge); labels: (key, mfe, mae, confidence, has_price).
    """
    named = lambda b: F.size(F.filter("reasons", lambda r: r == b))
    counts = [F.sum(named(b)).alias(b) for b in BLOCKERS]
    seen = [F.max(F.col("decision_type") == t).alias(f"saw_{t}") for t in ("EnterPaper", "WatchDeep", "WatchLight", "StopTracking")]
    x = decisions.groupBy(key).agg(*counts, *seen, F.max_by("decision_type", "at").alias("final_decision"), F.array_sort(F.collect_set("strategy")).alias("strategies"), F.max("edge").alias("edge"))
    x = x.join(labels, key, "left")
    highest = first_match([(t, F.col(f"saw_{t}")) for t in ("EnterPaper", "WatchDeep", "WatchLight", "StopTracking")], "Observed")
    most = F.greatest(*BLOCKERS)
    top = first_match([(b, F.col(b) == most) for b in BLOCKERS], "")
    x = x.withColumns({"highest": highest, "top_blocker": top, "missing_label": ~F.coalesce(F.col("confidence") > 0, F.lit(False)), "missing_price": ~flag("has_price")})
    won = num("mfe") > 25
    missed = first_match(
        [
            ("uncertain_due_to_missing_labels", F.col("missing_label")),
            ("missed_winner_due_to_top_holder_filter", won & (F.col("TopHolderDump") > 0)),
            ("missed_winner_due_to_no_buy_gap", won & (F.col("NoBuyGap") > 0)),
            ("missed_winner_due_to_fake_momentum_filter", won & (F.col("HighFakeMomentumRisk") > 0)),
            ("missed_winner_due_to_data_gap", won & (F.col("DataGapActive") > 0)),
            ("missed_winner_due_to_missing_label", won),
            ("not_executable_after_fees", num("mfe") < 2),
        ],
        "correctly_rejected_loser",
    )
    justified = ~F.col("missing_label") & ((num("mfe") < 2) | (num("mae") <= -50) | (F.col("top_blocker") == "DataGapActive"))
    return x.select(key, "highest", F.array_join("strategies", "|").alias("strategies"), "final_decision", "top_blocker", *BLOCKERS, "edge", "mfe", "mae", "missing_label", "missing_price", missed.alias("missed"), justified.alias("justified"), F.when(F.col("missing_label"), 0.35).otherwise(0.75).alias("confidence"))


def enrich_missed(candidates: DataFrame, funnel: DataFrame, kind: str, key: str = "mint") -> DataFrame:
    """Candidates (key, later_mfe) with what the funnel knows of them; kind is missed or false."""
    x = candidates.join(funnel.select(key, F.col("mfe").alias("f_mfe"), F.col("mae").alias("later_mae"), "missing_label", "missing_price", "justified", "top_blocker"), key, "left")
    x = x.withColumn("later_mfe", F.coalesce("later_mfe", "f_mfe"))
    best = num("later_mfe")
    cls = first_match(
        [("label_insufficient", flag("missing_label")), ("price_coverage_insufficient", flag("missing_price")), ("not_executable_after_fees", best < 2), ("risk_justified_miss", flag("justified")), ("actionable_missed_winner" if kind == "missed" else "false_positive_missed_winner", best > 25)],
        "uncertain",
    )
    executable = F.coalesce(F.col("later_mfe") > 2.5, F.lit(False)) & ~flag("missing_label")
    losers = F.coalesce(F.col("top_blocker").isin("TopHolderDump", "HighFakeMomentumRisk", "DataGapActive"), F.lit(False))
    return x.select(key, "later_mfe", "later_mae", F.greatest(F.col("later_mfe") - 2.5, F.lit(0.0)).alias("opportunity"), executable.alias("executable"), F.coalesce("top_blocker", F.lit("unknown")).alias("gate_blocked"), losers.alias("admits_losers"), cls.alias("classification"))


def inactive_strategies(decisions: DataFrame, active: str) -> DataFrame:
    """Per strategy but the active one: how many were evaluated, candidates, near entry, and its six most frequent blockers."""
    x = decisions.where((F.col("strategy") != active) & (F.col("strategy") != ""))
    t = F.col("decision_type")
    counts = x.groupBy("strategy").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(t.isin("WatchLight", "WatchDeep", "EnterPaper")).alias("candidates"), F.count_if(t.isin("WatchDeep", "EnterPaper")).alias("near"))
    blocked = x.select("strategy", F.explode("reasons").alias("b")).groupBy("strategy", "b").agg(F.count(F.lit(1)).alias("n"))
    top = blocked.withColumn("place", F.expr("row_number() over (partition by strategy order by n desc, b)")).where("place <= 6")
    joined = top.groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "b", "n").alias("s")))).alias("t"))
    out = counts.join(joined, "strategy", "left")
    bounce = (F.col("strategy") == "SellAbsorptionBounce") & (F.col("near") > 0)
    return out.select("strategy", "evaluated", "candidates", "near", F.coalesce(F.array_join("t.s", "|"), F.lit("")).alias("top_blockers"), F.when(F.col("near") > 0, "likely").otherwise("possible").alias("threshold_blockers"), F.when(bounce, "worth_offline_review").otherwise("insufficient_evidence").alias("signal"))


def label_audit(labels: DataFrame) -> DataFrame:
    """Q2: (check, mint) of the labels that contradict themselves; none if clean."""
    ended = F.coalesce(F.col("final_outcome") == "terminal_inconclusive", F.lit(False))
    rules = {
        "terminal_inconclusive_labeled_dead": ended & flag("clean_negative_label"),
        "candidate_checkpoint_positive_without_replay": flag("candidate_checkpoint_seen") & flag("clean_positive_label") & ~flag("replay_eligible"),
        "provider_gap_clean_label": flag("provider_gap_exposed") & flag("clean_negative_label"),
    }
    return labels.select(F.explode(codes(rules)).alias("check"), "mint")
