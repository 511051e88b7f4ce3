"""The research gates, one query a line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import table
from ..plans import gates as G
from ..plans import labels as L
from . import query

#: As-of rows made from orders by arithmetic that both engines read: name, SQL. Flags are rare, numbers may be missing.
_RARE = ["provider_gap_exposed", "relay_gap_exposed", "sequence_gap_exposed", "hash_mismatch_exposed", "receiver_backpressure_exposed", "data_quality_exclusion", "terminal_inconclusive_before_horizon", "degraded_audit_only_before_horizon", "label_provider_gap_exposed", "label_relay_gap_exposed", "label_degraded_active_mint", "label_censored", "data_quality_relay_gap_exposed"]
_SOME = ["high_throughput_before_horizon", "rejected_before_horizon", "label_clean_negative", "label_clean_positive", "high_positive", "clean_negative_label", "clean_positive_label", "exit_observed", "early_burst_watch", "candidate_watch", "near_miss"]
_MOST = ["horizon_reached", "data_complete_for_horizon", "candidate_checkpoint_seen", "replay_eligible", "promoted", "forward_window_observed", "r2_verified", "artifact_consistency_ok", "counted_run", "counted_segment", "rich_tracked", "asof_alpha_trade_delta_available", "asof_alpha_holder_state_available", "asof_alpha_vault_curve_available", "all_launch_indexed"]
_COUNTS = {"trade_update_count_asof": 8, "buy_count_delta_asof": 7, "sell_count_delta_asof": 9, "net_buy_sell_delta_asof": 9, "unique_holder_accounts_seen_asof": 10, "new_holder_count_delta_asof": 9, "exiting_holder_count_delta_asof": 5, "holder_update_count_asof": 6, "vault_update_count_asof": 4, "bonding_curve_update_count_asof": 4}
_SHARES = {"top_holder_concentration_asof": 100, "dev_or_creator_holding_proxy_asof": 700, "curve_progress_proxy_asof": 1, "trade_burst_score_asof": 100}


def _x(i: int) -> str:
    return f"((o_orderkey * {2 * i + 5} + o_custkey * {3 * i + 7}) % 997)"


def _cells() -> list[str]:
    out, i = [], 0
    for names, test in ((_RARE, "{x} % 31 = 3"), (_SOME, "{x} % 4 = 1"), (_MOST, "{x} % 9 <> 2")):
        for n in names:
            i += 1
            out.append(f"{test.format(x=_x(i))} AS {n}")
    for n, m in _COUNTS.items():
        i += 1
        less = 3 if n == "net_buy_sell_delta_asof" else 0
        out.append(f"CASE WHEN {_x(i)} % 13 = 5 THEN NULL ELSE {_x(i)} % {m} - {less} END AS {n}")
    for n, m in _SHARES.items():
        i += 1
        out.append(f"CASE WHEN {_x(i)} % 13 = 5 THEN NULL WHEN {_x(i)} % 5 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST({_x(i)} % 97 AS DOUBLE) / {m} END AS {n}")
    a, b, c, d, e, f, g, h, k = (_x(i + j) for j in range(1, 10))
    out += [
        f"CASE WHEN {a} % 11 = 1 THEN NULL ELSE CAST({a} % 7 AS DOUBLE) * 1500000000 - 1500000000 END AS volume_delta_asof",
        f"CASE WHEN {b} % 29 = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS holder_collapse_proxy_asof",
        f"CASE WHEN {c} % 29 = 1 THEN CAST(0.5 AS DOUBLE) WHEN {c} % 29 = 2 THEN NULL ELSE CAST(0 AS DOUBLE) END AS liquidity_exit_proxy_asof",
        f"CASE WHEN {d} % 7 = 1 THEN NULL ELSE CAST({d} % 16 AS DOUBLE) - 9 END AS liquidity_delta_asof",
        f"CASE {e} % 6 WHEN 0 THEN 'terminal_inconclusive' WHEN 1 THEN 'early_rejected_dead' WHEN 2 THEN 'survived' WHEN 3 THEN NULL ELSE 'tracked' END AS final_outcome",
        f"CASE {f} % 7 WHEN 0 THEN 'Volume Evaporated!' WHEN 1 THEN 'holder-collapse' WHEN 2 THEN '' WHEN 3 THEN 'odd reason' ELSE NULL END AS rejection_reason",
        f"CASE {f} % 5 WHEN 0 THEN 'no buy followthrough' WHEN 1 THEN '' ELSE NULL END AS final_outcome_reason",
        f"CASE {g} % 6 WHEN 0 THEN 'positive' WHEN 1 THEN 'HIGH_positive' WHEN 2 THEN 'invalid_quality' WHEN 3 THEN NULL ELSE 'low' END AS positive_outcome_label",
        f"CASE {h} % 3 WHEN 0 THEN 'avoid' WHEN 1 THEN 'continue' ELSE NULL END AS avoider_decision",
        f"CASE {h} % 19 WHEN 0 THEN 'liquidity_exit_proxy' WHEN 1 THEN 'holder_collapse_proxy' ELSE NULL END AS avoider_reasons",
        f"CASE {k} % 41 WHEN 0 THEN 'x' ELSE ' ' END AS leaked_outcome",
        f"CASE {k} % 8 WHEN 0 THEN 'missing_asof_trade_delta' WHEN 1 THEN 'Missing_Horizon' WHEN 2 THEN 'rejected_before_horizon' WHEN 3 THEN 'replay_not_countability_allowed' ELSE NULL END AS candidate_gate_reason_codes",
        f"CASE {k} % 5 WHEN 0 THEN '5' WHEN 1 THEN '' ELSE '5|10|30' END AS cheap_followup_horizons_reached",
        f"CASE {a} % 9 WHEN 0 THEN 'dumped' ELSE NULL END AS rejected_reason",
        f"CASE o_orderkey % 7 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 30 WHEN 3 THEN 60 WHEN 4 THEN 120 WHEN 5 THEN 300 ELSE 900 END AS horizon_seconds",
    ]
    return out


_SAME = {
    "tracked_at_least_horizon": "horizon_reached", "data_quality_provider_gap_exposed": "provider_gap_exposed", "data_quality_sequence_gap": "sequence_gap_exposed", "data_quality_hash_mismatch": "hash_mismatch_exposed",
    "data_quality_receiver_backpressure": "receiver_backpressure_exposed", "data_quality_degraded_active_mint": "degraded_audit_only_before_horizon", "censored_label": "label_censored", "censored": "label_censored", "terminal_inconclusive": "terminal_inconclusive_before_horizon",
}
_CELLS = _cells()
_ROWS = f"a0 AS (SELECT o_orderkey AS k, o_custkey AS mint, {', '.join(_CELLS)} FROM orders), a AS (SELECT *, {', '.join(f'{v} AS {n}' for n, v in _SAME.items())} FROM a0)"


def asof_rows(spark, sf_dir):
    # the table is one small file, and its two columns become eighty: spread over all cores first
    narrow = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(spark.sparkContext.defaultParallelism)
    return narrow.selectExpr("o_orderkey as k", "o_custkey as mint", *_CELLS).selectExpr("*", *[f"{v} as {n}" for n, v in _SAME.items()])


def _out(x, *more):
    return x.select("k", "decision", F.array_join("reasons", "|").alias("reasons"), *more)


def _join(*pairs: tuple[str, str]) -> str:
    """SQL: the names whose conditions hold, joined in order."""
    return f"concat_ws('|', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for c, n in pairs)})"


_V0 = _join(
    ("data_quality_provider_gap_exposed", "provider_gap_censored"), ("data_quality_hash_mismatch", "hash_mismatch_exclusion"), ("data_quality_receiver_backpressure", "receiver_backpressure_exclusion"), ("data_quality_degraded_active_mint", "degraded_audit_only"),
    ("data_quality_sequence_gap", "relay_sequence_gap"), ("NOT tracked_at_least_horizon", "insufficient_horizon_observation"), ("decision = 'avoid'", "historical_clean_negative_pattern"),
)


@query(f"""WITH {_ROWS}, d AS (SELECT *, CASE WHEN data_quality_provider_gap_exposed OR data_quality_hash_mismatch OR data_quality_receiver_backpressure OR data_quality_sequence_gap THEN 'audit_only'
        WHEN NOT tracked_at_least_horizon THEN 'insufficient_data' WHEN label_clean_negative THEN 'avoid' ELSE 'continue_tracking' END AS decision FROM a)
    SELECT k, decision, {_V0} AS reasons, CASE decision WHEN 'avoid' THEN 'HIGH' WHEN 'audit_only' THEN 'MEDIUM' ELSE 'LOW' END AS score FROM d""")
def p1_early_avoid_v0(spark, sf_dir):
    return _out(G.early_avoid_v0(asof_rows(spark, sf_dir)), "score")


_QUALITY = [
    ("provider_gap_exposed", "provider_gap_exposed"), ("relay_gap_exposed", "relay_gap_exposed"), ("terminal_inconclusive_before_horizon", "terminal_inconclusive"), ("rejected_before_horizon", "rejected_before_horizon"), ("degraded_audit_only_before_horizon", "high_throughput_degraded_audit_only"),
    ("high_throughput_before_horizon AND NOT degraded_audit_only_before_horizon", "high_throughput_clean_observation"), ("NOT horizon_reached", "missing_horizon"),
]


@query(f"""WITH {_ROWS}, r AS (SELECT *, {_join(*_QUALITY, ('data_quality_exclusion', 'data_quality_exclusion'))} AS reasons FROM a)
    SELECT k, CASE WHEN terminal_inconclusive_before_horizon OR provider_gap_exposed OR relay_gap_exposed THEN 'censored' WHEN NOT horizon_reached THEN 'insufficient_data' WHEN rejected_before_horizon THEN 'avoid' ELSE 'continue_tracking' END AS decision,
        CASE WHEN reasons = '' THEN 'no_avoid_reason_seen' ELSE reasons END AS reasons FROM r""")
def p1_early_avoid_v1(spark, sf_dir):
    return _out(G.early_avoid_v1(asof_rows(spark, sf_dir)))


_n = lambda c: f"coalesce({c}, 0)"
_TRADES = "data_complete_for_horizon AND (trade_update_count_asof IS NOT NULL OR buy_count_delta_asof IS NOT NULL OR sell_count_delta_asof IS NOT NULL)"
_HOLDERS = "data_complete_for_horizon AND (holder_update_count_asof IS NOT NULL OR unique_holder_accounts_seen_asof IS NOT NULL OR top_holder_concentration_asof IS NOT NULL)"
_VAULTS = "data_complete_for_horizon AND (vault_update_count_asof IS NOT NULL OR bonding_curve_update_count_asof IS NOT NULL OR curve_progress_proxy_asof IS NOT NULL)"
_BINS = f"""{_ROWS}, z AS (SELECT *, {_n('trade_update_count_asof')} AS tr, {_n('buy_count_delta_asof')} AS bu, {_n('sell_count_delta_asof')} AS se, {_n('net_buy_sell_delta_asof')} AS ne, {_n('unique_holder_accounts_seen_asof')} AS ho, {_n('new_holder_count_delta_asof')} AS nh,
        {_n('exiting_holder_count_delta_asof')} AS gh, {_n('top_holder_concentration_asof')} AS tc, {_n('curve_progress_proxy_asof')} AS cu, {_n('vault_update_count_asof')} + {_n('bonding_curve_update_count_asof')} AS up, ({_TRADES}) AS t_ok, ({_HOLDERS}) AS h_ok, ({_VAULTS}) AS v_ok FROM a),
    b AS (SELECT *, CASE WHEN NOT t_ok THEN 'MISSING' WHEN tr <= 0 OR bu <= 0 THEN 'LOW' WHEN bu > se AND ne > 0 AND tr >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS trade_delta_bin,
        CASE WHEN NOT t_ok THEN 'MISSING' WHEN bu <= 0 THEN 'LOW' WHEN ne > 0 AND bu >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS buy_followthrough_bin,
        CASE WHEN NOT t_ok THEN 'MISSING' WHEN se > bu OR ne < 0 THEN 'HIGH' WHEN se = 0 THEN 'LOW' ELSE 'MEDIUM' END AS sell_pressure_bin,
        CASE WHEN NOT h_ok THEN 'MISSING' WHEN ho <= 1 OR nh <= gh THEN 'LOW' WHEN ho >= 3 AND nh > gh THEN 'HIGH' ELSE 'MEDIUM' END AS holder_growth_bin,
        CASE WHEN NOT h_ok THEN 'MISSING' WHEN tc >= 0.75 OR holder_collapse_proxy_asof > 0 OR {_n('dev_or_creator_holding_proxy_asof')} > 0 OR gh > nh THEN 'HIGH' WHEN tc >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS holder_risk_bin,
        CASE WHEN NOT v_ok THEN 'MISSING' WHEN up <= 0 OR cu <= 0 THEN 'LOW' WHEN cu >= 0.5 OR up >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS vault_curve_progress_bin,
        CASE WHEN NOT v_ok THEN 'MISSING' WHEN {_n('liquidity_exit_proxy_asof')} > 0 OR {_n('liquidity_delta_asof')} < 0 THEN 'HIGH' ELSE 'LOW' END AS liquidity_risk_bin,
        provider_gap_exposed OR relay_gap_exposed OR sequence_gap_exposed OR hash_mismatch_exposed OR receiver_backpressure_exposed AS spoilt FROM z)"""
_BIN_NAMES = ["trade_delta_bin", "buy_followthrough_bin", "sell_pressure_bin", "holder_growth_bin", "holder_risk_bin", "vault_curve_progress_bin", "liquidity_risk_bin"]


@query(f"WITH {_BINS} SELECT k, {', '.join(_BIN_NAMES)} FROM b")
def p4_alpha_bins(spark, sf_dir):
    return asof_rows(spark, sf_dir).select("k", *[c.alias(n) for n, c in G.alpha_bins().items()])


_AVOID = _join(("rejected_before_horizon", "rejected_before_horizon"), ("buy_followthrough_bin = 'LOW'", "insufficient_buy_followthrough"), ("sell_pressure_bin = 'HIGH'", "adverse_sell_pressure"))


@query(f"""WITH {_BINS} SELECT k, CASE WHEN spoilt OR terminal_inconclusive_before_horizon THEN 'audit_only' WHEN NOT horizon_reached THEN 'insufficient_data' WHEN rejected_before_horizon OR buy_followthrough_bin = 'LOW' OR sell_pressure_bin = 'HIGH' THEN 'avoid' ELSE 'continue_tracking' END AS decision,
    CASE WHEN spoilt THEN 'data_quality_exclusion' WHEN terminal_inconclusive_before_horizon THEN 'terminal_inconclusive_censored' WHEN NOT horizon_reached THEN 'missing_horizon' WHEN {_AVOID} <> '' THEN {_AVOID} ELSE 'asof_alpha_no_early_avoid_blocker' END AS reasons FROM b""")
def p1_early_avoid_bins(spark, sf_dir):
    return _out(G.early_avoid_bins(asof_rows(spark, sf_dir)))


_TRACK = _join(
    ("NOT tracked_at_least_horizon", "insufficient_observation_at_horizon"), ("data_quality_provider_gap_exposed", "provider_gap_censored"), ("data_quality_sequence_gap", "relay_gap_censored"), ("data_quality_hash_mismatch", "hash_mismatch_censored"),
    ("data_quality_receiver_backpressure", "receiver_backpressure_censored"), ("data_quality_degraded_active_mint", "degraded_audit_only"), ("label_censored", "label_censored_not_dead"),
)


@query(f"""WITH {_ROWS} SELECT k, CASE WHEN data_quality_provider_gap_exposed OR data_quality_sequence_gap OR data_quality_hash_mismatch OR data_quality_receiver_backpressure OR label_censored THEN 'censored' WHEN data_quality_degraded_active_mint THEN 'audit_only'
    WHEN NOT tracked_at_least_horizon THEN 'stop_tracking' ELSE 'continue_tracking' END AS decision, {_TRACK} AS reasons FROM a""")
def p2_continue_v0(spark, sf_dir):
    return _out(G.continue_v0(asof_rows(spark, sf_dir)))


_TOLD = "NOT terminal_inconclusive_before_horizon AND NOT provider_gap_exposed AND NOT relay_gap_exposed AND horizon_reached"


@query(f"""WITH {_ROWS} SELECT k, CASE WHEN terminal_inconclusive_before_horizon THEN 'censored' WHEN provider_gap_exposed OR relay_gap_exposed THEN 'audit_only' WHEN NOT horizon_reached THEN 'insufficient_data' WHEN rejected_before_horizon THEN 'avoid' ELSE 'continue_tracking' END AS decision,
    {_join(*_QUALITY, (f'{_TOLD} AND rejected_before_horizon', 'stop_tracking_after_rejection'), (f'{_TOLD} AND NOT rejected_before_horizon', 'survived_current_horizon'))} AS reasons FROM a""")
def p2_continue_v1(spark, sf_dir):
    return _out(G.continue_v1(asof_rows(spark, sf_dir)))


_ALPHA = [
    ("leaked_outcome = 'x'", "forbidden_future_leakage_column"), ("provider_gap_exposed OR label_provider_gap_exposed", "provider_gap_exposed"), ("relay_gap_exposed OR label_relay_gap_exposed OR sequence_gap_exposed", "relay_gap_exposed"), ("hash_mismatch_exposed", "hash_mismatch_exposed"),
    ("receiver_backpressure_exposed", "receiver_backpressure_exposed"), ("NOT horizon_reached", "missing_horizon"), ("terminal_inconclusive_before_horizon OR final_outcome = 'terminal_inconclusive'", "terminal_inconclusive"), ("rejected_before_horizon", "rejected_before_horizon"),
    ("degraded_audit_only_before_horizon OR label_degraded_active_mint", "high_throughput_degraded_audit_only"), ("NOT (degraded_audit_only_before_horizon OR label_degraded_active_mint) AND high_throughput_before_horizon", "high_throughput_clean_observation"),
    ("NOT t_ok", "missing_asof_trade_delta"), ("trade_delta_bin = 'LOW'", "insufficient_trade_delta_strength"), ("buy_followthrough_bin = 'LOW'", "insufficient_buy_followthrough"), ("sell_pressure_bin = 'HIGH'", "adverse_sell_pressure"),
    ("NOT h_ok", "missing_asof_holder_state"), ("holder_risk_bin = 'HIGH'", "holder_concentration_risk"), ("h_ok AND holder_collapse_proxy_asof > 0", "holder_collapse_risk"), ("h_ok AND dev_or_creator_holding_proxy_asof > 0", "dev_or_creator_holding_risk"), ("holder_growth_bin = 'LOW'", "weak_holder_growth"),
    ("NOT v_ok", "missing_asof_vault_curve"), ("vault_curve_progress_bin = 'LOW'", "weak_vault_curve_progress"), ("vault_curve_progress_bin = 'LOW'", "insufficient_curve_progress"), ("liquidity_risk_bin = 'HIGH'", "liquidity_exit_risk"),
    ("NOT candidate_checkpoint_seen", "candidate_checkpoint_absent"), ("NOT replay_eligible", "replay_not_countability_allowed"),
]


@query(f"""WITH {_BINS}, r AS (SELECT *, {_join(*_ALPHA[1:-2])} AS rest FROM b), d AS (SELECT *, spoilt OR terminal_inconclusive_before_horizon AS cen, buy_followthrough_bin IN ('MEDIUM', 'HIGH') AND holder_risk_bin <> 'HIGH' AND liquidity_risk_bin <> 'HIGH' AS going FROM r)
    SELECT k, CASE WHEN cen THEN 'censored' WHEN degraded_audit_only_before_horizon THEN 'audit_only' WHEN NOT horizon_reached OR rejected_before_horizon THEN 'stop_tracking' WHEN going THEN 'continue_tracking' ELSE 'stop_tracking' END AS decision,
        CASE WHEN cen THEN 'data_quality_or_terminal_censored' WHEN degraded_audit_only_before_horizon THEN 'high_throughput_degraded_audit_only' WHEN NOT horizon_reached THEN 'missing_horizon' WHEN rejected_before_horizon THEN 'rejected_before_horizon'
            WHEN going THEN 'asof_alpha_continue_observation' WHEN rest = '' THEN 'weak_alpha_profile' ELSE rest END AS reasons FROM d""")
def p2_continue_bins(spark, sf_dir):
    return _out(G.continue_bins(asof_rows(spark, sf_dir)))


_E0 = _join(
    *[(n, n) for n in ("data_quality_sequence_gap", "data_quality_hash_mismatch", "data_quality_receiver_backpressure", "data_quality_provider_gap_exposed", "data_quality_degraded_active_mint")],
    ("label_censored", "censored_label"), ("NOT tracked_at_least_horizon", "insufficient_observation"), ("label_clean_negative", "historical_clean_negative"),
)


@query(f"""WITH {_ROWS} SELECT k, CASE WHEN label_clean_positive THEN 'candidate_eligible_research_only' WHEN label_censored OR data_quality_provider_gap_exposed OR data_quality_sequence_gap OR data_quality_hash_mismatch THEN 'censored' ELSE 'not_eligible' END AS decision, {_E0} AS reasons FROM a""")
def p3_eligibility_v0(spark, sf_dir):
    return _out(G.eligibility_v0(asof_rows(spark, sf_dir)))


_HARD = "provider_gap_exposed OR label_provider_gap_exposed OR data_quality_relay_gap_exposed OR label_relay_gap_exposed OR data_quality_sequence_gap OR data_quality_hash_mismatch OR data_quality_receiver_backpressure"
_E1 = _join(
    ("data_quality_provider_gap_exposed OR label_provider_gap_exposed", "provider_gap_exposed"), ("data_quality_relay_gap_exposed OR label_relay_gap_exposed", "relay_gap_exposed"), ("data_quality_sequence_gap", "relay_sequence_gap"), ("data_quality_hash_mismatch", "hash_mismatch_exposed"),
    ("data_quality_receiver_backpressure", "receiver_backpressure_exposed"), ("final_outcome = 'terminal_inconclusive' OR label_censored", "terminal_inconclusive"), ("data_quality_degraded_active_mint OR label_degraded_active_mint", "degraded_audit_only"),
    ("NOT tracked_at_least_horizon", "insufficient_observation_horizon"), ("NOT tracked_at_least_horizon", "no_survival_to_required_horizon"),
)
_E1B = _join(
    ("NOT candidate_checkpoint_seen", "candidate_checkpoint_absent"), ("NOT replay_eligible", "replay_not_countability_allowed"),
    ("asof_alpha_trade_delta_available", "feature_available_in_new_asof_alpha_slices:trade_delta"), ("NOT asof_alpha_trade_delta_available", "feature_unavailable_in_prior_slices:trade_delta"), ("NOT asof_alpha_trade_delta_available", "missing_trade_delta_features"),
    ("asof_alpha_holder_state_available", "feature_available_in_new_asof_alpha_slices:holder_state"), ("NOT asof_alpha_holder_state_available", "feature_unavailable_in_prior_slices:holder_state"), ("NOT asof_alpha_holder_state_available", "missing_holder_snapshot_features"),
    ("asof_alpha_vault_curve_available", "feature_available_in_new_asof_alpha_slices:vault_curve"), ("NOT asof_alpha_vault_curve_available", "feature_unavailable_in_prior_slices:vault_curve"), ("NOT asof_alpha_vault_curve_available", "missing_vault_curve_features"),
    ("NOT label_clean_negative AND NOT label_censored", "gate_too_strict_review"),
)
_ELIGIBLE1 = f"""{_ROWS}, n AS (SELECT *, CASE WHEN label_clean_negative THEN 'early_rejection_reason_' || CASE CASE WHEN rejection_reason <> '' THEN rejection_reason WHEN final_outcome_reason <> '' THEN final_outcome_reason ELSE '' END
            WHEN 'Volume Evaporated!' THEN 'volume_evaporated' WHEN 'holder-collapse' THEN 'holder_collapse' WHEN 'odd reason' THEN 'odd_reason' WHEN 'no buy followthrough' THEN 'no_buy_followthrough' ELSE 'unknown' END END AS rej, {_E1} AS e1, {_E1B} AS e2 FROM a),
    v1 AS (SELECT *, concat_ws('|', CASE WHEN e1 <> '' THEN e1 END, rej, CASE WHEN e2 <> '' THEN e2 END) AS reasons, CASE WHEN label_censored OR final_outcome = 'terminal_inconclusive' OR data_quality_degraded_active_mint OR label_degraded_active_mint OR {_HARD} THEN 'censored' ELSE 'not_eligible' END AS decision,
        CASE WHEN data_quality_provider_gap_exposed OR label_provider_gap_exposed THEN 'provider_gap_exposed' WHEN data_quality_relay_gap_exposed OR label_relay_gap_exposed THEN 'relay_gap_exposed' WHEN data_quality_sequence_gap THEN 'relay_sequence_gap' WHEN data_quality_hash_mismatch THEN 'hash_mismatch_exposed'
            WHEN data_quality_receiver_backpressure THEN 'receiver_backpressure_exposed' WHEN final_outcome = 'terminal_inconclusive' OR label_censored THEN 'terminal_inconclusive' WHEN data_quality_degraded_active_mint OR label_degraded_active_mint THEN 'degraded_audit_only'
            WHEN NOT tracked_at_least_horizon THEN 'insufficient_observation_horizon' WHEN rej IS NOT NULL AND rej <> 'early_rejection_reason_odd_reason' THEN rej WHEN NOT asof_alpha_trade_delta_available THEN 'missing_trade_delta_features' WHEN NOT asof_alpha_holder_state_available THEN 'missing_holder_snapshot_features'
            WHEN NOT asof_alpha_vault_curve_available THEN 'missing_vault_curve_features' WHEN NOT candidate_checkpoint_seen THEN 'candidate_checkpoint_absent' WHEN NOT replay_eligible THEN 'replay_not_countability_allowed' WHEN NOT label_clean_negative AND NOT label_censored THEN 'gate_too_strict_review' ELSE coalesce(rej, '') END AS first_failed_gate FROM n)"""


@query(f"WITH {_ELIGIBLE1} SELECT k, decision, reasons, first_failed_gate FROM v1")
def p3_eligibility_v1(spark, sf_dir):
    return _out(G.eligibility_v1(asof_rows(spark, sf_dir)), "first_failed_gate")


_ELIGIBLE2 = f"""{_BINS}, r AS (SELECT *, {_join(*_ALPHA)} AS reasons, provider_gap_exposed OR label_provider_gap_exposed OR relay_gap_exposed OR label_relay_gap_exposed OR sequence_gap_exposed OR hash_mismatch_exposed OR receiver_backpressure_exposed OR terminal_inconclusive_before_horizon
        OR coalesce(final_outcome = 'terminal_inconclusive', false) AS cen FROM b),
    v2 AS (SELECT *, CASE WHEN leaked_outcome = 'x' THEN 'audit_only' WHEN cen THEN 'censored' WHEN degraded_audit_only_before_horizon OR label_degraded_active_mint THEN 'audit_only' WHEN NOT horizon_reached OR NOT t_ok OR NOT h_ok OR NOT v_ok THEN 'insufficient_data'
        WHEN candidate_checkpoint_seen AND replay_eligible AND NOT rejected_before_horizon AND trade_delta_bin <> 'LOW' AND buy_followthrough_bin <> 'LOW' AND sell_pressure_bin <> 'HIGH' AND holder_risk_bin <> 'HIGH' AND holder_growth_bin <> 'LOW' AND vault_curve_progress_bin <> 'LOW' AND liquidity_risk_bin <> 'HIGH' THEN 'eligible'
        ELSE 'not_eligible' END AS decision FROM r)"""


@query(f"""WITH {_ELIGIBLE2} SELECT k, decision, reasons, CASE WHEN decision = 'censored' THEN 'CENSORED' WHEN decision = 'audit_only' OR holder_risk_bin = 'HIGH' OR liquidity_risk_bin = 'HIGH' THEN 'UNSAFE' WHEN decision = 'insufficient_data' THEN 'MISSING' WHEN decision = 'eligible' THEN 'HIGH'
    WHEN NOT candidate_checkpoint_seen OR NOT replay_eligible THEN 'LOW' ELSE 'MEDIUM' END AS score FROM v2""")
def p3_eligibility_v2_bins(spark, sf_dir):
    return _out(G.eligibility_v2_bins(asof_rows(spark, sf_dir), ["leaked_outcome"]), "score")


_NT = "trade_update_count_asof IS NULL OR buy_count_delta_asof IS NULL OR sell_count_delta_asof IS NULL"
_NH = "holder_update_count_asof IS NULL OR unique_holder_accounts_seen_asof IS NULL"
_NV = "vault_update_count_asof IS NULL OR bonding_curve_update_count_asof IS NULL OR curve_progress_proxy_asof IS NULL"
_E2 = [
    ("provider_gap_exposed", "provider_gap_exposed"), ("relay_gap_exposed", "relay_gap_exposed"), ("terminal_inconclusive_before_horizon OR label_censored", "terminal_inconclusive"), *_QUALITY[3:],
    (_NT, "missing_asof_trade_delta"), (f"NOT ({_NT}) AND buy_count_delta_asof <= 0", "insufficient_buy_followthrough"), (f"NOT ({_NT}) AND (sell_count_delta_asof > buy_count_delta_asof OR coalesce(net_buy_sell_delta_asof, 0) < 0)", "adverse_sell_pressure"), (f"NOT ({_NT}) AND trade_update_count_asof <= 0", "insufficient_trade_delta_strength"),
    (_NH, "missing_asof_holder_state"), (f"NOT ({_NH}) AND unique_holder_accounts_seen_asof <= 1", "weak_holder_growth"), (f"NOT ({_NH}) AND top_holder_concentration_asof >= 0.75", "holder_concentration_risk"), (f"NOT ({_NH}) AND dev_or_creator_holding_proxy_asof <> 0", "dev_or_creator_holding_risk"),
    (_NV, "missing_asof_vault_curve"), (f"NOT ({_NV}) AND curve_progress_proxy_asof <= 0", "weak_vault_curve_progress"), (f"NOT ({_NV}) AND curve_progress_proxy_asof <= 0", "insufficient_curve_progress"), (f"NOT ({_NV}) AND liquidity_exit_proxy_asof <> 0", "liquidity_exit_risk"),
    ("NOT candidate_checkpoint_seen", "candidate_checkpoint_absent"), ("NOT replay_eligible", "replay_not_countability_allowed"),
]


@query(f"""WITH {_ROWS}, d AS (SELECT *, CASE WHEN provider_gap_exposed OR relay_gap_exposed OR terminal_inconclusive_before_horizon OR label_censored OR degraded_audit_only_before_horizon THEN 'censored' WHEN NOT horizon_reached OR {_NT} OR {_NH} OR {_NV} THEN 'insufficient_data'
        WHEN NOT candidate_checkpoint_seen OR NOT replay_eligible THEN 'candidate_watch' ELSE 'candidate_review' END AS decision FROM a)
    SELECT k, decision, array_to_string(list_sort(list_filter(string_split({_join(*_E2)}, '|'), lambda x: x <> '')), '|') AS reasons, CASE decision WHEN 'censored' THEN 'CENSORED' WHEN 'insufficient_data' THEN 'MISSING' WHEN 'candidate_watch' THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM d""")
def p3_eligibility_v2_gates(spark, sf_dir):
    return _out(G.eligibility_v2_gates(asof_rows(spark, sf_dir)), "confidence")


_BURST = [
    ("net_buy_sell_delta_asof >= 3 OR buy_count_delta_asof >= 3", "early_buy_sell_followthrough"), ("curve_progress_proxy_asof >= 35", "early_curve_progress"), ("CASE WHEN coalesce(new_holder_count_delta_asof, 0) <> 0 THEN new_holder_count_delta_asof ELSE unique_holder_accounts_seen_asof END >= 3", "early_holder_growth"), ("volume_delta_asof > 0", "early_volume_followthrough"),
]


@query(f"""WITH {_ROWS}, x AS (SELECT *, coalesce({' OR '.join(f'coalesce({c}, false)' for c, _ in _BURST)}, false) AS started, coalesce(sell_count_delta_asof, 0) > coalesce(buy_count_delta_asof, 0) OR coalesce(net_buy_sell_delta_asof, 0) < 0 AS adverse, coalesce(top_holder_concentration_asof >= 0.85, false) AS top FROM a WHERE horizon_seconds IN (5, 10, 30)),
    d AS (SELECT *, CASE WHEN provider_gap_exposed OR relay_gap_exposed OR data_quality_exclusion THEN 'audit_only' WHEN terminal_inconclusive_before_horizon THEN 'censored' WHEN NOT horizon_reached THEN 'insufficient_data' WHEN started THEN 'early_burst_watch' WHEN adverse OR top THEN 'reject' ELSE 'insufficient_data' END AS decision FROM x)
    SELECT k, decision, CASE WHEN decision = 'audit_only' THEN 'data_quality_excluded' WHEN decision = 'censored' THEN 'terminal_inconclusive' WHEN NOT horizon_reached THEN 'insufficient_horizon' ELSE {_join(('adverse', 'adverse_sell_pressure'), ('rejected_before_horizon', 'death_after_burst'), ('dev_or_creator_holding_proxy_asof <> 0', 'dev_or_creator_holding_risk'), *_BURST, ('top', 'holder_concentration_risk'), ('NOT started AND NOT adverse AND NOT top', 'insufficient_horizon'), ('true', 'replay_not_allowed'), ('rejected_before_horizon', 'weak_exit_window'))} END AS reasons,
        CASE decision WHEN 'audit_only' THEN 'UNSAFE' WHEN 'censored' THEN 'CENSORED' WHEN 'insufficient_data' THEN 'MISSING' WHEN 'early_burst_watch' THEN 'LOW' ELSE 'UNSAFE' END AS confidence FROM d""")
def p5_early_burst_v0(spark, sf_dir):
    return _out(G.early_burst_v0(asof_rows(spark, sf_dir).where("horizon_seconds in (5, 10, 30)")), "confidence")


def _plain_bin(c: str, low: str, high: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'MISSING' WHEN {c} <= 0 THEN 'LOW' WHEN {c} >= {high} THEN 'HIGH' WHEN {c} >= {low} THEN 'MEDIUM' ELSE 'LOW' END"


_UP = lambda c: f"{c} IN ('HIGH', 'MEDIUM')"


@query(f"""WITH {_ROWS}, b AS (SELECT *, {_plain_bin('trade_burst_score_asof', '0.1', '0.5')} AS tb, {_plain_bin('buy_count_delta_asof', '1', '3')} AS bb, {_plain_bin('volume_delta_asof', '500000000', '5000000000')} AS vb, {_plain_bin('top_holder_concentration_asof', '0.5', '0.8')} AS hb, {_plain_bin('dev_or_creator_holding_proxy_asof', '0.02', '0.10')} AS db, {_plain_bin('curve_progress_proxy_asof', '20', '50')} AS cb,
        CASE WHEN sell_count_delta_asof IS NULL AND net_buy_sell_delta_asof IS NULL THEN 'MISSING' WHEN net_buy_sell_delta_asof < 0 OR sell_count_delta_asof >= coalesce(buy_count_delta_asof, 0) + 2 THEN 'HIGH' WHEN sell_count_delta_asof > 0 THEN 'MEDIUM' ELSE 'LOW' END AS sb,
        coalesce(liquidity_exit_proxy_asof, 0) <> 0 OR coalesce(avoider_reasons LIKE '%liquidity_exit_proxy%', false) AS le, holder_collapse_proxy_asof <> 0 OR coalesce(avoider_reasons LIKE '%holder_collapse_proxy%', false) AS hc, coalesce(avoider_decision = 'avoid', false) AS av FROM a),
    c AS (SELECT *, {_UP('bb')} AND sb IN ('LOW', 'MEDIUM') AND NOT le AND NOT hc AND vb = 'HIGH' AS calm FROM b),
    s AS (SELECT *, calm AND cb = 'HIGH' AS strong, calm AND {_UP('cb')} AND {_UP('tb')} AS second, le OR hc OR sb = 'HIGH' OR (av AND (bb = 'LOW' OR vb = 'LOW' OR cb IN ('LOW', 'MISSING'))) AS dead FROM c),
    p AS (SELECT *, CASE WHEN terminal_inconclusive_before_horizon OR coalesce(final_outcome = 'terminal_inconclusive', false) THEN 1 WHEN data_quality_exclusion OR provider_gap_exposed OR relay_gap_exposed OR sequence_gap_exposed OR hash_mismatch_exposed OR receiver_backpressure_exposed OR coalesce(positive_outcome_label = 'invalid_quality', false) THEN 2
        WHEN NOT horizon_reached THEN 3 WHEN strong THEN 4 WHEN second THEN 5 WHEN dead THEN 6 ELSE 7 END AS i FROM s)
    SELECT k, ['censored', 'audit_only', 'insufficient_data', 'promote_to_rich_tracking_research_only', 'promote_to_rich_tracking_research_only', 'reject', 'keep_cheap_followup'][i] AS decision,
        CASE WHEN i = 1 THEN 'terminal_inconclusive_censored' WHEN i = 2 THEN 'data_quality_excluded' WHEN i = 3 THEN 'insufficient_followup'
            WHEN i < 6 THEN 'sufficient_horizon_coverage|early_curve_progress|early_volume_followthrough|early_buy_sell_followthrough|low_adverse_sell_pressure|vault_curve_progress' || CASE WHEN high_throughput_before_horizon THEN '|clean_high_throughput_watch' ELSE '' END || CASE WHEN hb NOT IN ('HIGH', 'MISSING') AND db NOT IN ('HIGH', 'MISSING') THEN '|absence_of_holder_dev_risk' ELSE '' END
                || CASE WHEN hb = 'HIGH' THEN '|holder_concentration_risk' ELSE '' END || CASE WHEN db = 'HIGH' THEN '|dev_or_creator_holding_risk' ELSE '' END
            WHEN i = 6 THEN {_join(('true', 'dead_launch_avoider_reject'), ('le', 'liquidity_exit_proxy'), ("sb = 'HIGH'", 'adverse_sell_pressure'), ("hb = 'HIGH'", 'holder_concentration_risk'), ("db = 'HIGH'", 'dev_or_creator_holding_risk'), (f"NOT {_UP('bb')} OR NOT {_UP('vb')}", 'insufficient_followup'))}
            ELSE {_join(('true', 'insufficient_followup'), ('av', 'dead_launch_avoider_reject'), (_UP('cb'), 'early_curve_progress'), (_UP('vb'), 'early_volume_followthrough'), (_UP('bb'), 'early_buy_sell_followthrough'))} END AS reasons,
        ['CENSORED', 'UNSAFE', 'MISSING', 'HIGH', 'MEDIUM', 'UNSAFE', 'LOW'][i] AS confidence FROM p""")
def p6_promotion_priority(spark, sf_dir):
    return _out(G.promotion_priority(asof_rows(spark, sf_dir)), "confidence")


def _pos(c: str, medium: str, high: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} <= 0 THEN 'MISSING' WHEN {c} >= {high} THEN 'HIGH' WHEN {c} >= {medium} THEN 'MEDIUM' ELSE 'LOW' END"


def _risk(c: str, medium: str, high: str, unsafe: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'MISSING' WHEN {c} >= {unsafe} THEN 'UNSAFE' WHEN {c} >= {high} THEN 'HIGH' WHEN {c} >= {medium} THEN 'MEDIUM' ELSE 'LOW' END"


_PRE = f"""{_ROWS}, q AS (SELECT *, CASE WHEN data_quality_exclusion OR provider_gap_exposed OR relay_gap_exposed OR sequence_gap_exposed OR hash_mismatch_exposed OR receiver_backpressure_exposed THEN 1 WHEN terminal_inconclusive_before_horizon THEN 2 WHEN degraded_audit_only_before_horizon THEN 3 WHEN rejected_before_horizon THEN 4
        WHEN holder_collapse_proxy_asof <> 0 THEN 5 WHEN coalesce(liquidity_exit_proxy_asof, 0) <> 0 THEN 6 ELSE 7 END AS i, CASE WHEN coalesce(new_holder_count_delta_asof, 0) <> 0 THEN new_holder_count_delta_asof ELSE unique_holder_accounts_seen_asof END AS growth,
        nullif(greatest(coalesce(top_holder_concentration_asof, 0), coalesce(dev_or_creator_holding_proxy_asof, 0)), 0) AS most, greatest(-coalesce(liquidity_delta_asof, 0), 0) AS fall FROM a),
    pre AS (SELECT *, ['audit_only', 'censored', 'audit_only', 'reject', 'reject', 'reject', 'continue_observation'][i] AS prefilter,
        ['data_quality_excluded', 'terminal_inconclusive_censored', 'degraded_audit_only', 'dead_launch_avoider_reject|rejected_before_horizon', 'dead_launch_avoider_reject|holder_collapse_risk', 'dead_launch_avoider_reject|liquidity_exit_proxy', 'no_obvious_dead_launch_risk_by_fixed_bins'][i] AS why FROM q)"""
_LIQ = lambda high: f"CASE WHEN coalesce(liquidity_exit_proxy_asof, 0) <> 0 THEN 'UNSAFE' WHEN fall >= {high} THEN 'HIGH' WHEN fall >= 1 THEN 'MEDIUM' ELSE 'LOW' END"
_BAD = lambda c: f"{c} IN ('HIGH', 'UNSAFE')"
_REVIEW = "review_only_no_replay_eligibility_created"
_INOUT = f"""{_PRE}, w AS (SELECT *, {_pos('curve_progress_proxy_asof', '20', '50')} AS curve_progress_bin, {_pos('net_buy_sell_delta_asof', '2', '5')} AS buy_sell_followthrough_bin, {_pos('volume_delta_asof', '1', '1000000000')} AS volume_followthrough_bin, {_pos('growth', '2', '6')} AS holder_growth_bin, {_risk('sell_count_delta_asof', '2', '5', '8')} AS sell_pressure_bin,
        {_risk('most', '0.55', '0.75', '0.9')} AS holder_dev_risk_bin, {_LIQ('10')} AS liquidity_risk_bin FROM pre),
    e AS (SELECT *, CASE WHEN i < 7 THEN 0 WHEN NOT horizon_reached THEN 1 WHEN NOT promoted THEN 2 WHEN curve_progress_bin IN ('MISSING', 'LOW') THEN 3 WHEN buy_sell_followthrough_bin = 'MISSING' THEN 4 WHEN volume_followthrough_bin = 'MISSING' THEN 5 WHEN {_BAD('sell_pressure_bin')} THEN 6 WHEN {_BAD('holder_dev_risk_bin')} THEN 7
        WHEN {_BAD('liquidity_risk_bin')} THEN 8 WHEN NOT exit_observed THEN 9 ELSE 10 END AS j FROM w),
    v0 AS (SELECT *, CASE WHEN j = 0 THEN prefilter WHEN j IN (1, 9) THEN 'insufficient_data' WHEN j = 10 THEN 'early_burst_candidate_review' ELSE 'reject' END AS decision, why || CASE WHEN j = 0 THEN '' ELSE '|' || ['insufficient_followup', 'v1_not_promoted_or_would_promote_absent', 'early_curve_progress_weak_or_missing', 'early_buy_sell_followthrough_weak_or_missing', 'early_volume_followthrough_missing',
        'adverse_sell_pressure', 'holder_or_dev_concentration_risk', 'liquidity_exit_proxy', 'exit_window_not_observed_or_measurable', 'v1_promoted_or_would_promote|early_curve_progress|early_buy_sell_followthrough|early_volume_followthrough|exit_window_observed'][j] END
        || CASE WHEN j < 10 THEN '|{_REVIEW}' WHEN buy_sell_followthrough_bin = 'LOW' THEN '|early_buy_sell_followthrough_low_but_present' ELSE '' END AS reasons FROM e),
    v0b AS (SELECT *, list_filter(string_split(reasons, '|'), lambda x: x <> 'no_obvious_dead_launch_risk_by_fixed_bins')[1] AS top_blocker FROM v0)"""
_INOUT_BINS = ["curve_progress_bin", "buy_sell_followthrough_bin", "volume_followthrough_bin", "holder_growth_bin", "sell_pressure_bin", "holder_dev_risk_bin", "liquidity_risk_bin"]


@query(f"WITH {_INOUT} SELECT k, decision, reasons, prefilter, top_blocker, {', '.join(_INOUT_BINS)} FROM v0b")
def p7_early_burst_in_out_v0(spark, sf_dir):
    return _out(G.early_burst_in_out_v0(asof_rows(spark, sf_dir)), "prefilter", "top_blocker", *_INOUT_BINS)


_RUNNER_BINS = ["survival_horizon_bin", "holder_growth_bin", "holder_stability_bin", "curve_progress_bin", "sell_pressure_bin", "liquidity_risk_bin", "holder_dev_risk_bin"]


@query(f"""WITH {_PRE}, w AS (SELECT *, CASE WHEN NOT horizon_reached OR horizon_seconds < 120 THEN 'MISSING' WHEN horizon_seconds >= 900 THEN 'HIGH' WHEN horizon_seconds >= 300 THEN 'MEDIUM' ELSE 'LOW' END AS survival_horizon_bin, {_pos('growth', '3', '8')} AS holder_growth_bin,
        CASE WHEN top_holder_concentration_asof IS NULL THEN 'MISSING' WHEN top_holder_concentration_asof <= 0.45 THEN 'HIGH' WHEN top_holder_concentration_asof <= 0.65 THEN 'MEDIUM' WHEN top_holder_concentration_asof <= 0.8 THEN 'LOW' ELSE 'UNSAFE' END AS holder_stability_bin,
        {_pos('curve_progress_proxy_asof', '35', '70')} AS curve_progress_bin, {_risk('sell_count_delta_asof', '2', '4', '6')} AS sell_pressure_bin, {_LIQ('5')} AS liquidity_risk_bin, {_risk('most', '0.45', '0.65', '0.85')} AS holder_dev_risk_bin FROM pre),
    e AS (SELECT *, CASE WHEN i < 7 THEN 0 WHEN survival_horizon_bin = 'MISSING' THEN 1 WHEN survival_horizon_bin = 'LOW' THEN 2 WHEN holder_growth_bin IN ('MISSING', 'LOW') THEN 3 WHEN holder_stability_bin IN ('LOW', 'UNSAFE') OR {_BAD('holder_dev_risk_bin')} THEN 4 WHEN curve_progress_bin IN ('MISSING', 'LOW') THEN 5
        WHEN {_BAD('sell_pressure_bin')} THEN 6 WHEN {_BAD('liquidity_risk_bin')} THEN 7 ELSE 8 END AS j FROM w),
    f AS (SELECT *, CASE WHEN j = 0 THEN prefilter ELSE ['insufficient_data', 'continue_observation', 'continue_observation', 'reject', 'continue_observation', 'reject', 'reject', 'survivor_candidate_review'][j] END AS decision, why || CASE WHEN j = 0 THEN '' ELSE '|' || ['missing_long_horizon', 'survival_horizon_not_long_enough', 'weak_holder_growth', 'holder_or_dev_concentration_risk',
        'weak_vault_curve_progress', 'adverse_sell_pressure', 'liquidity_exit_proxy', 'long_horizon_survival|holder_growth_or_stability|vault_curve_progress|low_adverse_sell_pressure'][j] END || CASE WHEN j < 8 THEN '|{_REVIEW}' WHEN promoted THEN '|v1_promoted_or_would_promote' ELSE '' END AS reasons FROM e)
    SELECT k, decision, reasons, prefilter, list_filter(string_split(reasons, '|'), lambda x: x <> 'no_obvious_dead_launch_risk_by_fixed_bins')[1] AS top_blocker, {', '.join(_RUNNER_BINS)} FROM f""")
def p8_survivor_runner(spark, sf_dir):
    return _out(G.survivor_runner(asof_rows(spark, sf_dir)), "prefilter", "top_blocker", *_RUNNER_BINS)


_THERE = lambda c: f"{c} IN ('LOW', 'MEDIUM', 'HIGH')"
_ADD = [(_BAD("sell_pressure_bin"), "adverse_sell_pressure_before_exit"), (_BAD("holder_dev_risk_bin"), "holder_concentration_risk"), (_BAD("holder_dev_risk_bin"), "dev_or_creator_holding_risk"), (_BAD("liquidity_risk_bin"), "liquidity_exit_proxy"), ("curve_progress_bin IN ('MISSING', 'LOW') AND n <> 8", "curve_progress_stall")]


@query(f"""WITH {_INOUT}, m AS (SELECT *, {_join((_THERE('curve_progress_bin'), 'early_curve_progress'), (_THERE('buy_sell_followthrough_bin'), 'early_buy_sell_followthrough'), (_THERE('volume_followthrough_bin'), 'early_volume_followthrough'))} AS evidence, exit_observed OR forward_window_observed AS seen FROM v0b),
    n AS (SELECT *, CASE WHEN censored_label OR coalesce(final_outcome = 'terminal_inconclusive', false) THEN 1 WHEN decision = 'audit_only' OR top_blocker IN ('data_quality_excluded', 'degraded_audit_only') THEN 2 WHEN candidate_checkpoint_seen THEN 3 WHEN prefilter = 'reject' THEN 4 WHEN NOT promoted THEN 5 WHEN NOT seen THEN 6 WHEN evidence = '' THEN 7 ELSE 8 END AS n FROM m),
    o AS (SELECT *, CASE n WHEN 1 THEN 'terminal_inconclusive_censored' WHEN 2 THEN CASE WHEN reasons LIKE '%gap%' THEN 'provider_or_relay_gap_exposed' ELSE 'missing_asof_features' END WHEN 3 THEN 'candidate_checkpoint_audit_only|replay_not_allowed' WHEN 4 THEN 'dead_launch_avoider_reject' WHEN 5 THEN 'v1_not_promoted_or_would_promote_absent'
            WHEN 6 THEN 'missing_horizon' WHEN 7 THEN 'missing_asof_features' ELSE 'v1_promoted_or_would_promote|' || evidence || '|research_only_not_signal|replay_not_allowed' END AS base, {_join(*_ADD)} AS extra FROM n)
    SELECT k, ['censored', 'audit_only', 'audit_only', 'reject', 'reject', 'insufficient_data', 'reject', 'early_burst_candidate_review'][n] AS v1_decision, base || CASE WHEN extra <> '' THEN '|' || extra ELSE '' END || CASE WHEN n IN (3, 8) THEN '' ELSE '|replay_not_allowed' END AS v1_reasons, string_split(base, '|')[1] AS v1_top_blocker,
        CASE WHEN seen THEN 'observable_for_review' ELSE 'insufficient_data' END AS guard_decision, coalesce(nullif({_join(('NOT seen', 'missing_horizon'), (_BAD('sell_pressure_bin'), 'adverse_sell_pressure_before_exit'), (_BAD('liquidity_risk_bin'), 'liquidity_exit_proxy'))}, ''), 'exit_window_observable_for_review') AS guard_reasons,
        CASE WHEN n = 8 THEN 'replay_not_allowed' END AS replay_blocker FROM o""")
def p9_early_burst_in_out_v1(spark, sf_dir):
    x = G.early_burst_in_out_v1(G.early_burst_in_out_v0(asof_rows(spark, sf_dir)))
    return x.select("k", "v1_decision", F.array_join("v1_reasons", "|").alias("v1_reasons"), "v1_top_blocker", "guard_decision", F.array_join("guard_reasons", "|").alias("guard_reasons"), "replay_blocker")


_HI = "lower(coalesce(positive_outcome_label, '')) IN ('positive', 'high_positive')"


@query(f"""WITH {_ROWS}, x AS (SELECT *, lower(coalesce(candidate_gate_reason_codes, '')) AS why, {_HI} OR high_positive AS hi FROM a WHERE {_HI} OR high_positive OR early_burst_watch OR candidate_watch OR near_miss OR promoted OR rich_tracked OR all_launch_indexed),
    y AS (SELECT *, coalesce(final_outcome = 'early_rejected_dead', false) OR rejected_reason IS NOT NULL OR why LIKE '%rejected_before_horizon%' AS rejd FROM x),
    z AS (SELECT *, CASE WHEN replay_eligible THEN 1 WHEN NOT r2_verified OR NOT artifact_consistency_ok THEN 2 WHEN provider_gap_exposed OR relay_gap_exposed THEN 3 WHEN terminal_inconclusive OR censored THEN 4 WHEN NOT counted_run OR NOT counted_segment THEN 5 WHEN why LIKE '%missing_asof%' THEN 6 WHEN why LIKE '%missing_horizon%' OR cheap_followup_horizons_reached IN ('', '5', '10') THEN 7
        WHEN rejd AND hi THEN 8 WHEN rejd THEN 9 WHEN hi AND NOT candidate_checkpoint_seen THEN 10 WHEN promoted AND NOT candidate_checkpoint_seen THEN 11 WHEN NOT rich_tracked AND promoted THEN 12 WHEN NOT rich_tracked THEN 13 WHEN NOT candidate_checkpoint_seen THEN 14 WHEN why LIKE '%replay_not_countability_allowed%' THEN 15 ELSE 16 END AS i FROM y)
    SELECT k, ['none', 'r2_or_artifact_blocker', 'provider_or_relay_gap_exposed', 'terminal_inconclusive_or_censored', 'countability_false', 'missing_asof_features', 'missing_required_horizon', 'positive_outcome_rejected_before_material_candidate_horizon', 'rejected_before_horizon', 'positive_high_without_candidate_checkpoint', 'v1_promoted_without_candidate_artifact',
            'promotion_budget_or_policy_miss', 'rich_tracking_not_reached', 'candidate_checkpoint_absent', 'replay_not_countability_allowed', 'no_candidate_like_behavior_seen'][i] AS blocker,
        ['REPLAY_POLICY_BLOCK_ONLY', 'R2_OR_ARTIFACT_BLOCKED', 'PROVIDER_OR_RELAY_GAP_EXPOSED', 'TERMINAL_INCONCLUSIVE_CENSORED', 'COUNTABILITY_POLICY_BLOCK', 'MISSING_ASOF_FEATURES', 'MISSING_HORIZON', 'SURVIVOR_GATE_MISMATCH_FOR_EARLY_BURST', 'REJECTED_BEFORE_HORIZON', 'POSITIVE_OUTCOME_NOT_MATERIAL_CANDIDATE', 'V1_PROMOTED_BUT_NO_CANDIDATE_ARTIFACT',
            'PROMOTION_BUDGET_OR_POLICY_MISS', 'RICH_TRACKING_NOT_REACHED', 'CANDIDATE_CHECKPOINT_ABSENT', 'COUNTABILITY_POLICY_BLOCK', 'NO_CANDIDATE_BEHAVIOR_SEEN'][i] AS root_cause,
        ['stop_for_operator_candidate_review_no_replay', 'fix_artifact_or_r2_before_replay_research', 'keep_censored_do_not_replay', 'keep_censored_do_not_replay', 'inspect_countability_policy_no_replay', 'retain_required_asof_features_before_replay_research', 'collect_uniform_horizons_only_if_approved', 'review_early_burst_replay_candidate_type', 'research_only_no_replay',
            'design_early_burst_replay_candidate_type_proposal', 'audit_shadow_to_candidate_artifact_mapping', 'review_shadow_control_proof_before_collection', 'no_replay_candidate_without_rich_tracking_or_new_artifact_type', 'diagnose_candidate_gate_mapping', 'keep_replay_blocked', 'continue_research_without_replay'][i] AS action FROM z""")
def p10_replay_blockers(spark, sf_dir):
    return asof_rows(spark, sf_dir).where(G.selected_for_audit()).select("k", G.replay_blocker().alias("b")).select("k", "b.*")


@query(f"""WITH {_ELIGIBLE1} SELECT k, first_failed_gate, CASE WHEN {_HARD} THEN 'DATA_QUALITY_EXCLUDED' WHEN label_censored OR final_outcome = 'terminal_inconclusive' THEN 'CENSORED_OR_INCOMPLETE' WHEN rej IS NOT NULL THEN 'FAILED_BEHAVIOR'
        WHEN NOT asof_alpha_trade_delta_available OR NOT asof_alpha_holder_state_available OR NOT asof_alpha_vault_curve_available THEN 'MISSING_ASOF_FEATURES' ELSE 'GATE_TOO_STRICT_REVIEW' END AS gap
    FROM v1 WHERE NOT (data_quality_provider_gap_exposed OR data_quality_sequence_gap OR data_quality_hash_mismatch OR data_quality_receiver_backpressure OR label_censored OR data_quality_degraded_active_mint OR NOT tracked_at_least_horizon)""")
def p11_continue_gap(spark, sf_dir):
    tracked = G.continue_v0(asof_rows(spark, sf_dir)).where("decision = 'continue_tracking'").drop("decision", "reasons")
    return G.eligibility_v1(tracked).select("k", "first_failed_gate", G.continue_gap().alias("gap"))


@query(f"""WITH {_ELIGIBLE2}, h AS (SELECT mint, string_agg(horizon_seconds, '|' ORDER BY horizon_seconds) FILTER (horizon_reached) AS reached FROM a GROUP BY mint), s AS (SELECT * FROM v2 WHERE horizon_seconds = 60 QUALIFY row_number() OVER (PARTITION BY mint ORDER BY k DESC) = 1),
    j AS (SELECT h.mint, coalesce(reached, '') AS horizons_reached, coalesce(decision, 'insufficient_data') AS decision, coalesce(reasons, '') AS reasons, coalesce(label_censored, false) AS cens FROM h LEFT JOIN s USING (mint))
    SELECT mint, horizons_reached, decision, array_to_string(string_split(reasons, '|')[1:5], '|') AS top_reasons, CASE WHEN decision = 'eligible' THEN 'candidate_discovery_passed_research_only' WHEN cens THEN 'censored_or_incomplete_observation' WHEN reasons LIKE '%missing_asof%' OR reasons LIKE '%missing_horizon%' THEN 'insufficient_horizon_or_missing_alpha_features'
            WHEN reasons LIKE '%candidate_checkpoint_absent%' THEN 'no_candidate_checkpoint_observed' ELSE 'failed_behavior_or_conservative_gate' END AS why,
        CASE WHEN decision = 'eligible' THEN 'operator_review_before_replay_or_backtesting' WHEN cens THEN 'clean_uninterrupted_survivor_observation' WHEN reasons LIKE '%missing_asof%' OR reasons LIKE '%missing_horizon%' THEN 'more as-of-alpha-complete slices at required horizons'
            WHEN reasons LIKE '%candidate_checkpoint_absent%' THEN 'fresh survivor-extension collection under same caps' ELSE 'more clean survivor examples; do not loosen gates without evidence' END AS next_data FROM j""")
def p12_discovery(spark, sf_dir):
    rows = asof_rows(spark, sf_dir)
    scored = G.eligibility_v2_bins(rows.where("horizon_seconds = 60"), ["leaked_outcome"])
    last = scored.groupBy("mint").agg(F.max_by(F.struct("decision", "reasons", "label_censored"), "k").alias("s")).select("mint", "s.*")
    return G.discovery(rows, last, ["mint"])


#: Decisions of a token (customer) over its orders, and what became of it.
_DECIDED = """d AS (SELECT o_custkey AS mint, o_orderkey AS at, ['WatchLight', 'WatchDeep', 'EnterPaper', 'StopTracking', 'Observe', 'StopTracking', 'StopTracking', 'WatchLight'][o_orderkey % 8 + 1] AS decision_type, ['HolderGrowthContinuation', 'SellAbsorptionBounce', 'Momentum', 'Rotation', ''][(o_orderkey + o_custkey) % 5 + 1] AS strategy,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 - 10 END AS edge, list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'LiveDisabled' END, CASE WHEN o_orderkey % 7 < 2 THEN 'TopHolderDump' END, CASE WHEN o_orderkey % 11 < 4 THEN 'NoBuyGap' END, CASE WHEN o_orderkey % 13 < 3 THEN 'HighFakeMomentumRisk' END,
            CASE WHEN o_orderkey % 17 < 3 THEN 'DataGapActive' END, CASE WHEN o_orderkey % 19 < 2 THEN 'DevSoldEarly' END, CASE WHEN o_orderkey % 23 = 0 THEN 'OtherReason' END], lambda x: x IS NOT NULL) AS reasons FROM orders),
    l AS (SELECT c_custkey AS mint, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE (c_custkey * 7) % 60 - 5 END AS mfe, -((c_custkey * 11) % 80) AS mae, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 0.8 END AS confidence, c_custkey % 9 <> 1 AS has_price FROM customer)"""


def _decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    reasons = G.codes({"LiveDisabled": k % 5 == 0, "TopHolderDump": k % 7 < 2, "NoBuyGap": k % 11 < 4, "HighFakeMomentumRisk": k % 13 < 3, "DataGapActive": k % 17 < 3, "DevSoldEarly": k % 19 < 2, "OtherReason": k % 23 == 0})
    types = ["WatchLight", "WatchDeep", "EnterPaper", "StopTracking", "Observe", "StopTracking", "StopTracking", "WatchLight"]
    strategies = ["HolderGrowthContinuation", "SellAbsorptionBounce", "Momentum", "Rotation", ""]
    return o.select(F.col("o_custkey").alias("mint"), k.alias("at"), pick(types, k % 8).alias("decision_type"), pick(strategies, (k + F.col("o_custkey")) % 5).alias("strategy"), F.when(k % 3 != 0, k % 50 - 10).cast("double").alias("edge"), reasons.alias("reasons"))


def _outcomes(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as mint", "cast(if(c_custkey % 6 = 0, null, (c_custkey * 7) % 60 - 5) as double) as mfe", "cast(-((c_custkey * 11) % 80) as double) as mae", "if(c_custkey % 5 = 0, 0.0, 0.8) as confidence", "c_custkey % 9 <> 1 as has_price")


_B = G.BLOCKERS
_FUNNEL = f"""{_DECIDED}, g AS (SELECT mint, {', '.join(f"count(*) FILTER (list_contains(reasons, '{b}')) AS {b}" for b in _B)}, max(CASE decision_type WHEN 'EnterPaper' THEN 4 WHEN 'WatchDeep' THEN 3 WHEN 'WatchLight' THEN 2 WHEN 'StopTracking' THEN 1 ELSE 0 END) AS h, arg_max(decision_type, d."at") AS final_decision, string_agg(DISTINCT strategy, '|' ORDER BY strategy) AS strategies, max(edge) AS edge FROM d GROUP BY mint),
    y AS (SELECT g.*, mfe, mae, NOT coalesce(confidence > 0, false) AS missing_label, NOT coalesce(has_price, false) AS missing_price, greatest({', '.join(_B)}) AS most FROM g LEFT JOIN l USING (mint)),
    t AS (SELECT *, ['Observed', 'StopTracking', 'WatchLight', 'WatchDeep', 'EnterPaper'][h + 1] AS highest, CASE {' '.join(f"WHEN {b} = most THEN '{b}'" for b in _B)} END AS top_blocker,
        CASE WHEN missing_label THEN 'uncertain_due_to_missing_labels' WHEN mfe > 25 AND TopHolderDump > 0 THEN 'missed_winner_due_to_top_holder_filter' WHEN mfe > 25 AND NoBuyGap > 0 THEN 'missed_winner_due_to_no_buy_gap' WHEN mfe > 25 AND HighFakeMomentumRisk > 0 THEN 'missed_winner_due_to_fake_momentum_filter'
            WHEN mfe > 25 AND DataGapActive > 0 THEN 'missed_winner_due_to_data_gap' WHEN mfe > 25 THEN 'missed_winner_due_to_missing_label' WHEN coalesce(mfe, 0) < 2 THEN 'not_executable_after_fees' ELSE 'correctly_rejected_loser' END AS missed FROM y),
    u AS (SELECT *, NOT missing_label AND (coalesce(mfe, 0) < 2 OR coalesce(mae, 0) <= -50 OR top_blocker = 'DataGapActive') AS justified FROM t)"""


@query(f"WITH {_FUNNEL} SELECT mint, highest, strategies, final_decision, top_blocker, {', '.join(_B)}, edge, mfe, mae, missing_label, missing_price, missed, justified, CASE WHEN missing_label THEN 0.35 ELSE 0.75 END AS confidence FROM u")
def p13_token_funnel(spark, sf_dir):
    return G.token_funnel(_decisions(spark, sf_dir), _outcomes(spark, sf_dir))


@query(f"""WITH {_FUNNEL}, c AS (SELECT p_partkey AS mint, CASE WHEN p_size < 20 THEN NULL ELSE p_size - 5.0 END AS lm FROM part), e AS (SELECT c.mint, coalesce(lm, mfe) AS later_mfe, mae AS later_mae, coalesce(missing_label, false) AS ml, coalesce(missing_price, false) AS mp, coalesce(justified, false) AS ju, top_blocker FROM c LEFT JOIN u USING (mint))
    SELECT mint, later_mfe, later_mae, CASE WHEN later_mfe IS NOT NULL THEN greatest(later_mfe - 2.5, 0) ELSE 0 END AS opportunity, coalesce(later_mfe > 2.5, false) AND NOT ml AS executable, coalesce(top_blocker, 'unknown') AS gate_blocked, coalesce(top_blocker IN ('TopHolderDump', 'HighFakeMomentumRisk', 'DataGapActive'), false) AS admits_losers,
        CASE WHEN ml THEN 'label_insufficient' WHEN mp THEN 'price_coverage_insufficient' WHEN coalesce(later_mfe, 0) < 2 THEN 'not_executable_after_fees' WHEN ju THEN 'risk_justified_miss' WHEN later_mfe > 25 THEN 'actionable_missed_winner' ELSE 'uncertain' END AS classification FROM e""")
def p14_missed_winners(spark, sf_dir):
    funnel = G.token_funnel(_decisions(spark, sf_dir), _outcomes(spark, sf_dir))
    missed = table(spark, sf_dir, "part").selectExpr("p_partkey as mint", "cast(if(p_size < 20, null, p_size - 5) as double) as later_mfe")
    return G.enrich_missed(missed, funnel, "missed")


@query(f"""WITH {_DECIDED}, c AS (SELECT strategy, count(*) AS evaluated, count(*) FILTER (decision_type IN ('WatchLight', 'WatchDeep', 'EnterPaper')) AS candidates, count(*) FILTER (decision_type IN ('WatchDeep', 'EnterPaper')) AS near FROM d WHERE strategy NOT IN ('', 'HolderGrowthContinuation') GROUP BY 1),
    b AS (SELECT strategy, b, count(*) AS n FROM (SELECT strategy, unnest(reasons) AS b FROM d) GROUP BY 1, 2), t AS (SELECT strategy, string_agg(b || ':' || n, '|' ORDER BY n DESC, b) AS top_blockers FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY n DESC, b) <= 6) GROUP BY 1)
    SELECT strategy, evaluated, candidates, near, coalesce(top_blockers, '') AS top_blockers, CASE WHEN near > 0 THEN 'likely' ELSE 'possible' END AS threshold_blockers, CASE WHEN strategy = 'SellAbsorptionBounce' AND near > 0 THEN 'worth_offline_review' ELSE 'insufficient_evidence' END AS signal FROM c LEFT JOIN t USING (strategy)""")
def p15_inactive_strategies(spark, sf_dir):
    return G.inactive_strategies(_decisions(spark, sf_dir), "HolderGrowthContinuation")


@query(f"""WITH {_ROWS} SELECT 'terminal_inconclusive_labeled_dead' AS check, k AS mint FROM a WHERE final_outcome = 'terminal_inconclusive' AND clean_negative_label UNION ALL SELECT 'candidate_checkpoint_positive_without_replay', k FROM a WHERE candidate_checkpoint_seen AND clean_positive_label AND NOT replay_eligible
    UNION ALL SELECT 'provider_gap_clean_label', k FROM a WHERE provider_gap_exposed AND clean_negative_label""")
def q2_label_audit(spark, sf_dir):
    return G.label_audit(asof_rows(spark, sf_dir).withColumn("mint", F.col("k")))


@query("""WITH i AS (SELECT event_id AS mint, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events), e AS (SELECT *, CAST(floor(n * 0.6) AS BIGINT) AS a, CAST(floor(n * 0.8) AS BIGINT) AS z, least(25, greatest(1, n // 100)) AS g FROM i)
    SELECT mint, CASE WHEN i < a - g THEN 'train' WHEN i < z - g THEN 'validation' ELSE 'test' END AS split FROM e WHERE i < a - g OR (i >= a + g AND i < z - g) OR i >= z + g""")
def s2_two_sided_embargo(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("mint"), F.unix_micros(F.col("ts").cast("timestamp")).alias("first_us"))
    return L.walk_forward_two_sided(e)
