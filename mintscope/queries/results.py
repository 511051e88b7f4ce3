"""The columns that each query returns."""

RESULTS: dict[str, str] = {
    "a10_replay_order": "run_id string, event_id bigint, place int",
    "a11_replay_filter": "event_id bigint, event_type string",
    "a12_latest_runs": "run_id string, record_id bigint, is_root boolean, wall bigint",
    "a13_run_statistics": "run_id bigint, events bigint, first_us bigint, last_us bigint, fills bigint, pnl double",
    "a14_run_kinds": "record_id bigint, kind string, role string",
    "a15_latest_id": "run_id string",
    "a16_a22_mart_cut": "horizon int, rows bigint, mints bigint, mean_quantity double, labels bigint",
    "a17_a24_merge_quality": "k bigint, verified boolean, counted boolean, ledgers bigint, uniform boolean",
    "a18_slice_inclusion": "k bigint, reason string, included boolean",
    "a19_segment_integrity": "segment bigint, expected bigint, rows bigint, corrupt bigint, status string",
    "a1_event_log": "event_id string, kind string, slot bigint, run_id string, scenario_id string",
    "a20_coverage": "run_id bigint, segments bigint, verified bigint, counted bigint, empty bigint, attempted bigint, bytes double, last_segment bigint",
    "a21_slice_classes": "k bigint, blockers string, class string, collected string",
    "a23_raw_frames": "k bigint, class string, usable boolean",
    "a2_filtered_log": "event_id string, mint string, quote double",
    "a3_tolerant_log": "scenario_id string, good bigint, bad bigint",
    "a4_csv_table": "p_partkey bigint, p_name string, p_size int",
    "a5_append_log": "status string, rows bigint, price double",
    "a6_snapshot_chunks": "status string, rows bigint, in_bounds boolean, named boolean",
    "a7_long_features": "mint bigint, feature string, num double, txt string, flag boolean, status string",
    "a8_export_decisions": "record_id bigint, run_id string, kind string, low double, reason_codes string",
    "a9_export_fills": "l_orderkey bigint, l_linenumber int, fill_id string, position_id string, fill_us bigint, l_partkey bigint",
    "a_mart_counts": "horizon int, rows bigint, mints bigint",
    "a_slices_by_checks": "o_orderkey bigint, reason string, included boolean, class string",
    "b10_b11_shapes_and_tags": "o_orderkey bigint, shape string, tag string",
    "b12_enriched_curve": "p_partkey bigint, price_source string, price double, progress double, market_cap double, price_confidence double",
    "class_volume_top5": "class string, user_id bigint, updates bigint, place int",
    "b15_noisy_keys": "user_id bigint, degraded_us bigint, reason string",
    "b16_coalesced": "user_id bigint, event_id bigint, us bigint",
    "b18_retained": "event_id bigint, user_id bigint",
    "b19_gap_intervals": "scope string, key bigint, start_us bigint, stop_us bigint",
    "b1_transaction_dedup": "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double",
    "b20_trade_allowed": "event_id bigint, allowed boolean",
    "b21_source_health": "kind string, source bigint, events bigint, last_us bigint",
    "b22_request_ledger": "allowed bigint, denied bigint, network_calls bigint",
    "b23_without_reverted": "event_id bigint",
    "b24_corrected": "user_id bigint, status string, tentative_only boolean",
    "b25_lookahead_violations": "o_custkey bigint, o_orderkey bigint, us bigint, before_us bigint",
    "b26_resolved_updates": "event_id bigint, mint bigint, released_us bigint",
    "b27_b28_b29_trade_amounts": "event_id bigint, tokens bigint, quote bigint, fee_observed bigint, fee_modelled bigint, first_buy boolean",
    "b2_newest_versions": "event_id bigint, user_id bigint, k bigint",
    "b3_slot_gaps": "event_type string, start_slot bigint, end_slot bigint, severity string",
    "b4_sequence_gaps": "user_id bigint, expected int, got int",
    "b4_sequence_verdicts": "user_id bigint, frames bigint, passed bigint, first_failure bigint",
    "b5_payload_hash": "event_id bigint, intact boolean",
    "b6_holder_update_dedup": "seen bigint, applied bigint, deduped bigint",
    "b7_balance_changes": "l_partkey bigint, l_suppkey bigint, old double, new double, delta double",
    "b8_transfer_edges": "signature bigint, funder bigint, wallet bigint, amount bigint",
    "b9_owner_delta": "l_orderkey bigint, delta bigint",
    "c10_c24_texts": "event_id bigint, hour int, weekday int, truthy boolean, level bigint, key string, slug string, reasons string",
    "c13_client_fingerprints": "event_id bigint, fingerprint string",
    "c17_timestamps": "o_orderkey bigint, us bigint",
    "c20_first_gate": "o_orderkey bigint, gate string",
    "c21_row_hash": "o_orderkey bigint, row_hash string",
    "c22_mint_lists": "o_orderkey bigint, mints string, n int",
    "c7_c9_c14_c15_numbers": "o_orderkey bigint, share01 double, impact double, exit_impact double, bucket int, label string, mean double",
    "rug_measures": "mint bigint, dev_sold boolean, half_from_high boolean, no_buys boolean, sells_lead boolean, rug_probability double, rug_confidence double",
    "f10_rug_columns": "mint bigint, dev_sold_flag boolean, dev_sold_pct double, price_drop_50pct_from_ath boolean, price_drop_70pct_from_launch_within_5m boolean, holder_growth_stalled boolean, sells_dominate_after_launch boolean, no_buys_for_x_seconds boolean, rug_probability_score double, rug_confidence double",
    "cohort_measures": "mint bigint, cohort bigint, active bigint, attention double, distance_to_best double, leader boolean",
    "f11_cohort_columns": "mint bigint, cohort_launch_count bigint, cohort_active_count bigint, cohort_discard_rate double, cohort_rug_rate double, token_rank_by_buy_volume_30s bigint, token_rank_by_net_flow_30s bigint, token_rank_by_holder_growth_30s bigint, token_rank_by_price_return_30s bigint, token_relative_strength_score double, token_relative_weakness_score double, cohort_attention_share double, best_launch_in_cohort_distance double, this_token_share_of_all_launch_buy_volume double, this_token_share_of_all_unique_buyers double, token_percentile_buy_volume_30s double, token_percentile_net_flow_30s double, token_percentile_holder_growth_1m double, token_percentile_price_return_1m double, token_is_cohort_leader_flag boolean, token_is_cohort_laggard_flag boolean, token_improving_rank_velocity double, token_losing_rank_velocity double",
    "f12_rotation_columns": "mint bigint, wallets_sold_other_token_then_bought_this_count bigint, net_capital_rotated_into_this_from_other_launches double, smart_capital_rotation_score double, this_token_becoming_primary_capital_destination_flag boolean",
    "cost_basis_measures": "mint bigint, mean_unrealised double, profit_supply double, underwater_supply double, free_roll_supply double, initials_out bigint, full_exits bigint",
    "f13_cost_columns": "mint bigint, holder_unrealized_pnl_mean double, holder_unrealized_pnl_median double, holder_unrealized_pnl_p90 double, unrealized_profit_supply_pct double, underwater_supply_pct double, breakeven_supply_pct double, free_rolling_supply_pct double, top5_unrealized_pnl double, top10_unrealized_pnl double, realized_profit_taking_rate double, profit_overhang_score double, underwater_capitulation_risk double, free_roll_dump_risk_score double, holders_taking_initials_out_count bigint, holders_fully_exiting_count bigint",
    "survival_measures": "mint bigint, large_sells bigint, buyers_after bigint, recovery_ms double, recovery double, absorption_score double, absorbed boolean",
    "holder_lifecycle_measures": "mint bigint, age_us bigint, retention_10 double, retention_20 double, half_life_s double",
    "f15_lifecycle_columns": "mint bigint, holder_age_mean double, holder_age_median double, holder_age_weighted_by_balance double, new_holder_survival_30s double, new_holder_survival_1m double, first_10_buyers_retention double, first_20_buyers_retention double, average_time_to_first_sell_by_holder double, holder_half_life double, holder_decay_rate double, holder_stickiness_score double, holder_paper_hands_score double, healthy_churn_score double, unhealthy_churn_score double, new_holders_replacing_old_holders_score double",
    "fingerprints_and_fees": "mint bigint, dominant_share double, diversity double, fee_median double, fee_p90 double, fee_spike boolean, war_score double",
    "f16_fingerprint_columns": "mint bigint, tx_account_count double, tx_instruction_count double, tx_inner_instruction_count double, compute_budget_instruction_present boolean, compute_unit_limit double, compute_unit_limit_bucket int, compute_unit_price double, compute_unit_price_bucket int, duplicate_compute_profile_count bigint, duplicate_compute_profile_among_first_buyers bigint, duplicate_instruction_sequence_count bigint, duplicate_account_pattern_count bigint, identical_client_fingerprint_score double, first_buyers_same_client_fingerprint_pct double, top_holders_same_client_fingerprint_pct double, bot_family_dominance_score double, bot_family_diversity_score double",
    "f17_funding_columns": "mint bigint, creator_recent_funder bigint, funder_to_creator_edge_age bigint, buyer_recent_funder_overlap_count bigint, first_buyers_same_funder_pct double, top_holders_same_funder_pct double, funder_to_buyer_edge_age bigint, funder_to_multiple_launches_count bigint, same_funder_same_amount_pattern double, funding_burst_before_launch bigint, wallets_funded_just_before_buy_count bigint, fresh_wallets_funded_by_known_factory bigint, funding_graph_density double, funding_graph_suspicion_score double, funding_graph_quality_score double",
    "funding_profile": "funder bigint, wallets bigint, amount double, mean_amount double, density double, burst boolean, multi_launch bigint",
    "f18_fee_columns": "mint bigint, launch_priority_fee_median double, launch_priority_fee_p90 double, pump_buy_priority_fee_median double, pump_sell_priority_fee_median double, first_buyers_priority_fee_median double, priority_fee_spike_near_launch boolean, our_required_priority_fee_estimate double, fee_war_score double, minimum_move_to_cover_observed_fees double, edge_minus_fee_war_cost double, high_fee_low_edge_warning boolean",
    "f19_execution_columns": "mint bigint, first_seen_by_shred_ns bigint, shred_lead_time_ms double, token_signal_available_before_geyser_flag boolean, slot_id bigint, competition_intensity_score double, counterfactual_buy_after_100ms_pnl double, latency_adjusted_trade_eligibility double",
    "f19_f20_f22_f23_snapshot": "mint bigint, available int, unavailable int, feature_hash string, critical_missing int, completeness double, quality double, trade_allowed boolean, wallet_vector_similarity double, launch_factory_id double, event_grammar_class double, path_similarity_score double, hazard_rate double, anomaly_score double",
    "f1_launch_columns": "mint bigint, launch_slot bigint, quote_mint string, creator_wallet string, payer_wallet string, bonding_curve_pubkey string, associated_bonding_curve_pubkey string, metadata_pubkey string, create_instruction_variant string, launch_same_tx_buy_count int, launch_same_slot_buy_count int, launch_tx_client_fingerprint string, time_since_launch_ms bigint, quote_asset_type string, token_program_type string, first_seen_source string, name_length int, symbol_length int, uri_length int, has_empty_name boolean, has_empty_symbol boolean, has_empty_uri boolean, name_entropy double, symbol_entropy double, uri_entropy double, duplicate_name_seen_historically bigint, duplicate_symbol_seen_historically bigint, duplicate_uri_seen_historically bigint, suspicious_unicode_score double, uri_scheme string",
    "launch_texts": "mint bigint, name_length int, has_empty_name boolean, duplicate_name_seen bigint, name_entropy double, duplicate_symbol_seen bigint, duplicate_uri_seen bigint, uri_scheme string, uri_host string, suspicious_unicode_score double",
    "f20_data_quality_columns": "mint bigint, geyser_connected_flag boolean, shred_connected_flag boolean, source_disagreement_flag boolean, critical_feature_missing_count bigint, feature_completeness_pct double, data_quality_score double, trade_allowed_data_quality_flag boolean",
    "defence_levels": "mint bigint, wallet bigint, seq bigint, class string, confidence double, impact double, level string, armed boolean, triggered boolean",
    "f23_placeholders": "mint bigint, feature string, status string",
    "f24_registry": "feature string, kind string, category string, available bigint, missing bigint",
    "c6_metric_rows": "mint bigint, metric string, value double, confidence string",
    "creator_launches": "mint bigint, launches_seen bigint, launches_recent bigint, spam_wave boolean, age_us bigint",
    "f2_creator_columns": "mint bigint, creator_age_in_local_index bigint, creator_total_launches_seen bigint, creator_launches_last_1h bigint, creator_cluster_id string, creator_reuses_same_payer boolean, creator_reuses_same_metadata_domain boolean, creator_launching_spam_wave_flag boolean",
    "developer_measures": "mint bigint, net_tokens double, net_quote double, sold_share double, has_sold boolean, first_sell_ms double, dev_balance double, ownership double, balance_rank int, is_top1 boolean, is_top3 boolean, is_top5 boolean, is_top10 boolean",
    "f3_developer_columns": "mint bigint, creator_initial_token_balance double, dev_balance double, creator_retained_supply_pct double, dev_holding_pct_total_supply double, dev_holding_pct_curve_economic_supply double, dev_holding_pct_circulating double, creator_ownership_pct double, token_supply_selected_for_holder_pct string, creator_net_tokens_after_10s double, creator_net_tokens_after_30s double, creator_net_tokens_after_1m double, creator_net_tokens_after_5m double, creator_net_quote_flow_after_10s double, creator_net_quote_flow_after_30s double, creator_net_quote_flow_after_1m double, creator_net_quote_flow_after_5m double, creator_has_sold boolean, creator_first_sell_time_ms bigint, creator_dump_velocity double, creator_balance_rank bigint, creator_is_top1_holder boolean, creator_is_top3_holder boolean, creator_is_top5_holder boolean, creator_is_top10_holder boolean",
    "c1_c5_curve": "mint bigint, price double, market_cap double, progress double, depth double, fill_ratio double",
    "f4_curve_columns": "mint bigint, virtual_quote_reserves double, virtual_token_reserves double, real_quote_reserves double, real_token_reserves double, token_decimals int, price_lamports_per_raw_token double, price_sol_per_token double, reserve_price_confidence double, price_current double, price_launch double, price_change_from_launch_pct double, market_cap_quote_1b double, market_cap_quote_total_supply double, token_supply_curve_economic_ui double, token_supply_protocol_constant_ui double, token_supply_selected_for_market_cap string, token_supply_selected_for_curve_progress string, supply_denominator_policy_version string, market_cap_confidence double, curve_complete_flag boolean, curve_progress_pct double, curve_completion_pct double, curve_progress_confidence double, curve_staleness_ms bigint, quote_asset_specific_depth_score double, quote_asset_specific_curve_health double",
    "trade_flow_measures": "mint bigint, buy_median double, buy_p90 double, sell_median double, sell_p90 double, first10_buy_ratio double, count_ratio double, volume_ratio double, breadth double",
    "f5_price_columns": "mint bigint, price_high double, price_low double, drawdown_from_ath_pct double, drawdown_from_launch_pct double, return_pct_30s double, return_pct_1m double, return_pct_5m double, realized_volatility_30s double, realized_volatility_1m double, price_velocity_30s double, time_to_ath_ms bigint, time_below_launch_price_pct double, new_ath_frequency bigint, post_ath_selloff_velocity double",
    "f6_flow_columns": "mint bigint, buy_count bigint, sell_count bigint, trade_count bigint, unique_buyers bigint, unique_sellers bigint, buy_volume_quote double, sell_volume_quote double, net_flow_quote double, buy_sell_count_ratio double, buy_sell_volume_ratio double, largest_buy_quote double, largest_sell_quote double, median_buy_size_quote double, median_sell_size_quote double, p90_buy_size_quote double, p90_sell_size_quote double, first_10_trades_buy_ratio double, no_buy_gap_longest_ms bigint, organic_flow_score double, toxic_flow_score double",
    "f7_f8_holder_columns": "mint bigint, holder_count_current bigint, holders_with_nonzero_balance bigint, holder_count_owner_wallets bigint, holder_updates_seen int, holder_updates_applied int, holder_updates_deduped int, holder_owner_changes int, holder_missing_owner_mapping int, holder_fallback_trade_updates_used int, holder_count_excluding_curve bigint, holder_count_excluding_curve_and_dev bigint, observed_holder_supply double, circulating_holder_supply double, holder_growth_rate double, sustained_holder_growth_score double, average_holder_balance double, median_holder_balance double, p90_holder_balance double, holder_balance_gini double, holder_balance_hhi double, top1_holder_pct double, top1_holder_pct_observed double, top1_holder_pct_total_supply double, top1_holder_pct_curve_economic_supply double, top1_holder_pct_circulating double, token_supply_selected_for_holder_pct string, top3_holder_pct double, top5_holder_pct double, top10_holder_pct double, top20_holder_pct double, holder_metric_confidence double, missing_owner_mapping_count int, holder_distribution_improvement_score double, whale_count bigint, whale_holding_pct double, top1_is_creator boolean, concentration_risk_score double, one_wallet_controls_market_flag boolean",
    "holder_measures": "mint bigint, holders bigint, mean_balance double, median_balance double, p90_balance double, whales bigint, whale_share double, top1_is_creator boolean, concentration_risk double, confidence double",
    "f9_bundle": "mint bigint, first_buyers bigint, same_slot bigint, identical_amounts bigint, pairs bigint, top_share double, bundle_risk double, bundle_confidence double",
    "g1_funding_edges": "funder bigint, wallet bigint, amount double, last_us bigint, transfers bigint",
    "g2_clusters": "wallet string, cluster string, members int",
    "g3_evidence": "wallet bigint, evidence double",
    "g4_related": "wallet bigint",
    "j11_k6_pair_fills": "position bigint, entry_us bigint, exit_us bigint, entry_quote double, exit_quote double, pnl double, status string",
    "j12_fallback": "o_custkey bigint, o_orderpriority string, o_orderkey bigint",
    "j13_j16_merge_sources": "k bigint, name string, flag boolean, sources string",
    "j14_rotation": "mint bigint, rotated_wallets bigint, rotated_notional double",
    "j15_j17_best_per_key": "o_custkey bigint, price double, o_orderkey bigint",
    "j1_j4_j10_left_joins": "l_orderkey bigint, l_linenumber int, l_suppkey bigint, shape string, known boolean",
    "j5_t8_reconcile": "key bigint, outcome string, lag_us bigint",
    "j6_t7_first_resolution": "id bigint, mint bigint, us bigint, resolution string, latency_us bigint",
    "j7_duplicate_intents": "id bigint, original bigint",
    "j8_j9_same_funder_pairs": "mint bigint, pairs bigint, funders bigint",
    "j_asof_last_order": "l_orderkey bigint, l_linenumber int, us bigint, o_custkey bigint, price double",
    "k1_k2_orders": "k bigint, impact double, fill_price double, notional double, filled double, creator_fee double, protocol_fee double, failed_fee double, total_fee double",
    "k3_k4_backtest": "trades bigint, total_pnl double, net_pnl double, fee_drag double, slippage_drag double, hit_rate double",
    "k5_k7_mark_to_market": "position bigint, mint bigint, tokens double, price double, value double, pnl double",
    "k5_token_labels": "mint bigint, oracle_pnl double, realistic_pnl double, scalpable boolean, rug boolean, profitable boolean",
    "l1_mint_labels": "slice_id bigint, segment_id bigint, mint string, final_outcome string, final_outcome_reason string, rejection_reason string, terminal_inconclusive_reason string, time_to_rejection_ms bigint, time_to_terminal_ms bigint, provider_gap_exposed boolean, relay_gap_exposed boolean, sequence_gap_exposed boolean, hash_mismatch_exposed boolean, receiver_backpressure_exposed boolean, candidate_checkpoint_seen boolean, replay_eligible boolean, clean_negative_label boolean, clean_positive_label boolean, censored_label boolean, label_quality string",
    "l2_asof_features": "mint bigint, horizon int, asof_us bigint, reached boolean, buys bigint, sells bigint, volume double, net_flow double, wallets bigint",
    "l4_merge_alpha": "k bigint, asof_alpha_feature_available boolean, asof_alpha_trade_delta_available boolean, asof_alpha_holder_state_available boolean, asof_alpha_vault_curve_available boolean, tracked_at_least_horizon boolean, provider_gap_exposed boolean, relay_gap_exposed boolean, sequence_gap_exposed boolean, hash_mismatch_exposed boolean, receiver_backpressure_exposed boolean",
    "l5_positive_outcomes": "mint bigint, horizon int, strength string",
    "l6_validation_rows": "mint bigint, horizon int, favourable double, adverse double, time_to_peak int, could_exit boolean",
    "l7_validation_features": "k bigint, curve double, note string, horizon_reached boolean, data_complete_for_horizon boolean",
    "l8_best_label": "mint bigint, strength string, horizons bigint, first_horizon int, last_horizon int, class string",
    "p10_replay_blockers": "k bigint, blocker string, root_cause string, action string",
    "p11_continue_gap": "k bigint, first_failed_gate string, gap string",
    "p12_discovery": "mint bigint, horizons_reached string, decision string, top_reasons string, why string, next_data string",
    "p13_funnel_stages": "stage string, mints bigint, step_ratio double",
    "p13_token_funnel": "mint bigint, highest string, strategies string, final_decision string, top_blocker string, LiveDisabled bigint, TopHolderDump bigint, NoBuyGap bigint, HighFakeMomentumRisk bigint, DataGapActive bigint, DevSoldEarly bigint, edge double, mfe double, mae double, missing_label boolean, missing_price boolean, missed string, justified boolean, confidence double",
    "p14_missed_winners": "mint bigint, later_mfe double, later_mae double, opportunity double, executable boolean, gate_blocked string, admits_losers boolean, classification string",
    "p15_inactive_strategies": "strategy string, evaluated bigint, candidates bigint, near bigint, top_blockers string, threshold_blockers string, signal string",
    "p16_ablation": "blocker string, blocked bigint, recovered_winners bigint, admitted_losers bigint",
    "p17_feature_complete_cohort": "k bigint, reason string, cohort string",
    "p18_survivor_diagnostics": "mint bigint, slice_id bigint, observed_seconds bigint, horizons_reached string, candidate_gates_passed string, first_failed_candidate_gate string, censored boolean, data_quality_excluded boolean, missing_asof_features boolean, decision string",
    "p1_early_avoid_bins": "k bigint, decision string, reasons string",
    "p1_early_avoid_v0": "k bigint, decision string, reasons string, score string",
    "p1_early_avoid_v1": "k bigint, decision string, reasons string",
    "p2_continue_bins": "k bigint, decision string, reasons string",
    "p2_continue_v0": "k bigint, decision string, reasons string",
    "p2_continue_v1": "k bigint, decision string, reasons string",
    "p3_eligibility_v0": "k bigint, decision string, reasons string",
    "p3_eligibility_v1": "k bigint, decision string, reasons string, first_failed_gate string",
    "p3_eligibility_v2_bins": "k bigint, decision string, reasons string, score string",
    "p3_eligibility_v2_gates": "k bigint, decision string, reasons string, confidence string",
    "p4_alpha_bins": "k bigint, trade_delta_bin string, buy_followthrough_bin string, sell_pressure_bin string, holder_growth_bin string, holder_risk_bin string, vault_curve_progress_bin string, liquidity_risk_bin string",
    "p5_early_burst_v0": "k bigint, decision string, reasons string, confidence string",
    "p6_promotion_priority": "k bigint, decision string, reasons string, confidence string",
    "p7_early_burst_in_out_v0": "k bigint, decision string, reasons string, prefilter string, top_blocker string, curve_progress_bin string, buy_sell_followthrough_bin string, volume_followthrough_bin string, holder_growth_bin string, sell_pressure_bin string, holder_dev_risk_bin string, liquidity_risk_bin string",
    "p8_survivor_runner": "k bigint, decision string, reasons string, prefilter string, top_blocker string, survival_horizon_bin string, holder_growth_bin string, holder_stability_bin string, curve_progress_bin string, sell_pressure_bin string, liquidity_risk_bin string, holder_dev_risk_bin string",
    "p9_early_burst_in_out_v1": "k bigint, v1_decision string, v1_reasons string, v1_top_blocker string, guard_decision string, guard_reasons string, replay_blocker string",
    "p_complete_horizons": "mint bigint, complete_horizons bigint, reached int, status string",
    "q1_q3_leakage_audit": "check string, key string",
    "q2_label_audit": "check string, mint bigint",
    "r10_composites": "mint bigint, momentum_raw double, momentum double, momentum_confidence double, holder_quality_raw double, holder_quality double, holder_quality_confidence double, fee_adjusted_edge_raw double, fee_adjusted_edge double, fee_adjusted_edge_confidence double, liquidity_raw double, liquidity double, liquidity_confidence double, latency_raw double, latency double, latency_confidence double, relative_strength_raw double, relative_strength double, relative_strength_confidence double, stickiness_raw double, stickiness double, stickiness_confidence double, absorption_raw double, absorption double, absorption_confidence double, rotation_raw double, rotation double, rotation_confidence double, overhang_raw double, overhang double, overhang_confidence double, authenticity_raw double, authenticity double, authenticity_confidence double, anti_rug_raw double, anti_rug double, anti_rug_confidence double, eligibility_raw double, eligibility double, eligibility_confidence double",
    "r11_strategies": "mint bigint, strategy string",
    "r12_expected_edge": "mint bigint, strategy string, expected_move double, fee_drag double, slippage_drag double, impact_drag double, latency_drag double, required_move double, net_edge_quote double, net_edge_pct double, edge_confidence double, edge_reasons string",
    "r13_position_sizes": "mint bigint, size double",
    "r14_entry_decisions": "mint bigint, strategy string, decision string, blocked_by string, decision_reasons string",
    "r15_exit_decisions": "mint bigint, strategy string, gain double, exit_by string, decision string",
    "r15_exits": "position bigint, mint bigint, rule string, exit_us bigint, exit_price double",
    "r16_early_rules": "mint bigint, rule string, pre_entry_safe boolean, outcome string",
    "r16_table_rules": "mint bigint, rule string, outcome string",
    "r17_rug_outcomes": "mint bigint, horizon int, drawdown double, buys bigint, collapsed_80 boolean, collapsed_95 boolean, no_buy_followthrough boolean, volume_evaporated boolean, holder_collapse boolean",
    "r1_rug_risk": "mint bigint, score double, confidence double, severity string, reasons string, missing_penalty double, action string",
    "r2_bundle_risk": "mint bigint, score double, confidence double, severity string, reasons string, missing_penalty double, action string",
    "r3_dev_risk": "mint bigint, score double, confidence double, severity string, reasons string, missing_penalty double, action string",
    "r4_top_holder_risk": "mint bigint, score double, confidence double, severity string, reasons string, missing_penalty double, action string",
    "r5_fake_momentum_risk": "mint bigint, score double, confidence double, severity string, reasons string, missing_penalty double, action string",
    "r6_data_quality_risk": "mint bigint, score double, confidence double, severity string, reasons string, missing_penalty double, action string",
    "r7_assessment": "mint bigint, rug double, bundle double, dev double, top_holder double, fake_momentum double, data_quality double, overall double, overall_confidence double, severity string, policy string, reasons string",
    "r8_diagnostic_risk": "mint bigint, total double, stream_only double, enrichment double, confidence double, evidence_count int, classification string, unavailable string, pre_entry_safe string, blocking string, supply_status string",
    "r9_time_role_leaks": "mint bigint, risk_id string, role string",
    "r_evidence_families": "mint bigint, available int, unavailable string, total double, classification string",
    "s1_walk_forward": "mint bigint, split string",
    "s2_two_sided_embargo": "mint bigint, split string",
    "s3_readiness": "positive bigint, negative bigint, mints bigint, completeness double, blockers string, decision string",
    "s4_freeze": "dataset string, rows bigint, content_hash string",
    "t10_threshold_step": "samples bigint, false_rate double, missed_rate double, threshold double",
    "t11_invariants": "mint bigint, wallet bigint, violation string",
    "t1_positions": "mint bigint, wallet bigint, held double, cost double, realised double, bought double, sold double, average_entry double, taken_profit boolean, round_trip boolean, price double, unrealised double",
    "t2_owner_balances": "mint bigint, owner bigint, balance double, accounts bigint",
    "t3_behaviour": "mint bigint, wallet bigint, sold_share double, status string",
    "t4_w9_holder_churn": "mint bigint, entries bigint, exits bigint, net bigint, stickiness double",
    "t5_exit_threats": "mint bigint, wallet bigint, place int, share double, class string, free_roll boolean, impact_25 double, impact_50 double, impact_100 double",
    "t9_calibration": "source string, samples bigint, true_positive bigint, false_positive bigint, missed bigint, mean_latency_us double, precision double, recall double",
    "u10_wallet_summary": "wallet bigint, first_us bigint, last_us bigint, mints bigint, bought double, sold double",
    "u11_creator_state": "mint bigint, wallet bigint, net_tokens double, net_quote double, first_sell_us bigint, sold_share double",
    "u12_compact_tokens": "mint bigint, lifecycle string, latest_price double, holder_count bigint, top1_holder_pct double, creator_sold_pct double, canonical_trade_count bigint, reason_codes string",
    "u13_top_mints": "mint bigint, buy_volume double, buys bigint",
    "u14_reason_histogram": "code string, count bigint",
    "u15_strategy_attribution": "strategy string, fills bigint, wins bigint, net_pnl double, best double, status_O bigint, status_F bigint, status_P bigint",
    "u16_edge_calibration": "expected double, realised double, gap double, entered bigint, watched bigint",
    "u17_label_counts": "total bigint, unique_mints bigint, clean_negative bigint, censored bigint, clean_positive bigint, candidate_checkpoint bigint, replay_eligible bigint, forward_window_observed bigint, positive bigint, high_positive bigint, positive_or_high bigint, positive_or_high_strength bigint, positive_not_candidates bigint, strong_censored_or_invalid bigint, replay_eligible_positive bigint",
    "u18_top_reasons": "l_linestatus string, code string, count bigint, place int",
    "u19_track_metrics": "rows_scored bigint, unique_mints bigint, review_candidates bigint, review_mints bigint, positive_high_captured bigint, high_captured bigint, dead_rejected bigint, excluded bigint, candidate_checkpoints bigint, replay_eligible bigint",
    "u1_trade_stats": "mint bigint, buys bigint, sells bigint, buy_volume double, sell_volume double, unique_buyers bigint, unique_sellers bigint, ath double, atl double, latest_price double, first_price double, last_buy_us bigint, last_sell_us bigint, first_large_sell_us bigint",
    "u20_cohort_rates": "cohort string, rows bigint, hit_rate double, done_rate double",
    "u21_cohort_comparison": "cohort string, rows bigint, unique_mints bigint, rejected string, throughput string, never string, outcome string",
    "u22_exit_windows": "metric string, value bigint",
    "u23_u24_missingness": "horizon string, feature_group string, rows bigint, present_ratio double, complete bigint",
    "u25_gate_funnel": "metric string, value bigint",
    "u26_root_causes": "rows bigint, positive_or_high_rows bigint, high_positive_rows bigint, candidate_checkpoint_rows bigint, replay_eligible_rows bigint, promoted_rows bigint, clean_blocked_rows bigint, collection_rows bigint, mismatch_rows bigint, collection_primary boolean, strictness_primary boolean, separate_type_needed boolean",
    "u28_policy_comparison": "shadow_rows bigint, shadow_mints bigint, high_positive_rows bigint, high_positive_promoted bigint, high_positive_mints bigint, dead_promoted bigint, admitted_would_reject bigint, blocked_would_promote bigint, rejected_later_positive bigint, promoted_later_positive bigint, promoted_later_high bigint, captures_all boolean",
    "u29_source_metrics": "source string, events bigint, users bigint, duplicates bigint",
    "u2_percentiles": "mint bigint, p50 double, p90 double",
    "u3_u4_u5_concentration": "mint bigint, holders bigint, supply double, gini double, hhi double, top1_pct double, top3_pct double, top5_pct double, top10_pct double, top20_pct double",
    "u6_u7_top_share_without_owners": "mint bigint, holders bigint, top_pct double",
    "u8_dominant_share": "mint bigint, max_group bigint, dominant_share double, groups bigint",
    "u9_identical_amounts": "mint bigint, identical_amounts bigint",
    "u_long_summary": "metric string, value double",
    "w10_first_buyers": "mint bigint, wallet bigint, place int, us bigint, quote double",
    "w11_holding_times": "mint bigint, wallets bigint, mean_seconds double, max_seconds double",
    "w12_retention": "mint bigint, retention double",
    "w13_w14_j3_cohort_ranks": "mint bigint, cohort bigint, rank bigint, percentile double",
    "w15_rank_velocity": "mint bigint, early_rank bigint, late_rank bigint, rank_velocity bigint",
    "w16_absorption": "mint bigint, buys_after bigint, volume_after double, buyers_after bigint, recovery_us bigint, recovery double",
    "w17_forward_extremes": "mint bigint, max_return_86400s double, max_drawdown_86400s double, max_return_604800s double, max_drawdown_604800s double, up20_us bigint, down50_us bigint",
    "w18_trailing_mean": "mint bigint, seq bigint, trailing_mean double",
    "w19_lifecycle": "mint bigint, us bigint, seq bigint, was string, state string, n bigint, holders bigint, buyers bigint, expires_us bigint",
    "w1_bounded_history": "mint bigint, wallet bigint, side string, seq bigint, place int",
    "w20_expiries": "mint bigint, us bigint, seq bigint, state string, expires_us bigint, next_us bigint",
    "w21_j2_horizon_peaks": "mint bigint, horizon bigint, peak double, peak_horizon bigint, time_to_peak bigint",
    "w22_first_per_mint": "mint bigint, us bigint, seq bigint",
    "w23_excursions": "mint bigint, seq bigint, best double, worst double",
    "w2_w4_window_returns": "mint bigint, seq bigint, return_43200s double, velocity_43200s double, return_172800s double, velocity_172800s double",
    "w3_mean_absolute_return": "mint bigint, at bigint, volatility double",
    "w5_w6_w7_price_path": "mint bigint, ath_us bigint, new_highs bigint, max_drawdown double, end_drawdown double, longest_gap_us bigint",
    "w6_drawdowns": "mint bigint, max_drawdown double, drawdown_from_ath double, drawdown_from_launch double, below_launch_us bigint",
    "w8_w9_window_flow": "mint bigint, seq bigint, buy_volume double, net_flow double, buyers int",
    "z10_gap_fail_closed": "event_id bigint, allowed boolean",
    "z1_z2_stream_rate": "user_id bigint, start_us bigint, n bigint",
    "z3_stream_sliding_flow": "mint bigint, end_us bigint, buy_volume double, net_flow double",
    "z4_stream_sessions": "user_id bigint, start_us bigint, end_us bigint, n bigint",
    "z5_stream_ledger": "mint bigint, wallet bigint, held double, cost double, realised double",
    "z6_stream_dedup": "user_id bigint, k bigint, kept bigint, reports bigint, is_one_of_them boolean",
    "z7_stream_reconcile": "key bigint, t_us bigint, c_us bigint, outcome string",
    "z8_preferred_source": "user_id bigint, source string, reports bigint",
    "z9_replay_equals_live": "side string, positions bigint",
    "sell_episodes": "mint bigint, episode bigint, us bigint, price double, buys bigint, volume double, buyers bigint, recovery_us bigint, end_us bigint",
    "t7_sell_resolutions": "id bigint, mint bigint, us bigint, outcome string, false_positive boolean, saved double, latency_ms bigint",
    "t6_tentative_sells": "id bigint, mint bigint, seller bigint, slot bigint, us bigint, signature string, source string, original bigint, token_in double, quote_out double, seller_class string, decoded_confidence double, account_confidence double, confidence double, seller_balance double, seller_holding_pct double, own_impact_pct double, impact_pct double, slot_before bigint, price_before double, price_after double, latency_edge_ratio double, can_land boolean, latency_advantage_ms bigint, required_latency_ms bigint, absorption_health_score double, post_sell_absorption_probability double, expected_saved_loss double, expected_opportunity_cost double, net_benefit double, net_benefit_confidence double, level int, risk_level string, reasons string, armed boolean, triggered boolean, expires_us bigint, size_quote double, size_tokens double",
    "f21_defence_columns": "mint bigint, us bigint, step int, id bigint, tentative_sell_count_window bigint, tentative_sell_volume_quote_window double, tentative_sell_from_dev_count bigint, tentative_sell_from_top_holder_count bigint, tentative_sell_from_bundle_count bigint, tentative_sell_from_whale_count bigint, tentative_sell_same_slot_cluster_count bigint, tentative_sell_impact_max_pct double, tentative_sell_impact_sum_pct double, tentative_sell_confidence_max double, tentative_sell_confidence_mean double, shred_sell_warning_level int, shred_exit_armed_flag boolean, shred_emergency_exit_triggered_flag boolean, shred_to_geyser_processed_ms bigint, shred_to_account_effect_confirmation_ms bigint, shred_to_rooted_confirmation_ms bigint, shred_sell_false_positive_rate_wallet double, shred_sell_false_positive_rate_source double, shred_sell_saved_loss_estimate double, shred_sell_saved_loss_realized double, shred_exit_opportunity_cost double, shred_signal_stale_flag boolean, shred_exit_latency_budget_ms bigint, shred_exit_latency_used_ms bigint, shred_exit_edge_score double, malicious_sell_intent_score double, preconfirmation_exit_confidence double, dangerous_seller_precomputed_impact_score double, exit_threat_index_score double",
    "f14_survival_columns": "mint bigint, large_sell_count bigint, large_sell_total_quote double, price_impact_of_large_sells double, recovery_after_large_sell_ms bigint, recovery_after_large_sell_pct double, buyers_after_large_sell_count bigint, unique_buyers_after_large_sell bigint, buy_volume_after_large_sell double, holder_count_after_large_sell bigint, absorption_success_score double, absorption_failure_score double, repeated_absorption_count bigint, distribution_into_buyers_score double, price_flat_volume_high_distribution_warning boolean, vertical_move_without_holder_growth boolean, vertical_move_without_unique_buyers boolean, price_up_top_holders_selling boolean, price_up_bundle_selling boolean, price_up_dev_selling boolean, price_up_unique_buyers_down boolean, price_up_holder_count_down boolean, price_up_buy_size_concentration_high boolean, price_up_only_one_or_two_large_buys boolean, price_up_no_retail_breadth boolean, momentum_authenticity_score double, exit_liquidity_trap_score double, dev_not_selling_while_price_up boolean, organic_survival_score double, anti_rug_confidence_score double",
    "z5_w19_w20_stream_lifecycle": "mint bigint, us bigint, seq bigint, kind string, was string, state string, n bigint, holders bigint, buyers bigint, expires_us bigint",
    "b13_update_classes": "id bigint, class string, lane string, relevance string, deep boolean",
    "b14_class_volume": "class string, updates bigint, keys bigint, p50 double, p90 double, p95 double, p99 double, top_keys string",
    "b14_sketched_volume": "class string, updates bigint, p50 double, p90 double, p95 double, p99 double, top_keys string",
    "l3_alpha_features": "mint bigint, horizon int, asof_us bigint, reached boolean, trade_update_count_asof bigint, buy_count_delta_asof bigint, sell_count_delta_asof bigint, net_buy_sell_delta_asof bigint, volume_delta_asof double, unique_trade_accounts_asof bigint, last_trade_age_ms_asof bigint, trade_burst_score_asof double, trade_direction_imbalance_asof double, holder_update_count_asof bigint, unique_holder_accounts_seen_asof bigint, top_holder_concentration_asof double, dev_or_creator_holding_proxy_asof double, holder_churn_proxy_asof double, holder_collapse_proxy_asof double, new_holder_count_delta_asof bigint, exiting_holder_count_delta_asof bigint, vault_update_count_asof bigint, bonding_curve_update_count_asof bigint, liquidity_delta_asof double, reserve_delta_asof double, curve_progress_proxy_asof double, liquidity_exit_proxy_asof double, price_or_curve_move_proxy_asof double",
    "chained_decisions": "mint bigint, rug double, bundle double, dev double, top_holder double, fake_momentum double, data_quality double, overall double, policy string, strategy string, eligibility double, net_edge_quote double, decision string, blocked_by string, decision_reasons string",
    "f25_canonical_metrics": "mint bigint, metric_name string, metric_family string, value double, unit string, source_artifact string, confidence string, confidence_reason string, unavailable_reason string, parity_status string, required_for_backtest boolean, required_for_tuning boolean",
    "c16_text_numbers": "event_id bigint, number double, integer bigint, flag boolean",
    "s4_freeze_counts": "dataset string, rows bigint, keys bigint",
    "f22_availability": "mint bigint, available int, unavailable int",
}
