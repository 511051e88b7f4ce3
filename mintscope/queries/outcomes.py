"""L1, L4, L7, P17, P18, R16, R17."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ev_trades, table, with_views
from ..plans import gates as G
from ..plans import outcomes as O
from . import query
from .gates import _ELIGIBLE1, _ROWS, asof_rows


@query("""WITH a AS (SELECT o_custkey % 40 AS slice_id, o_orderkey % 6 AS segment_id, 'm' || o_custkey AS mint, epoch_us(o_orderdate) + o_orderkey AS ats, CASE o_orderkey % 4 WHEN 0 THEN 'early_rejected_dead' WHEN 1 THEN 'terminal_inconclusive' WHEN 2 THEN NULL ELSE 'survived' END AS fs, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS rs, o_orderkey % 300 AS ts FROM orders),
    f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY mint ORDER BY ats, slice_id, segment_id) = 1),
    x AS (SELECT *, CASE WHEN slice_id % 3 = 0 THEN 'dumped' END AS rc, coalesce(slice_id % 5 = 1, false) AS cc, slice_id % 4 = 1 AS cr, slice_id % 7 <> 2 AS cl, segment_id = 5 AS dl, slice_id % 11 = 3 AS sg, slice_id % 13 = 4 AS hm, slice_id % 17 = 5 AS rb, slice_id % 2 = 1 AS ra, slice_id % 8 > 2 AS rn, slice_id % 9 = 6 AS gp FROM f),
    y AS (SELECT *, gp OR dl AS pg, cr AND ra AND rn AS re FROM x), z AS (SELECT *, coalesce(fs = 'early_rejected_dead', false) AND cl AND NOT pg AND NOT sg AS cn, re AND NOT cc AND cl AS cp, coalesce(fs = 'terminal_inconclusive', false) OR pg OR sg OR hm OR rb AS ce FROM y)
    SELECT slice_id, segment_id, mint, coalesce(fs, '') AS final_outcome, coalesce(rs, rc, '') AS final_outcome_reason, CASE WHEN fs = 'early_rejected_dead' THEN coalesce(rc, '') ELSE '' END AS rejection_reason, CASE WHEN fs = 'terminal_inconclusive' THEN coalesce(rs, rc, '') ELSE '' END AS terminal_inconclusive_reason, CASE WHEN fs = 'early_rejected_dead' THEN ts * 1000 END AS time_to_rejection_ms,
        CASE WHEN fs = 'terminal_inconclusive' THEN ts * 1000 END AS time_to_terminal_ms, pg AS provider_gap_exposed, sg AS relay_gap_exposed, sg AS sequence_gap_exposed, hm AS hash_mismatch_exposed, rb AS receiver_backpressure_exposed, cc AS candidate_checkpoint_seen, re AS replay_eligible, cn AS clean_negative_label, cp AS clean_positive_label, ce AS censored_label,
        CASE WHEN cp THEN 'clean_positive' WHEN cn THEN 'clean_negative' WHEN ce THEN 'censored' WHEN cc THEN 'audit_candidate_checkpoint' ELSE 'unknown_manual_review' END AS label_quality FROM z""")
def l1_mint_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.select((F.col("o_custkey") % 40).alias("slice_id"), (F.col("o_orderkey") % 6).alias("segment_id"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("mint"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).alias("at"), F.expr("case o_orderkey % 4 when 0 then 'early_rejected_dead' when 1 then 'terminal_inconclusive' when 2 then null else 'survived' end").alias("final_state"), F.expr("if(o_orderkey % 5 = 0, null, o_orderpriority)").alias("reason"), (F.col("o_orderkey") % 300).alias("tracked_s"))
    keys = a.select("slice_id", "segment_id", "mint").distinct()
    rejected = keys.where("slice_id % 3 = 0").withColumn("rejection_class", F.lit("dumped"))
    candidates = keys.withColumns({"candidate_checkpoint": F.col("slice_id") % 5 == 1, "replay_eligible": F.col("slice_id") % 4 == 1})
    segments = keys.select("slice_id", "segment_id").distinct().withColumns({"clean": F.col("slice_id") % 7 != 2, "data_loss": F.col("segment_id") == 5})
    runs = keys.select("slice_id").distinct().withColumns({"sequence_gap_count": (F.col("slice_id") % 11 == 3).cast("int"), "hash_mismatch_count": (F.col("slice_id") % 13 == 4).cast("int"), "receiver_backpressure_count": (F.col("slice_id") % 17 == 5).cast("int"), "replay_allowed": F.col("slice_id") % 2 == 1, "replay_eligible_count": F.greatest(F.lit(0), F.col("slice_id") % 8 - 2)})
    return O.mint_labels(a, rejected, candidates, segments, runs, keys.where("slice_id % 9 = 6"))


_FLAGS = ["provider_gap_exposed", "relay_gap_exposed", "sequence_gap_exposed", "hash_mismatch_exposed", "receiver_backpressure_exposed"]
_T = "data_complete_for_horizon AND (trade_update_count_asof IS NOT NULL OR buy_count_delta_asof IS NOT NULL OR sell_count_delta_asof IS NOT NULL)"
_H = "data_complete_for_horizon AND (holder_update_count_asof IS NOT NULL OR unique_holder_accounts_seen_asof IS NOT NULL OR top_holder_concentration_asof IS NOT NULL)"
_V = "data_complete_for_horizon AND (vault_update_count_asof IS NOT NULL OR bonding_curve_update_count_asof IS NOT NULL OR curve_progress_proxy_asof IS NOT NULL)"


@query(f"""WITH {_ROWS} SELECT k, promoted AS asof_alpha_feature_available, promoted AND {_T} AS asof_alpha_trade_delta_available, promoted AND {_H} AS asof_alpha_holder_state_available, promoted AND {_V} AS asof_alpha_vault_curve_available, CASE WHEN promoted THEN horizon_reached ELSE rich_tracked END AS tracked_at_least_horizon,
    {', '.join(f"CASE WHEN promoted THEN {f} ELSE near_miss END AS {f}" for f in _FLAGS)} FROM a""")
def l4_merge_alpha(spark, sf_dir):
    rows = asof_rows(spark, sf_dir)
    base = rows.select("k", F.col("rich_tracked").alias("tracked_at_least_horizon"), *[F.col("near_miss").alias(f) for f in _FLAGS])
    alpha = rows.where("promoted").select("k", "data_complete_for_horizon", "horizon_reached", *_FLAGS, *[c for cols in G.GROUPS.values() for c in cols])
    return O.merge_alpha(base, alpha, ["k"], G.GROUPS)


@query(f"""WITH {_ROWS} SELECT k, CASE WHEN promoted THEN curve_progress_proxy_asof ELSE trade_burst_score_asof END AS curve, CASE WHEN promoted THEN final_outcome ELSE rejection_reason END AS note, promoted AND horizon_reached AS horizon_reached, promoted AND data_complete_for_horizon AS data_complete_for_horizon FROM a
    WHERE coalesce(positive_outcome_label IN ('positive', 'high_positive', 'dead_negative', 'censored'), false) OR clean_negative_label OR censored_label""")
def l7_validation_features(spark, sf_dir):
    rows = asof_rows(spark, sf_dir)
    base = rows.select("k", "positive_outcome_label", "clean_negative_label", "censored_label", F.col("trade_burst_score_asof").alias("curve"), F.col("rejection_reason").alias("note"))
    features = rows.where("promoted").select("k", F.col("curve_progress_proxy_asof").alias("curve"), F.col("final_outcome").alias("note"), "horizon_reached", "data_complete_for_horizon")
    return O.validation_features(base, features, ["k"], ["curve", "note"], ["horizon_reached", "data_complete_for_horizon"])


_SAFE = {"trade_delta": ["buy_count_delta_asof", "final_outcome"], "holder_state": ["holder_update_count_asof"], "vault_curve": ["curve_progress_proxy_asof", "volume_delta_asof"]}


@query(f"""WITH {_ROWS}, m AS (SELECT *, concat_ws('_', CASE WHEN buy_count_delta_asof IS NULL AND final_outcome IS NULL THEN 'trade_delta' END, CASE WHEN holder_update_count_asof IS NULL THEN 'holder_state' END, CASE WHEN curve_progress_proxy_asof IS NULL AND volume_delta_asof IS NULL THEN 'vault_curve' END) AS miss FROM a)
    SELECT k, reason, CASE WHEN reason = '' THEN 'early_burst_feature_complete_cohort' ELSE 'legacy_label_context' END AS cohort FROM (SELECT k, CASE WHEN NOT promoted THEN 'legacy_feature_row_missing' WHEN NOT horizon_reached THEN 'horizon_not_reached' WHEN NOT data_complete_for_horizon THEN 'asof_feature_row_incomplete' WHEN data_quality_exclusion THEN 'data_quality_excluded'
        WHEN relay_gap_exposed THEN 'holder_rpc_used_forbidden' WHEN hash_mismatch_exposed THEN 'rpc_mint_supply_canonical_forbidden' WHEN miss <> '' THEN 'missing_' || miss ELSE '' END AS reason FROM m)""")
def p17_feature_complete_cohort(spark, sf_dir):
    x = asof_rows(spark, sf_dir).withColumns({"found": F.col("promoted"), "holder_rpc_used": F.col("relay_gap_exposed"), "rpc_mint_supply_canonical": F.col("hash_mismatch_exposed")})
    x = x.select("k", O.cohort_reason(_SAFE).alias("reason"))
    return x.withColumn("cohort", F.when(F.col("reason") == "", "early_burst_feature_complete_cohort").otherwise("legacy_label_context"))


@query(f"""WITH {_ELIGIBLE1}, h AS (SELECT mint AS m, coalesce(string_agg(horizon_seconds, '|' ORDER BY horizon_seconds) FILTER (tracked_at_least_horizon), '') AS h FROM a GROUP BY 1), l AS (SELECT * FROM v1 QUALIFY row_number() OVER (PARTITION BY mint ORDER BY k DESC) = 1)
    SELECT mint, mint % 7 AS slice_id, k % 900 AS observed_seconds, h AS horizons_reached, CASE WHEN provider_gap_exposed OR relay_gap_exposed OR sequence_gap_exposed OR hash_mismatch_exposed OR receiver_backpressure_exposed THEN '' ELSE 'counted_clean_segment' END AS candidate_gates_passed, first_failed_gate AS first_failed_candidate_gate, label_censored AS censored,
        provider_gap_exposed OR relay_gap_exposed OR sequence_gap_exposed OR hash_mismatch_exposed OR receiver_backpressure_exposed AS data_quality_excluded, NOT (asof_alpha_trade_delta_available AND asof_alpha_holder_state_available AND asof_alpha_vault_curve_available) AS missing_asof_features, decision FROM l JOIN h ON mint = m WHERE mint % 7 IN (1, 2, 5)""")
def p18_survivor_diagnostics(spark, sf_dir):
    rows = asof_rows(spark, sf_dir)
    scored = G.eligibility_v1(rows)
    last = scored.groupBy("mint").agg(F.max_by(F.struct("k", "label_censored", *_FLAGS, "reasons", "decision", "first_failed_gate"), "k").alias("s")).select("mint", "s.*")
    labels = last.select("mint", (F.col("mint") % 7).alias("slice_id"), (F.col("k") % 900 * 1000 + 17).alias("tracked_ms"), F.col("label_censored").alias("censored_label"), *_FLAGS)
    extended = labels.where("slice_id in (1, 2, 5)").select("slice_id")
    return O.survivor_diagnostics(labels, rows.select("mint", "horizon_seconds", "tracked_at_least_horizon"), last.select("mint", "reasons", "decision", "first_failed_gate"), extended)


_RULE_ROWS = {
    "mint": "o_orderkey", "age_seconds": "o_orderkey % 400", "buy_count": "CASE WHEN o_custkey % 9 = 1 THEN NULL ELSE o_custkey % 5 END", "sell_count": "CASE WHEN o_custkey % 11 = 1 THEN NULL ELSE o_custkey % 3 END", "no_buy_gap_seconds": "CASE WHEN o_custkey % 7 = 1 THEN NULL ELSE o_custkey % 120 END", "holder_count": "o_custkey % 30", "holder_churn_rate": "CASE WHEN o_orderkey % 8 = 1 THEN NULL ELSE CAST(o_custkey % 10 AS DOUBLE) / 10 END",
    "dev_sold_pct": "CAST(o_orderkey % 10 AS DOUBLE) / 12", "top_holder_sold_pct": "CASE WHEN o_orderkey % 13 = 1 THEN NULL ELSE CAST(o_custkey % 10 AS DOUBLE) / 12 END", "stream_bundle_like_score": "CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END", "top_holder_pct_curve_economic_supply": "CAST(o_custkey % 50 AS DOUBLE) / 100",
    "funding_cluster_risk": "CASE WHEN o_custkey % 4 = 1 THEN NULL ELSE CAST(o_custkey % 90 AS DOUBLE) / 100 END", "drawdown_so_far": "CAST(o_orderkey % 97 AS DOUBLE) / 97",
}
_outcome = lambda name, s, safe, gone, hit: f"SELECT mint, '{name}' AS rule, {safe} AS pre_entry_safe, CASE WHEN age_seconds < {s} THEN 'too_early' WHEN {gone} THEN 'unavailable' WHEN {hit} THEN 'hit' ELSE 'miss' END AS outcome FROM x"
_RULES = " UNION ALL ".join([
    _outcome("no_buy_followthrough_by_30s", 30, "true", "buy_count IS NULL OR sell_count IS NULL", "buy_count <= 1"), _outcome("no_buy_followthrough_by_60s", 60, "true", "buy_count IS NULL OR sell_count IS NULL", "buy_count <= 1"), _outcome("volume_evaporated_by_60s", 60, "true", "buy_count IS NULL OR sell_count IS NULL OR no_buy_gap_seconds IS NULL", "no_buy_gap_seconds >= 60"),
    _outcome("holder_collapse_by_60s", 60, "true", "holder_churn_rate IS NULL", "holder_churn_rate >= 0.5"), _outcome("top_holder_or_dev_dump_before_180s", 180, "true", "top_holder_sold_pct IS NULL", "dev_sold_pct >= 0.5 OR top_holder_sold_pct >= 0.5"),
    _outcome("same_slot_bundle_like_plus_holder_concentration", 15, "true", "stream_bundle_like_score IS NULL", "stream_bundle_like_score > 0.35 AND top_holder_pct_curve_economic_supply >= 0.2"), _outcome("common_funder_plus_bundle_like_signal", 60, "false", "funding_cluster_risk IS NULL OR stream_bundle_like_score IS NULL", "funding_cluster_risk > 0.35 AND stream_bundle_like_score > 0.35"),
    _outcome("liquidity_exit_proxy_before_300s", 300, "true", "sell_count IS NULL", "drawdown_so_far >= 0.8 AND sell_count > 0"),
])


@query(f"WITH x AS (SELECT {', '.join(f'{v} AS {n}' for n, v in _RULE_ROWS.items())} FROM orders) {_RULES}")
def r16_early_rules(spark, sf_dir):
    return O.early_rules(table(spark, sf_dir, "orders").selectExpr(*[f"{v} as {n}" for n, v in _RULE_ROWS.items()]))


@query(with_views("ev", sql="""s AS (SELECT mint, min(us) AS su FROM ev GROUP BY mint), x AS (SELECT ev.*, su, max(price) OVER (PARTITION BY mint ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS run FROM ev JOIN s USING (mint)), h AS (SELECT *, unnest([60, 180, 300, 900]) AS horizon FROM x),
    g AS (SELECT mint, horizon, max(1 - price / run) AS drawdown, count(*) FILTER (side = 'buy') AS buys, max(us) FILTER (side = 'buy') AS lb, any_value(su) AS su FROM h WHERE us <= su + horizon * 3600000000 GROUP BY 1, 2)
    SELECT mint, horizon, drawdown, buys, drawdown >= 0.80 AS collapsed_80, drawdown >= 0.95 AS collapsed_95, buys <= 1 AS no_buy_followthrough, coalesce(su + horizon * 3600000000 - lb >= 216000000000, true) AS volume_evaporated, mint % 5 = 0 AS holder_collapse FROM g"""))
def r17_rug_outcomes(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    churn = t.select("mint").distinct().select("mint", F.when(F.col("mint") % 3 == 0, F.when(F.col("mint") % 5 == 0, 0.6)).otherwise(F.when(F.col("mint") % 5 == 0, 0.5).otherwise(0.2)).alias("holder_churn"))
    return O.rug_outcomes(t, t.groupBy("mint").agg(F.min("us").alias("start_us")), churn, 3_600_000_000)
