"""Diagnostic risk evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import table
from ..plans import diagnostics as D
from . import query

_flag = lambda x, none, yes: f"CASE WHEN {x} % {none} = 1 THEN NULL ELSE {x} % {yes} = 0 END"
_num = lambda x, none, m, by=1: f"CASE WHEN {x} % {none} = 2 THEN NULL ELSE CAST({x} % {m} AS DOUBLE) / {by} END"
_IN = {
    "mint": "o_orderkey", "top_holder_pct": _num("o_custkey", 7, 90, 100), "dev_holding_pct": _num("o_orderkey", 6, 40, 1000), "holder_churn_rate": _num("o_custkey", 3, 20, 15), "paperhand_90pct_count": _num("o_custkey + 3 * o_orderkey", 5, 14), "same_slot_tx_count": _num("o_orderkey", 4, 5), "same_instruction_shape_count": _num("o_custkey", 4, 4), "same_account_list_hash_count": "CAST(NULL AS DOUBLE)",
    "same_signer_cluster_count": _num("o_orderkey + o_custkey", 3, 5), "priority_fee_cluster_count": _num("o_orderkey", 3, 4), "fake_momentum_proxy": _flag("o_custkey", 2, 5), "buy_count": _num("o_orderkey", 8, 30), "unique_buyers": _num("o_custkey", 9, 12), "sell_absorption_proxy": _flag("o_orderkey", 4, 3), "metadata_uri_present": _flag("o_custkey", 6, 4), "metadata_fetch_success": _flag("o_orderkey", 3, 2),
    "social_count": _num("o_custkey", 5, 3), "one_hop_funder_count": _num("o_orderkey", 5, 4), "supply_matches": _flag("o_orderkey + o_custkey", 3, 2), "supply_mismatch_ratio": _num("o_custkey", 4, 10, 6), "data_gap_active": _flag("o_custkey", 9, 31), "stream_gap_active": _flag("o_orderkey", 9, 37), "post_migration_supported": _flag("o_orderkey", 2, 7),
}
_IN = {k: v.replace("o_custkey + 3 * o_orderkey", "(o_custkey + 3 * o_orderkey)").replace("o_orderkey + o_custkey", "(o_orderkey + o_custkey)") for k, v in _IN.items()}
_c = lambda e: f"least(1.0, greatest(0.0, {e}))"
_E = f"""i AS (SELECT {', '.join(f'{v} AS {n}' for n, v in _IN.items())} FROM orders),
    w AS (SELECT *, coalesce(NOT metadata_uri_present, false) AS nouri FROM i),
    r AS (SELECT mint, supply_matches, 1 AS o, 'holder_concentration_risk' AS id, 'holder_concentration_risk' AS family, 'stream' AS src, true AS safe, {_c('top_holder_pct / 0.80')} AS s, top_holder_pct IS NOT NULL AS ok, 1.0 AS cf FROM w
        UNION ALL SELECT mint, supply_matches, 2, 'dev_exit_risk', 'dev_exit_risk', 'stream', true, CASE WHEN dev_holding_pct <= 0.01 THEN 0.25 ELSE 0.05 END, dev_holding_pct IS NOT NULL, 1.0 FROM w
        UNION ALL SELECT mint, supply_matches, 3, CASE WHEN holder_churn_rate IS NULL AND paperhand_90pct_count IS NOT NULL THEN 'paperhand_90pct_risk' ELSE 'holder_churn_risk' END, 'holder_churn_risk', 'stream', true, {_c('coalesce(holder_churn_rate, paperhand_90pct_count / 10)')}, holder_churn_rate IS NOT NULL OR paperhand_90pct_count IS NOT NULL, CASE WHEN holder_churn_rate IS NOT NULL THEN 0.8 ELSE 0.7 END FROM w
        UNION ALL SELECT mint, supply_matches, 4, 'same_slot_bundle_like_risk', 'bundle_like_risk', 'stream', true, {_c('(coalesce(same_slot_tx_count, 0) / 2 + (coalesce(same_instruction_shape_count, 0) + coalesce(same_signer_cluster_count, 0) + coalesce(priority_fee_cluster_count, 0)) / 3) / 5')}, true, 0.8 FROM w
        UNION ALL SELECT mint, supply_matches, 5, 'fake_momentum_risk', 'fake_momentum_risk', 'stream', true, CASE WHEN fake_momentum_proxy THEN 0.70 WHEN fake_momentum_proxy IS NOT NULL THEN 0.05 ELSE {_c('(0.50 - unique_buyers / buy_count) / 0.50')} END, fake_momentum_proxy IS NOT NULL OR (unique_buyers IS NOT NULL AND coalesce(buy_count, 0) > 0), CASE WHEN fake_momentum_proxy IS NOT NULL THEN 0.8 ELSE 0.7 END FROM w
        UNION ALL SELECT mint, supply_matches, 6, 'sell_absorption_failure_risk', 'sell_absorption_failure_risk', 'stream', true, CASE WHEN sell_absorption_proxy THEN 0.15 ELSE 0.55 END, sell_absorption_proxy IS NOT NULL, 0.7 FROM w
        UNION ALL SELECT mint, supply_matches, 7, 'metadata_social_absence_risk', 'metadata_social_risk', CASE WHEN nouri THEN 'stream' ELSE 'http' END, nouri, CASE WHEN nouri THEN 0.5 WHEN metadata_fetch_success AND coalesce(social_count, 0) > 0 THEN 0.05 ELSE 0.35 END, nouri OR metadata_fetch_success IS NOT NULL, 0.7 FROM w
        UNION ALL SELECT mint, supply_matches, 8, 'common_funder_risk', 'funding_common_funder_risk', 'rpc', false, {_c('one_hop_funder_count / 3')}, one_hop_funder_count IS NOT NULL, 0.45 FROM w
        UNION ALL SELECT mint, supply_matches, 9, 'supply_semantics_risk', 'supply_semantics_risk', 'rpc', false, CASE WHEN supply_matches THEN 0.05 ELSE {_c('coalesce(supply_mismatch_ratio, 1)')} END, supply_matches IS NOT NULL, CASE WHEN supply_matches THEN 0.8 ELSE 0.9 END FROM w
        UNION ALL SELECT mint, supply_matches, 10, 'data_quality_risk', 'data_quality_risk', 'stream', true, (coalesce(data_gap_active, false) OR coalesce(stream_gap_active, false))::INT, true, 1.0 FROM w
        UNION ALL SELECT mint, supply_matches, 11, 'post_migration_unknown_risk', 'post_migration_unknown_risk', 'stream', true, CASE WHEN post_migration_supported THEN 0 ELSE 0.30 END, post_migration_supported IS NOT NULL, CASE WHEN post_migration_supported THEN 0.6 ELSE 0.5 END FROM w)"""


def _evidence(spark, sf_dir):
    return D.evidence(table(spark, sf_dir, "orders").selectExpr(*[f"{v} as {n}" for n, v in _IN.items()]))


@query(f"""WITH {_E}, t AS (SELECT mint, avg(s) FILTER (ok) AS total, coalesce(avg(s) FILTER (ok AND src = 'stream'), 0) AS stream_only, coalesce(avg(s) FILTER (ok AND src <> 'stream'), 0) AS enrichment, avg(cf) FILTER (ok) AS confidence, count(*) FILTER (ok) AS evidence_count, bool_or(ok AND src <> 'stream' AND s > 0.35) AS rich, bool_or(o = 4 AND s > 0.35) AS bundled,
        coalesce(string_agg(family, '|' ORDER BY o) FILTER (NOT ok), '') AS unavailable, coalesce(string_agg(id, '|' ORDER BY o) FILTER (safe), '') AS pre_entry_safe, any_value(supply_matches) AS sm FROM r GROUP BY mint)
    SELECT mint, total, stream_only, enrichment, confidence, evidence_count, CASE WHEN bundled THEN 'bundle_like_stream_signal' WHEN rich THEN 'elevated_enrichment_risk' WHEN stream_only > 0.35 THEN 'elevated_stream_risk' ELSE 'low_risk_observed' END AS classification, unavailable, pre_entry_safe, '' AS blocking,
        CASE WHEN sm THEN 'rpc_mint_supply_matches_curve_economic_supply' WHEN NOT sm THEN 'rpc_mint_supply_diagnostic_only_mismatch' ELSE 'rpc_supply_semantics_not_checked' END AS supply_status FROM t""")
def r8_diagnostic_risk(spark, sf_dir):
    return D.totals(_evidence(spark, sf_dir))


@query(f"WITH {_E} SELECT mint, id AS risk_id, 'enrichment_late_feature' AS role FROM r WHERE ok AND NOT safe AND (id = 'common_funder_risk' AND mint % 3 = 0 OR id = 'metadata_social_absence_risk' AND mint % 2 = 0)")
def r9_time_role_leaks(spark, sf_dir):
    used = F.array_compact(F.array(F.when(F.col("mint") % 3 == 0, "common_funder_risk"), F.when(F.col("mint") % 2 == 0, "metadata_social_absence_risk"), F.lit("dev_exit_risk")))
    return D.leaks(_evidence(spark, sf_dir).withColumn("used", used), "used")
