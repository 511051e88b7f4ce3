"""Diagnostic risk evidence per mint: eleven families with their source and time role, totals by source, and a check that no late evidence is used early."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import clamp01

# What counts as concentrated, as many transactions of one slot, and as few buyers for the buys.
TOP, SLOT, FEW = 0.80, 2.0, 0.50
#: Roles of evidence that may be used before an entry.
SAFE = ["pre_entry_feature", "decision_time_feature"]


def _row(id_: Column | str, family: str, source: Column | str, role: Column | str, score: Column, confidence: Column | float, reason: str) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    there = score.isNotNull()
    return F.struct(
        lit(id_).alias("risk_id"), F.lit(family).alias("family"), lit(source).alias("source"), lit(role).alias("role"), F.when(there, clamp01(score)).alias("score"),
        F.when(there, lit(confidence).cast("double")).otherwise(F.lit(0.0)).alias("confidence"), F.when(~there, F.lit(reason)).alias("reason"),
    )


def evidence(rows: DataFrame) -> DataFrame:
    """Adds `evidence`, an array of (risk_id, family, source, role, score, confidence, reason); score is NULL and reason set where a family has no data."""
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    c, yes = F.col, lambda c: F.col(c).cast("boolean")
    now, late = "decision_time_feature", "enrichment_late_feature"
    churned = c("holder_churn_rate").isNotNull()
    no_uri = F.coalesce(~yes("metadata_uri_present"), F.lit(False))
    fetched = yes("metadata_fetch_success").isNotNull()
    faked = F.when(yes("fake_momentum_proxy").isNotNull(), F.when(yes("fake_momentum_proxy"), 0.70).otherwise(0.05)).when(c("unique_buyers").isNotNull() & (c("buy_count") > 0), (FEW - c("unique_buyers") / c("buy_count")) / FEW)
    bundle = (n("same_slot_tx_count") / SLOT + (n("same_instruction_shape_count") + n("same_account_list_hash_count") + n("same_signer_cluster_count") + n("priority_fee_cluster_count")) / 3) / 5
    return rows.withColumn("evidence", F.array(
        _row("holder_concentration_risk", "holder_concentration_risk", "stream", now, c("top_holder_pct") / TOP, 1.0, "missing_stream_holder_snapshot"),
        _row("dev_exit_risk", "dev_exit_risk", "stream", now, F.when(c("dev_holding_pct").isNotNull(), F.when(c("dev_holding_pct") <= 0.01, 0.25).otherwise(0.05)), 1.0, "missing_stream_dev_holder_state"),
        _row(F.when(churned | c("paperhand_90pct_count").isNull(), "holder_churn_risk").otherwise("paperhand_90pct_risk"), "holder_churn_risk", "stream", now, F.coalesce("holder_churn_rate", c("paperhand_90pct_count") / 10), F.when(churned, 0.8).otherwise(0.7), "holder_churn_not_in_canary_artifact"),
        _row("same_slot_bundle_like_risk", "bundle_like_risk", "stream", now, bundle, 0.8, ""),
        _row("fake_momentum_risk", "fake_momentum_risk", "stream", now, faked, F.when(yes("fake_momentum_proxy").isNotNull(), 0.8).otherwise(0.7), "requires_unique_buyer_and_holder_context"),
        _row("sell_absorption_failure_risk", "sell_absorption_failure_risk", "stream", now, F.when(yes("sell_absorption_proxy"), 0.15).when(~yes("sell_absorption_proxy"), 0.55), 0.7, "missing_sell_absorption_context"),
        _row("metadata_social_absence_risk", "metadata_social_risk", F.when(no_uri, "stream").otherwise("metadata_http"), F.when(no_uri, now).otherwise(late), F.when(no_uri, 0.50).when(fetched, F.when(yes("metadata_fetch_success") & (n("social_count") > 0), 0.05).otherwise(0.35)), 0.7, "metadata_http_not_run"),
        _row("common_funder_risk", "funding_common_funder_risk", "bounded_rpc", late, c("one_hop_funder_count") / 3, 0.45, "bounded_funding_graph_not_run"),
        _row("supply_semantics_risk", "supply_semantics_risk", "bounded_rpc", late, F.when(yes("supply_matches"), 0.05).when(~yes("supply_matches"), F.coalesce("supply_mismatch_ratio", F.lit(1.0))), F.when(yes("supply_matches"), 0.8).otherwise(0.9), "rpc_supply_semantics_not_checked"),
        _row("data_quality_risk", "data_quality_risk", "stream", now, F.when(F.coalesce(yes("data_gap_active"), F.lit(False)) | F.coalesce(yes("stream_gap_active"), F.lit(False)), 1.0).otherwise(0.0), 1.0, ""),
        _row("post_migration_unknown_risk", "post_migration_unknown_risk", "stream", now, F.when(yes("post_migration_supported"), 0.0).when(~yes("post_migration_supported"), 0.30), F.when(yes("post_migration_supported"), 0.6).otherwise(0.5), "migration_not_observed_or_not_applicable"),
    ))


def totals(rows: DataFrame, key: str = "mint") -> DataFrame:
    """(key, totals by source, confidence, classification, lists) of rows with evidence; means of nothing are 0."""
    e = F.col("evidence")
    live = F.filter(e, lambda r: r["score"].isNotNull())
    mean = lambda a, field: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, r: s + r[field]) / F.size(a)).otherwise(F.lit(0.0))
    stream, rich = F.filter(live, lambda r: r["source"] == "stream"), F.filter(live, lambda r: r["source"].isin("bounded_rpc", "metadata_http"))
    names = lambda a, field: F.array_join(F.transform(a, lambda r: r[field]), "|")
    x = rows.withColumns({"total": mean(live, "score"), "stream_only": mean(stream, "score"), "enrichment": mean(rich, "score"), "confidence": mean(live, "confidence"), "n": F.size(live), "rich_high": F.exists(rich, lambda r: r["score"] > 0.35), "bundled": F.exists(e, lambda r: r["risk_id"].contains("bundle_like") & (F.coalesce(r["score"], F.lit(0.0)) > 0.35))})
    cls = F.when(F.col("bundled"), "bundle_like_stream_signal").when(F.col("rich_high"), "elevated_enrichment_risk").when(F.col("stream_only") > 0.35, "elevated_stream_risk").when(F.col("n") == 0, "inconclusive_missing_enrichment").otherwise("low_risk_observed")
    return x.select(
        key, "total", "stream_only", "enrichment", "confidence", F.col("n").alias("evidence_count"), cls.alias("classification"),
        names(F.filter(e, lambda r: r["score"].isNull()), "family").alias("unavailable"), names(F.filter(e, lambda r: r["role"].isin(*SAFE)), "risk_id").alias("pre_entry_safe"),
        F.array_join(F.transform(F.filter(e, lambda r: r["reason"].contains("data_gap") | r["reason"].contains("stream_gap")), lambda r: r["reason"]), "|").alias("blocking"),
        F.when(F.col("supply_matches").cast("boolean"), "rpc_mint_supply_matches_curve_economic_supply").when(~F.col("supply_matches").cast("boolean"), "rpc_mint_supply_diagnostic_only_mismatch").otherwise("rpc_supply_semantics_not_checked").alias("supply_status"),
    )


def leaks(rows: DataFrame, used: str, key: str = "mint") -> DataFrame:
    """(key, risk_id, role) of evidence that is used before entry (`used`: an array of risk ids) and isn't safe then."""
    bad = F.filter("evidence", lambda r: F.array_contains(F.col(used), r["risk_id"]) & ~r["role"].isin(*SAFE) & r["score"].isNotNull())
    return rows.select(key, F.explode(bad).alias("r")).select(key, "r.risk_id", "r.role")
