"""Counters over tokens, labels, scores and audits. One row each, or a short list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import flag

POSITIVE = ["positive", "high_positive"]


def _is(c: str, *values: str) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def compact_tokens(states: DataFrame, stats: DataFrame, shares: DataFrame, dev: DataFrame, reasons: DataFrame) -> DataFrame:
    """(mint, lifecycle, latest_price, holder_count, top1_holder_pct, creator_sold_pct, canonical_trade_count, reason_codes) per token of stats (mint, latest_price, trades)."""
    x = stats.join(states.select("mint", "lifecycle"), "mint", "left").join(shares.select("mint", "holder_count", "top1_holder_pct"), "mint", "left").join(dev.select("mint", "creator_sold_pct"), "mint", "left").join(reasons.select("mint", "reason_codes"), "mint", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return x.select("mint", F.coalesce("lifecycle", F.lit("Discovered")).alias("lifecycle"), "latest_price", zero("holder_count"), zero("top1_holder_pct"), zero("creator_sold_pct"), F.col("trades").alias("canonical_trade_count"), F.coalesce(F.array_join(F.array_sort("reason_codes"), "|"), F.lit("")).alias("reason_codes"))


def label_counts(labels: DataFrame) -> DataFrame:
    """One row of label and outcome counters."""
    n = F.count_if
    pos, strong = _is("positive_outcome_label", *POSITIVE), _is("strength", "POSITIVE", "HIGH")
    return labels.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("mint").alias("unique_mints"), n(flag("clean_negative_label")).alias("clean_negative"), n(flag("censored_label")).alias("censored"), n(flag("clean_positive_label")).alias("clean_positive"), n(flag("candidate_checkpoint_seen")).alias("candidate_checkpoint"), n(flag("replay_eligible")).alias("replay_eligible"),
        n(flag("forward_window_observed")).alias("forward_window_observed"), n(_is("positive_outcome_label", "positive")).alias("positive"), n(_is("positive_outcome_label", "high_positive")).alias("high_positive"), n(pos).alias("positive_or_high"), n(strong).alias("positive_or_high_strength"), n(pos & ~flag("candidate_checkpoint_seen")).alias("positive_not_candidates"),
        n(strong & _is("positive_outcome_label", "censored", "invalid_quality")).alias("strong_censored_or_invalid"), n(pos & flag("replay_eligible")).alias("replay_eligible_positive"),
    )


def track_metrics(scores: DataFrame, review: str) -> DataFrame:
    """One row: scored, under review, captured, rejected and excluded rows and mints of a track's scores (mint, decision, label columns)."""
    seen = F.col("decision") == review
    n = F.count_if
    return scores.agg(
        F.count(F.lit(1)).alias("rows_scored"), F.count_distinct("mint").alias("unique_mints"), n(seen).alias("review_candidates"), F.count_distinct(F.when(seen, F.col("mint"))).alias("review_mints"), n(seen & (_is("positive_outcome_label", *POSITIVE) | flag("high_positive"))).alias("positive_high_captured"), n(seen & (_is("positive_outcome_label", "high_positive") | flag("high_positive"))).alias("high_captured"),
        n((F.col("decision") == "reject") & flag("clean_negative_label")).alias("dead_rejected"), n(F.col("decision").isin("censored", "audit_only")).alias("excluded"), n(flag("candidate_checkpoint_seen")).alias("candidate_checkpoints"), n(flag("replay_eligible")).alias("replay_eligible"),
    )


def cohort_comparison(rows: DataFrame, cohorts: dict[str, Column], tokens: dict[str, str], bins: dict[str, str], order: str, reasons: str = "reasons") -> DataFrame:
    """Per cohort (they may overlap): rows, mints, for each token of the reasons how much of the cohort has it (HIGH from half on, MEDIUM, LOW), and the commonest value of each bin, ties by what comes first in `order`.

    A cohort without rows is MISSING throughout.
    """
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in cohorts.items()]))
    x = rows.withColumn("cohort", F.explode(names))
    hits = {k: F.avg(F.coalesce(F.array_contains(reasons, t), F.lit(False)).cast("double")) for k, t in tokens.items()}
    rated = {k: F.when(v >= 0.5, "HIGH").when(v > 0, "MEDIUM").otherwise("LOW").alias(k) for k, v in hits.items()}
    out = x.groupBy("cohort").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("mint").alias("unique_mints"), *rated.values())
    for k, c in bins.items():
        counts = x.withColumn(c, F.when(F.coalesce(F.col(c), F.lit("")) == "", "MISSING").otherwise(F.col(c))).groupBy("cohort", c).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
        out = out.join(counts.groupBy("cohort").agg(F.max_by(c, F.struct("n", (-F.col("o")).alias("o"))).alias(k)), "cohort")
    all_names = rows.sparkSession.createDataFrame([(n,) for n in cohorts], "cohort string")
    full = all_names.join(out, "cohort", "left")
    return full.select("cohort", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("unique_mints", F.lit(0)).alias("unique_mints"), *[F.coalesce(k, F.lit("MISSING")).alias(k) for k in [*tokens, *bins]])


def _long(row: DataFrame) -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in row.columns])).alias("m")).select("m.*")


def exit_windows(rows: DataFrame) -> DataFrame:
    """(metric, value): ten counters over positive rows and their exit windows."""
    p = rows.where(_is("positive_outcome_label", *POSITIVE))
    n = F.count_if
    dead, seen = _is("final_outcome", "early_rejected_dead"), flag("exit_observed")
    return _long(p.agg(
        F.count(F.lit(1)).alias("positive_high_rows"), F.count_distinct("mint").alias("positive_high_unique_mints"), n(seen).alias("observable_exit_window_rows"), F.count_distinct(F.when(seen, F.col("mint"))).alias("observable_exit_window_unique_mints"), n(dead & ~seen).alias("died_before_exit_window_rows"), n(_is("sell_before", "MEDIUM", "HIGH")).alias("adverse_sell_pressure_before_rows"),
        n(_is("sell_after", "MEDIUM", "HIGH")).alias("adverse_sell_pressure_after_rows"), n(_is("holder_before", "MEDIUM", "HIGH", "UNSAFE")).alias("holder_or_dev_risk_before_rows"), n(_is("curve_before", "MEDIUM", "HIGH")).alias("vault_curve_progress_before_rows"), n(_is("positive_outcome_label", "high_positive") & dead).alias("high_positive_but_dead_rows"),
    ))


def gate_funnel(rows: DataFrame, most: int = 12) -> DataFrame:
    """(metric, value): rows avoided, continued, watched and failed, then the `most` commonest reasons of failure; rows: early, continued, candidate decisions and candidate reasons."""
    c = F.col("candidate")
    base = _long(rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("early") == "avoid").alias("avoided"), F.count_if(F.col("continued") == "continue_tracking").alias("continued_tracking"), F.count_if(c == "candidate_watch").alias("candidate_watch"), F.count_if(~F.coalesce(c.isin("candidate_watch", "candidate_review"), F.lit(False))).alias("failed_candidate_eligibility")))
    failed = rows.select(F.explode("reasons").alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("value")).orderBy(F.desc("value"), "r").limit(most)
    return base.union(failed.select(F.concat(F.lit("failed:"), "r"), "value"))


def root_causes(rows: DataFrame) -> DataFrame:
    """One row: counters of an audit (with blocker and root_cause of each row) and what blocks first."""
    n = F.count_if
    pos = _is("positive_outcome_label", *POSITIVE) | flag("high_positive")
    clean = pos & flag("r2_verified") & flag("artifact_consistency_ok") & flag("counted_run") & ~flag("provider_gap_exposed") & ~flag("relay_gap_exposed") & ~flag("terminal_inconclusive") & ~flag("candidate_checkpoint_seen")
    x = rows.agg(
        F.count(F.lit(1)).alias("rows"), n(pos).alias("positive_or_high_rows"), n(pos & (flag("high_positive") | _is("positive_outcome_label", "high_positive"))).alias("high_positive_rows"), n(flag("candidate_checkpoint_seen")).alias("candidate_checkpoint_rows"), n(flag("replay_eligible")).alias("replay_eligible_rows"), n(flag("promoted")).alias("promoted_rows"),
        n(clean).alias("clean_blocked_rows"), n(_is("root_cause", "R2_OR_ARTIFACT_BLOCKED", "PROVIDER_OR_RELAY_GAP_EXPOSED", "DATA_COLLECTION_UNIFORMITY_GAP")).alias("collection_rows"), n(_is("root_cause", "SURVIVOR_GATE_MISMATCH_FOR_EARLY_BURST", "POSITIVE_OUTCOME_NOT_MATERIAL_CANDIDATE")).alias("mismatch_rows"),
    )
    strict = F.col("clean_blocked_rows") > 0
    return x.withColumns({"collection_primary": (F.col("collection_rows") > 0) & ~strict, "strictness_primary": strict, "separate_type_needed": strict | (F.col("mismatch_rows") > 0)})


def policy_comparison(rows: DataFrame) -> DataFrame:
    """One row: what a shadow policy promotes (promotes) beside what is admitted now (admitted)."""
    n = F.count_if
    high, up, now = _is("positive_outcome_label", "high_positive"), flag("promotes"), flag("admitted")
    later = _is("positive_outcome_label", *POSITIVE)
    x = rows.agg(
        F.count(F.lit(1)).alias("shadow_rows"), F.count_distinct("mint").alias("shadow_mints"), n(high).alias("high_positive_rows"), n(high & up).alias("high_positive_promoted"), F.count_distinct(F.when(high, F.col("mint"))).alias("high_positive_mints"), n(_is("positive_outcome_label", "dead_negative") & up).alias("dead_promoted"), n(now & ~up).alias("admitted_would_reject"), n(~now & up).alias("blocked_would_promote"),
        n(now & ~up & later).alias("rejected_later_positive"), n(~now & up & later).alias("promoted_later_positive"), n(~now & up & high).alias("promoted_later_high"),
    )
    return x.withColumn("captures_all", F.col("high_positive_promoted") == F.col("high_positive_rows"))
