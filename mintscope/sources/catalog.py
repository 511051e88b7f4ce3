"""The run catalogue: order of replay, latest records, kinds, statistics, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replay_order(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Each run's events with their place: by sequence number if all have one, else by time, slot and id."""
    whole = F.min(F.col("sequence_number").isNotNull().cast("int")).over(Window.partitionBy(run)) == 1
    x = events.withColumn("__k", F.when(whole, F.struct(F.col("sequence_number").alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(F.struct(F.col("us").alias("a"), F.col("slot").alias("b"))))
    return x.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy("__k", "event_id"))).drop("__k")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The record that counts of each run: one of the root over one of a scenario, then the last, then the largest id."""
    w = Window.partitionBy("run_id").orderBy(F.desc("is_root"), F.desc("wall"), F.desc("record_id"))
    return runs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def run_statistics(runs: DataFrame, events: DataFrame, fills: DataFrame) -> DataFrame:
    """Runs with counts from their events and fills, 0 where there are none."""
    e = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    f = fills.groupBy("run_id").agg(F.count(F.lit(1)).alias("fills"), F.sum("pnl").alias("pnl"))
    return runs.join(e, "run_id", "left").join(f, "run_id", "left").fillna(0, ["events", "fills"])


def run_kind(run_id: Column, mode: Column, notes: Column) -> Column:
    """What a run is, by its mode, then its id's prefix, then its notes."""
    return F.when(mode == "replay", "replay").when(run_id.startswith("fixture") | notes.contains("scenario"), "fixture").when(mode == "live", "live_paper").when(run_id.startswith("bt"), "backtest").otherwise("unknown")


def run_role(kind: Column) -> Column:
    return F.when(kind == "live_paper", "source").when(kind.isin("replay", "backtest"), "derived").otherwise("test")


def latest_id(runs: DataFrame, **selector: str) -> DataFrame:
    """One row: the id of the last run that has all the selector's values."""
    x = runs
    for c, v in selector.items():
        x = x.where(F.col(c) == v)
    return x.agg(F.max_by("run_id", F.struct("wall", "run_id")).alias("run_id"))


def export_decisions(decisions: DataFrame, runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Decisions with their run's kind and their snapshot's counts; reason codes sorted and joined."""
    x = decisions.join(runs.select("run_id", "kind"), "run_id", "left").join(snapshots, ["run_id", "snapshot_hash"], "left")
    return x.withColumn("reason_codes", F.array_join(F.array_sort("reason_codes"), "|"))


def export_fills(fills: DataFrame) -> DataFrame:
    """Fills with ids and the first known of their times."""
    ident = lambda *c: F.substring(F.sha2(F.concat_ws(":", *[F.col(x).cast("string") for x in c]), 256), 1, 16)
    return fills.withColumns({"fill_id": ident("run_id", "mint", "side", "seq"), "position_id": ident("run_id", "mint"), "fill_us": F.coalesce("confirmation_us", "landing_us", "send_us", "signal_us")})


def include_slices(slices: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Slices with included, and all failed checks joined by ; (missing counts as failed)."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))
    return slices.withColumns({"included": F.size(failed) == 0, "reason": F.array_join(failed, ";")})


def segment_integrity(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(segment, rows, expected, corrupt, status) of segments against their manifest; rows has (segment, corrupt)."""
    x = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("rows"), F.count_if("corrupt").alias("corrupt"))
    y = expected.join(x, "segment", "left").fillna(0, ["rows", "corrupt"])
    return y.withColumn("status", F.when(F.col("rows") == 0, "empty").when(F.col("corrupt") > 0, "parse_errors").when(F.col("rows") != F.col("expected"), "count_mismatch").otherwise("ok"))


def merge_quality(ledgers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Per slice over many ledgers: verified in all, counted in any, and whether the ledgers agree."""
    x = ledgers[0]
    for s in ledgers[1:]:
        x = x.unionByName(s)
    return x.groupBy(*keys).agg(F.bool_and("verified").alias("verified"), F.bool_or("counted").alias("counted"), F.count(F.lit(1)).alias("ledgers"), (F.count_distinct("verified") == 1).alias("uniform"))


def mart(labels: DataFrame, features: DataFrame, slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels and features of the included slices, and row counts by horizon."""
    good = slices.where("included").select("slice_id")
    f = features.join(good, "slice_id", "left_semi")
    return labels.join(good, "slice_id", "left_semi"), f.groupBy("horizon").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("mint").alias("mints"))


# What a slice must pass to be counted, in order, and what its failure is called.
SLICE_CHECKS = {
    "counted": "counted_phase107b_result_false", "r2_verified": "r2_not_verified", "artifact_consistency_ok": "artifact_consistency_not_ok", "no_sequence_gaps": "sequence_gap_count_nonzero", "no_hash_mismatches": "hash_mismatch_count_nonzero", "no_backpressure": "receiver_backpressure_count_nonzero",
    "holder_rpc_disabled": "holder_rpc_enabled", "rpc_non_canonical": "rpc_mint_supply_canonical", "replay_disabled": "replay_enabled", "backtesting_disabled": "formal_backtesting_enabled", "tuning_disabled": "threshold_tuning_enabled", "trading_disabled": "trading_enabled",
}
# Blockers in the order that decides, with the class that each gives.
BLOCKED = [
    (["sequence_gap_count"], "SEQUENCE_GAP"), (["hash_mismatch_count"], "HASH_MISMATCH"), (["receiver_backpressure_count"], "RECEIVER_BACKPRESSURE"), (["receiver_unavailable_count"], "RECEIVER_UNAVAILABLE"), (["r2_failed", "retention_not_ok", "r2_timeout"], "R2"), (["r2_local_spool_full"], "SPOOL"),
    (["artifact_consistency"], "ARTIFACT_CONSISTENCY"), (["asof_alpha_feature_validation"], "ASOF_ALPHA_FEATURES"), (["vps_forbidden_artifacts"], "VPS_FORBIDDEN_ARTIFACTS"), (["not_counted"], "COUNTABILITY"), (["local_rc", "remote_rc", "local_finalization_timeout", "remote_relay_timeout"], "ORCHESTRATION"),
]


def slice_checks(slices: DataFrame) -> DataFrame:
    """Slices with included and all failed checks joined by ;. A slice has a flag for each of SLICE_CHECKS, or the counts that stand for it."""
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    ok = {"counted": flag("counted"), "r2_verified": flag("r2_verified"), "artifact_consistency_ok": flag("artifact_consistency_ok"), "no_sequence_gaps": none("sequence_gap_count"), "no_hash_mismatches": none("hash_mismatch_count"), "no_backpressure": none("receiver_backpressure_count")}
    for name, column in (("holder_rpc_disabled", "holder_rpc_enabled"), ("rpc_non_canonical", "rpc_mint_supply_canonical"), ("replay_disabled", "replay_allowed"), ("backtesting_disabled", "formal_backtesting_allowed"), ("tuning_disabled", "threshold_tuning_allowed"), ("trading_disabled", "live_trading_enabled")):
        ok[name] = ~flag(column)
    return include_slices(slices, {SLICE_CHECKS[n]: c for n, c in ok.items()})


def slice_class(blockers: str = "blockers") -> Column:
    """The class of a slice by its blockers; without any, by whether there were attempts and provider gaps."""
    b = F.col(blockers)
    name = lambda s: F.lit(f"RELAY_LOCAL_DATASET_BLOCK_{s}")
    quiet = F.coalesce(F.col("zero_attempt_no_signal"), F.lit(False))
    passed = F.when(quiet & (F.coalesce("all_launches_seen", F.lit(0)) == 0), "RELAY_LOCAL_DATASET_PASS_EMPTY_NO_ATTEMPTS").when(quiet, "RELAY_LOCAL_DATASET_PASS_NO_SIGNAL").when(F.coalesce("upstream_provider_blocker_count", F.lit(0)) > 0, "RELAY_PROVIDER_GAP_CONTINUATION_PASS").otherwise("RELAY_LOCAL_DATASET_PASS")
    out = F.when(F.coalesce(F.size(b), F.lit(0)) <= 0, passed)
    for flags, short in BLOCKED:
        met = F.arrays_overlap(b, F.array(*[F.lit(f) for f in flags]))
        if short == "COUNTABILITY":
            out = out.when(met & (F.coalesce("provider_blocker_class", F.lit("")) != ""), name("PROVIDER"))
        out = out.when(met, name(short))
    return out.otherwise(name("STRUCTURAL"))


def collection_class() -> Column:
    """The class of a slice that passed, by what it collected."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    quiet, off = F.coalesce("zero_attempt_no_signal", F.lit(False)), F.coalesce("replay_allowed", F.lit(False))
    return (
        F.when(quiet & (n("all_launches_seen") == 0), "RELAY_LOCAL_DATASET_PASS_EMPTY_NO_ATTEMPTS")
        .when(quiet, "RELAY_LOCAL_DATASET_PASS_NO_SIGNAL")
        .when((n("candidate_checkpoint_count") > 0) | ((n("replay_eligible_count") > 0) & off), "RELAY_COLLECTION_PASS_REVIEW_CANDIDATE")
        .when(n("upstream_provider_blocker_count") > 0, "RELAY_COLLECTION_PASS_PROVIDER_GAP_CONTINUED")
        .otherwise("RELAY_COLLECTION_PASS_COUNTED_NO_CANDIDATE")
    )


def raw_frames_class() -> Column:
    """Where a slice's raw frames are; usable where the class says AVAILABLE."""
    f = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    stored = F.coalesce("r2_count", F.lit(0)) > 0
    return (
        F.when(f("local_present") & stored, "RAW_FRAMES_AVAILABLE_LOCAL_AND_R2")
        .when(f("local_present"), "RAW_FRAMES_AVAILABLE_LOCAL")
        .when(stored, "RAW_FRAMES_AVAILABLE_R2")
        .when(f("pruned"), "RAW_FRAMES_PRUNED_AFTER_VERIFICATION")
        .when((F.coalesce("frames_received", F.lit(0)) == 0) & ~f("relay_manifest_present"), "RAW_FRAMES_NOT_CAPTURED")
        .when(~f("completed") | (f("r2_present") & ~f("retention_ok")), "RAW_FRAMES_UNVERIFIED_ABORTED_RUN")
        .otherwise("RAW_FRAMES_UNKNOWN_NEEDS_MANUAL_REVIEW")
    )


def coverage(segments: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: segments, how many are verified, counted and empty, launches attempted, bytes held, the last segment's number."""
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return segments.groupBy(run).agg(F.count(F.lit(1)).alias("segments"), flag("verified").alias("verified"), flag("counted").alias("counted"), F.count_if(F.coalesce("attempted", F.lit(0)) == 0).alias("empty"), F.coalesce(F.sum("attempted"), F.lit(0)).alias("attempted"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("segment").alias("last_segment"))
