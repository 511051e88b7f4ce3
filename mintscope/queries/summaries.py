"""U12, U17, U19, U21, U22, U25, U26, U28 over the as-of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ev_trades, with_views
from ..operators import aggregates as A
from ..operators import ledger as L
from ..operators import windows as W
from ..plans import gates as G
from ..plans import summaries as U
from . import query
from .gates import _INOUT, _ROWS, asof_rows


@query(with_views("ev", sql="""b AS (SELECT mint, wallet, greatest(sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END), 0) AS bal FROM ev GROUP BY 1, 2), h AS (SELECT mint, count(*) AS hc, max(bal) / sum(bal) AS t1 FROM b WHERE bal > 0 GROUP BY 1), c AS (SELECT mint, min(wallet) AS wallet FROM ev WHERE side = 'buy' GROUP BY 1),
    d AS (SELECT mint, least(1.0, coalesce(sum(tokens) FILTER (side = 'sell'), 0) / sum(tokens) FILTER (side = 'buy')) AS sold FROM ev JOIN c USING (mint, wallet) GROUP BY 1), s AS (SELECT mint, arg_max(price, (us, seq)) AS lp, count(*) AS n, count(DISTINCT wallet) FILTER (side = 'buy') AS ub, count(*) FILTER (side = 'sell') AS se FROM ev GROUP BY 1)
    SELECT s.mint, CASE WHEN n >= 4 OR ub >= 3 THEN 'ActiveDeep' WHEN n >= 2 THEN 'ActiveLight' ELSE 'FirstPass' END AS lifecycle, lp AS latest_price, coalesce(hc, 0) AS holder_count, coalesce(t1, 0) AS top1_holder_pct, coalesce(sold, 0) AS creator_sold_pct, n AS canonical_trade_count,
        concat_ws('|', CASE WHEN sold > 0 THEN 'DevSoldEarly' END, CASE WHEN se > n / 2 THEN 'SellsDominate' END) AS reason_codes FROM s LEFT JOIN h ON h.mint = s.mint LEFT JOIN d ON d.mint = s.mint""").replace("max(bal) / sum(bal) AS t1", "max(bal) / sum(bal) AS t1"))
def u12_compact_tokens(spark, sf_dir):
    t = ev_trades(spark, sf_dir)
    last = W.lifecycle_states(t).groupBy("mint").agg(F.max_by(F.struct("n", "buyers"), F.struct("us", "seq")).alias("s"))
    states = last.select("mint", W.target_state(F.col("s.n"), F.lit(0), F.col("s.buyers")).alias("lifecycle"))
    held = L.positions(t).withColumn("balance", F.col("bought") - F.col("sold")).where("balance > 0")
    shares = held.groupBy("mint").agg(F.count(F.lit(1)).alias("holder_count"), (F.max("balance") / F.sum("balance")).alias("top1_holder_pct"))
    first = t.where("side = 'buy'").groupBy("mint").agg(F.min("wallet").alias("wallet"))
    own = t.join(first, ["mint", "wallet"]).groupBy("mint").agg(F.least(F.lit(1.0), F.coalesce(F.sum(F.when(F.col("side") == "sell", F.col("tokens"))), F.lit(0.0)) / F.sum(F.when(F.col("side") == "buy", F.col("tokens")))).alias("creator_sold_pct"))
    stats = A.trade_stats(t).select("mint", "latest_price", "sells", (F.col("buys") + F.col("sells")).alias("trades"))
    reasons = stats.join(own, "mint", "left").select("mint", F.array_compact(F.array(F.when(F.col("creator_sold_pct") > 0, "DevSoldEarly"), F.when(F.col("sells") > F.col("trades") / 2, "SellsDominate"))).alias("reason_codes"))
    return U.compact_tokens(states, stats.drop("sells"), shares, own, reasons)


_POS = "coalesce(positive_outcome_label IN ('positive', 'high_positive'), false)"
_STRENGTH = "CASE k % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'POSITIVE' ELSE 'LOW' END"


def _rows(spark, sf_dir):
    return asof_rows(spark, sf_dir).withColumns({"strength": F.expr(_STRENGTH), "positive_outcome_label": F.expr("case when positive_outcome_label = 'HIGH_positive' then 'high_positive' when positive_outcome_label = 'low' and k % 3 = 0 then 'dead_negative' when positive_outcome_label = 'low' and k % 3 = 1 then 'censored' else positive_outcome_label end")})


_R = f"""{_ROWS}, b AS (SELECT * REPLACE (CASE WHEN positive_outcome_label = 'HIGH_positive' THEN 'high_positive' WHEN positive_outcome_label = 'low' AND k % 3 = 0 THEN 'dead_negative' WHEN positive_outcome_label = 'low' AND k % 3 = 1 THEN 'censored' ELSE positive_outcome_label END AS positive_outcome_label), {_STRENGTH} AS strength FROM a)"""


@query(f"""WITH {_R} SELECT count(*) AS total, count(DISTINCT mint) AS unique_mints, count(*) FILTER (clean_negative_label) AS clean_negative, count(*) FILTER (censored_label) AS censored, count(*) FILTER (clean_positive_label) AS clean_positive, count(*) FILTER (candidate_checkpoint_seen) AS candidate_checkpoint, count(*) FILTER (replay_eligible) AS replay_eligible,
    count(*) FILTER (forward_window_observed) AS forward_window_observed, count(*) FILTER (positive_outcome_label = 'positive') AS positive, count(*) FILTER (positive_outcome_label = 'high_positive') AS high_positive, count(*) FILTER ({_POS}) AS positive_or_high, count(*) FILTER (strength <> 'LOW') AS positive_or_high_strength, count(*) FILTER ({_POS} AND NOT candidate_checkpoint_seen) AS positive_not_candidates,
    count(*) FILTER (strength <> 'LOW' AND positive_outcome_label IN ('censored', 'invalid_quality')) AS strong_censored_or_invalid, count(*) FILTER ({_POS} AND replay_eligible) AS replay_eligible_positive FROM b""")
def u17_label_counts(spark, sf_dir):
    return U.label_counts(_rows(spark, sf_dir))


@query(f"""WITH {_INOUT} SELECT count(*) AS rows_scored, count(DISTINCT mint) AS unique_mints, count(*) FILTER (s) AS review_candidates, count(DISTINCT mint) FILTER (s) AS review_mints, count(*) FILTER (s AND (p OR high_positive)) AS positive_high_captured, count(*) FILTER (s AND (h OR high_positive)) AS high_captured, count(*) FILTER (decision = 'reject' AND clean_negative_label) AS dead_rejected,
    count(*) FILTER (decision IN ('censored', 'audit_only')) AS excluded, count(*) FILTER (candidate_checkpoint_seen) AS candidate_checkpoints, count(*) FILTER (replay_eligible) AS replay_eligible FROM (SELECT *, decision = 'early_burst_candidate_review' AS s, {_POS} AS p, coalesce(positive_outcome_label = 'high_positive', false) AS h FROM v0b)""")
def u19_track_metrics(spark, sf_dir):
    return U.track_metrics(G.early_burst_in_out_v0(asof_rows(spark, sf_dir)), "early_burst_candidate_review")


_COHORTS = {"promoted": "promoted", "positive_high": _POS, "dead": "clean_negative_label", "nobody": "k < 0"}
_TOKENS = {"rejected": "rejected_before_horizon", "throughput": "high_throughput_clean_observation", "never": "no_such_reason"}
_cmp = lambda name, where: f"""SELECT '{name}' AS cohort, count(*) AS rows, count(DISTINCT mint) AS unique_mints, CASE WHEN count(*) = 0 THEN 'MISSING' WHEN avg((rejected_before_horizon)::INT) >= 0.5 THEN 'HIGH' WHEN avg((rejected_before_horizon)::INT) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS rejected,
    CASE WHEN count(*) = 0 THEN 'MISSING' WHEN avg((high_throughput_before_horizon AND NOT degraded_audit_only_before_horizon)::INT) >= 0.5 THEN 'HIGH' WHEN avg((high_throughput_before_horizon AND NOT degraded_audit_only_before_horizon)::INT) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS throughput, CASE WHEN count(*) = 0 THEN 'MISSING' ELSE 'LOW' END AS never,
    coalesce((SELECT v FROM (SELECT coalesce(final_outcome, 'MISSING') AS v, count(*) AS n, min(k) AS o FROM b WHERE {where} GROUP BY 1) ORDER BY n DESC, o LIMIT 1), 'MISSING') AS outcome FROM b WHERE {where}"""  # noqa: E731


@query(f"WITH {_R} {' UNION ALL '.join(_cmp(n, w) for n, w in _COHORTS.items())}")
def u21_cohort_comparison(spark, sf_dir):
    x = _rows(spark, sf_dir).withColumn("reasons", G.codes(G.quality_codes()))
    return U.cohort_comparison(x, {n: F.expr(w) for n, w in _COHORTS.items()}, _TOKENS, {"outcome": "final_outcome"}, "k")


_BEFORE = "CASE k % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'UNSAFE' END"
_M = ["positive_high_rows", "positive_high_unique_mints", "observable_exit_window_rows", "observable_exit_window_unique_mints", "died_before_exit_window_rows", "adverse_sell_pressure_before_rows", "adverse_sell_pressure_after_rows", "holder_or_dev_risk_before_rows", "vault_curve_progress_before_rows", "high_positive_but_dead_rows"]


@query(f"""WITH {_R}, c AS (SELECT count(*) AS v1, count(DISTINCT mint) AS v2, count(*) FILTER (exit_observed) AS v3, count(DISTINCT mint) FILTER (exit_observed) AS v4, count(*) FILTER (final_outcome = 'early_rejected_dead' AND NOT exit_observed) AS v5, count(*) FILTER (k % 4 IN (1, 2)) AS v6, count(*) FILTER (mint % 4 IN (1, 2)) AS v7, count(*) FILTER (k % 4 <> 0) AS v8, count(*) FILTER (k % 4 IN (1, 2)) AS v9,
    count(*) FILTER (positive_outcome_label = 'high_positive' AND final_outcome = 'early_rejected_dead') AS v10 FROM b WHERE {_POS}) SELECT unnest({_M}) AS metric, unnest([{', '.join(f'v{i}' for i in range(1, 11))}]) AS value FROM c""")
def u22_exit_windows(spark, sf_dir):
    x = _rows(spark, sf_dir).withColumns({"sell_before": F.expr(_BEFORE), "sell_after": F.expr(_BEFORE.replace("k %", "mint %")), "holder_before": F.expr(_BEFORE), "curve_before": F.expr(_BEFORE)})
    return U.exit_windows(x)


@query(f"""WITH {_ROWS}, d AS (SELECT *, CASE WHEN terminal_inconclusive_before_horizon OR provider_gap_exposed OR relay_gap_exposed THEN 'censored' WHEN NOT horizon_reached THEN 'insufficient_data' WHEN rejected_before_horizon THEN 'avoid' ELSE 'continue_tracking' END AS e, CASE WHEN terminal_inconclusive_before_horizon THEN 'censored' WHEN provider_gap_exposed OR relay_gap_exposed THEN 'audit_only' WHEN NOT horizon_reached THEN 'insufficient_data'
        WHEN rejected_before_horizon THEN 'avoid' ELSE 'continue_tracking' END AS c, CASE k % 3 WHEN 0 THEN 'candidate_watch' WHEN 1 THEN 'candidate_review' ELSE 'censored' END AS v FROM a), r AS (SELECT unnest(list_filter([CASE WHEN NOT horizon_reached THEN 'missing_horizon' END, CASE WHEN rejected_before_horizon THEN 'rejected_before_horizon' END, CASE WHEN NOT replay_eligible THEN 'replay_not_countability_allowed' END], lambda x: x IS NOT NULL)) AS r FROM a)
    SELECT 'rows' AS metric, count(*) AS value FROM d UNION ALL SELECT 'avoided', count(*) FILTER (e = 'avoid') FROM d UNION ALL SELECT 'continued_tracking', count(*) FILTER (c = 'continue_tracking') FROM d UNION ALL SELECT 'candidate_watch', count(*) FILTER (v = 'candidate_watch') FROM d UNION ALL SELECT 'failed_candidate_eligibility', count(*) FILTER (v = 'censored') FROM d
    UNION ALL SELECT * FROM (SELECT 'failed:' || r, count(*) FROM r GROUP BY r ORDER BY 2 DESC, 1 LIMIT 2)""")
def u25_gate_funnel(spark, sf_dir):
    x = asof_rows(spark, sf_dir)
    early = G.early_avoid_v1(x).select("k", F.col("decision").alias("early"))
    cont = G.continue_v1(x).select("k", F.col("decision").alias("continued"))
    reasons = G.codes({"missing_horizon": ~F.col("horizon_reached"), "rejected_before_horizon": F.col("rejected_before_horizon"), "replay_not_countability_allowed": ~F.col("replay_eligible")})
    candidate = x.select("k", F.expr("case k % 3 when 0 then 'candidate_watch' when 1 then 'candidate_review' else 'censored' end").alias("candidate"), reasons.alias("reasons"))
    return U.gate_funnel(early.join(cont, "k").join(candidate, "k"), 2)


_CAUSES = "CASE k % 6 WHEN 0 THEN 'R2_OR_ARTIFACT_BLOCKED' WHEN 1 THEN 'SURVIVOR_GATE_MISMATCH_FOR_EARLY_BURST' WHEN 2 THEN 'MISSING_HORIZON' ELSE 'REJECTED_BEFORE_HORIZON' END"


@query(f"""WITH {_R}, c AS (SELECT *, {_CAUSES} AS rc, {_POS} OR high_positive AS p FROM b), s AS (SELECT count(*) AS rows, count(*) FILTER (p) AS positive_or_high_rows, count(*) FILTER (p AND (high_positive OR coalesce(positive_outcome_label = 'high_positive', false))) AS high_positive_rows, count(*) FILTER (candidate_checkpoint_seen) AS candidate_checkpoint_rows, count(*) FILTER (replay_eligible) AS replay_eligible_rows, count(*) FILTER (promoted) AS promoted_rows,
        count(*) FILTER (p AND r2_verified AND artifact_consistency_ok AND counted_run AND NOT provider_gap_exposed AND NOT relay_gap_exposed AND NOT terminal_inconclusive AND NOT candidate_checkpoint_seen) AS clean_blocked_rows, count(*) FILTER (rc = 'R2_OR_ARTIFACT_BLOCKED') AS collection_rows, count(*) FILTER (rc = 'SURVIVOR_GATE_MISMATCH_FOR_EARLY_BURST') AS mismatch_rows FROM c)
    SELECT *, collection_rows > 0 AND clean_blocked_rows = 0 AS collection_primary, clean_blocked_rows > 0 AS strictness_primary, clean_blocked_rows > 0 OR mismatch_rows > 0 AS separate_type_needed FROM s""")
def u26_root_causes(spark, sf_dir):
    return U.root_causes(_rows(spark, sf_dir).withColumn("root_cause", F.expr(_CAUSES)))


@query(f"""WITH {_R}, c AS (SELECT *, promoted AS up, rich_tracked AS now, coalesce(positive_outcome_label = 'high_positive', false) AS h, {_POS} AS p FROM b)
    SELECT count(*) AS shadow_rows, count(DISTINCT mint) AS shadow_mints, count(*) FILTER (h) AS high_positive_rows, count(*) FILTER (h AND up) AS high_positive_promoted, count(DISTINCT mint) FILTER (h) AS high_positive_mints, count(*) FILTER (positive_outcome_label = 'dead_negative' AND up) AS dead_promoted, count(*) FILTER (now AND NOT up) AS admitted_would_reject, count(*) FILTER (NOT now AND up) AS blocked_would_promote,
        count(*) FILTER (now AND NOT up AND p) AS rejected_later_positive, count(*) FILTER (NOT now AND up AND p) AS promoted_later_positive, count(*) FILTER (NOT now AND up AND h) AS promoted_later_high, count(*) FILTER (h AND up) = count(*) FILTER (h) AS captures_all FROM c""")
def u28_policy_comparison(spark, sf_dir):
    return U.policy_comparison(_rows(spark, sf_dir).withColumns({"promotes": F.col("promoted"), "admitted": F.col("rich_tracked")}))
