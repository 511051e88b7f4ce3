"""R1 to R14 on the library's own F columns: from the given events to decisions, with no invented rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import with_views
from ..functions.math import quotient
from ..operators import windows as W
from ..plans import families as P
from ..plans import scores as R
from ..sources.shared import cut
from . import query
from .defence import _F14, _SURVIVAL, launch_context, survival
from .research import _DECIDE, _FEATURES, _NAMES, _WHY
from .results import RESULTS

#: Features that the chain has beside F14's: of F5, F6 and F10.
_MORE = {
    "return_pct_30s": "CASE WHEN p0 > 0 THEN last / p0 - 1 END", "drawdown_from_ath_pct": "CASE WHEN ath > 0 THEN 1 - last / ath END", "organic_flow_score": "org", "buy_volume_quote": "bv", "sell_volume_quote": "sv", "dev_sold_flag": "fs IS NOT NULL", "dev_sold_pct": "sp",
    "price_drop_70pct_from_launch_within_5m": "coalesce(ob - lu <= 300000000, false) AND coalesce(greatest(0, 1 - last / fp), 0) >= 0.7", "holder_growth_stalled": "gr <= 0", "sells_dominate_after_launch": "sv > bv", "no_buys_for_x_seconds": "coalesce(ob - lbu >= 20000000, true)",
    "rug_probability_score": "least(1, sp + CASE WHEN coalesce(ob - lbu >= 20000000, true) THEN 0.3 ELSE 0 END + CASE WHEN ob - lu <= 300000000 AND 1 - last / fp >= 0.7 THEN 0.6 ELSE 0 END + CASE WHEN coalesce(top1, 0) >= 0.35 THEN 0.2 ELSE 0 END)", "rug_confidence": "least(1, n / 20)", "top1_holder_pct": "coalesce(top1, 0)",
}
_CRITICAL = ("return_pct_30s", "buy_volume_quote", "rug_probability_score")


def chained_features(spark, sf_dir):
    """F5, F6, F10, F14 and F20 of the launches, under their registered names, with what decisions read besides; what no family here gives is NULL."""
    t, anchors, held, price, flow, counts, own = launch_context(spark, sf_dir)
    supply = held.where("balance > 0").groupBy("mint").agg((F.max("balance") / F.sum("balance")).alias("top1_share"), F.count(F.lit(1)).alias("holders"))
    first = t.groupBy("mint").agg(F.min("us").alias("launch_us"), F.min_by("price", F.struct("us", "seq")).alias("p"), F.max_by("price", F.struct("us", "seq")).alias("latest_price"), F.max(F.when(F.col("side") == "buy", F.col("us"))).alias("last_buy_us"))
    x = first.join(anchors, "mint").join(price.select("mint", "return_pct_30s", "drawdown_from_ath_pct"), "mint").join(flow.select("mint", "organic_flow_score", "buy_volume_quote", "sell_volume_quote", "trade_count", "unique_buyers"), "mint").join(supply, "mint", "left").join(own, "mint", "left").join(counts, "mint")
    inputs = x.select(
        "mint", F.col("creator_first_sell_us").alias("first_sell_us"), F.col("creator_sell_percentage").alias("sold_share"), "drawdown_from_ath_pct", F.greatest(1 - quotient(F.col("latest_price"), F.col("p")), F.lit(0.0)).alias("drawdown_from_launch_pct"), "launch_us", "observed_us", F.col("holder_growth_rate").alias("growth"),
        F.col("buy_volume_quote").alias("buy_volume"), F.col("sell_volume_quote").alias("sell_volume"), "last_buy_us", "top1_share", F.col("trade_count").alias("trades"),
    )
    rug = P.rug_columns(inputs).drop("price_drop_50pct_from_ath")
    own_columns = x.select("mint", "return_pct_30s", "drawdown_from_ath_pct", "organic_flow_score", "buy_volume_quote", "sell_volume_quote", F.coalesce("top1_share", F.lit(0.0)).alias("top1_holder_pct"))
    features = cut(survival(t, anchors, held, price, flow, counts, own).join(own_columns, "mint").join(rug, "mint"), "features")
    marks = features.select("*", F.lit(False).alias("gap"), F.lit(False).alias("tentative"), F.lit("Geyser").alias("first_seen_source"))
    quality = P.data_quality(marks, critical=_CRITICAL).select("mint", "data_quality_score", "critical_feature_missing_count", "trade_allowed_data_quality_flag", "source_disagreement_flag")
    n, holders, buyers = F.col("trade_count"), F.coalesce("holders", F.lit(0)), F.col("unique_buyers")
    more = x.select("mint", "latest_price", (F.col("buy_volume_quote") + F.col("sell_volume_quote")).alias("depth_quote"), F.col("buy_volume_quote").alias("buy_volume"), F.col("sell_volume_quote").alias("sell_volume"), "unique_buyers", holders.alias("holders"), W.target_state(n, holders, buyers).alias("lifecycle"), F.lit(0.0).alias("early_level"), F.lit(0.0).alias("early_confidence"))
    all_ = features.join(quality, "mint").join(more, "mint")
    return all_.select("mint", *[F.col(c).cast("double").alias(c) if c in all_.columns else F.lit(None).cast("double").alias(c) for c in _NAMES], *more.columns[1:])


_HAS = [x.rsplit(" ", 1)[0] for x in RESULTS["f14_survival_columns"].split(", ")[1:]] + list(_MORE)
_QUALITY = {"data_quality_score": "q", "critical_feature_missing_count": "miss", "trade_allowed_data_quality_flag": "q >= 0.5", "source_disagreement_flag": "false"}
_CHAIN = "f AS (" + with_views("ev", sql=_SURVIVAL + f""",
        t AS (SELECT mint, {_F14}, {', '.join(f'{v} AS {n}' for n, v in _MORE.items())}, last AS latest_price, bv + sv AS depth_quote, ub, hn, n FROM s),
        w2 AS (SELECT *, ({' + '.join(f'({c} IS NOT NULL)::INT' for c in _HAS)}) / {len(_HAS)} AS there, {' + '.join(f'({c} IS NULL)::INT' for c in _CRITICAL)} AS miss FROM t), w3 AS (SELECT *, least(1, greatest(0, there - miss / 10)) AS q FROM w2)
        SELECT mint, {', '.join(f'CAST({_QUALITY.get(c, c) if c in _QUALITY or c in _HAS else "NULL"} AS DOUBLE) AS {c}' for c in _NAMES)}, latest_price, depth_quote, buy_volume_quote AS buy_volume, sell_volume_quote AS sell_volume, ub AS unique_buyers, hn AS holders,
            CASE WHEN n >= 4 OR hn >= 4 OR ub >= 3 THEN 'ActiveDeep' WHEN n >= 2 OR hn >= 2 THEN 'ActiveLight' ELSE 'FirstPass' END AS lifecycle, 0.0 AS early_level, 0.0 AS early_confidence FROM w3""") + ")"


@query(f"WITH {_DECIDE.replace(_FEATURES, _CHAIN)} SELECT mint, rug, bundle, dev, top_holder, fake_momentum, data_quality, overall, policy, strategy, eligibility, net_edge_quote, decision, blocked_by, {_WHY} AS decision_reasons FROM d")
def chained_decisions(spark, sf_dir):
    x = R.decide(R.composites(R.risks(chained_features(spark, sf_dir))))
    return x.select("mint", *R.RISKS, "overall", "policy", "strategy", "eligibility", "net_edge_quote", "decision", "blocked_by", F.array_join("decision_reasons", "|").alias("decision_reasons"))
