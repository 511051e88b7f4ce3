"""Tentative sells judged before they are confirmed, what became of them, and a mint's defence against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.math import clamp01, impact_pct
from .joins import duplicate_intents

# Classes of sellers and the least impact (per cent) at which a sell of theirs is to be fled from; whose sell no
# absorption makes good; what a warning of theirs is called; levels in order; and the limits of the published configuration.
THRESHOLDS = {"dev": 5.0, "devcluster": 5.0, "top1holder": 10.0, "top3holder": 10.0, "top5holder": 10.0, "top10holder": 10.0, "bundlewallet": 12.0, "bundlecluster": 12.0, "whale": 15.0}
CATASTROPHIC = ["dev", "devcluster", "top1holder", "top3holder", "bundlewallet", "bundlecluster", "samefundercluster"]
GROUPS = {"dev": ["dev", "devcluster"], "top_holder": ["top1holder", "top3holder", "top5holder", "top10holder"], "bundle": ["bundlewallet", "bundlecluster"], "whale": ["whale"]}
CODES = {"dev": "shred_dev_sell_warning", "top_holder": "shred_top_holder_sell_warning", "bundle": "shred_bundle_exit_warning", "whale": "shred_whale_dump_warning"}
LEVELS = ["info", "watch", "exit_armed", "emergency_exit_recommended", "emergency_exit_required"]
WARN_CONFIDENCE, ARM_CONFIDENCE, EXIT_CONFIDENCE = 0.55, 0.70, 0.82
WARN_IMPACT, ARM_IMPACT, EXIT_IMPACT = 8.0, 15.0, 25.0
LEAST_SAVED, LEAST_BENEFIT, LEAST_EDGE, ABSORBED = 0.02, 0.01, 1.10, 0.75
TTL_US, SLOTS, AMOUNT = 5_000_000, 0, 0.05

#: What `detect` reads of each tentative sell, besides its key.
INPUTS = {
    "sell": ["id", "mint", "seller", "slot", "us", "signature", "source", "token_in", "quote_out", "price_before", "price_after", "decode_confidence", "partial", "is_creator", "is_top_holder", "top_rank", "latency_ms"],
    "threat": ["threat_class", "holding_pct", "balance", "full_exit_impact_pct"],
    "token": ["latest_price", "depth", "lead_ms", "absorption", "stickiness", "growth"],
    "position": ["size_quote", "size_tokens"],
}


def slot_impacts(sells: DataFrame) -> DataFrame:
    """Adds impact_pct (own `impact` and what is pending in the mint's slot, 100 at most) and slot_before (pending sells of the slot).

    A pending sell weighs with its own impact_pct, so sums double from sell to sell: the n-th has its impact and the
    earlier ones' times 2^(n-1-k), which a running sum of impact / 2^k gives. Copies weigh nothing. What is resolved
    within its own slot still counts in it.
    """
    order = Window.partitionBy("mint", "slot").orderBy("us", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counts = F.when(F.col("original").isNull(), 1).otherwise(0)
    x = sells.withColumn("slot_before", F.coalesce(F.sum(counts).over(before), F.lit(0)))
    weight = F.when(F.col("original").isNull(), F.col("impact") / F.pow(F.lit(2.0), F.col("slot_before")))
    small = F.coalesce(F.sum(F.when(F.col("slot_before") < 900, weight)).over(before), F.lit(0.0)) * F.pow(F.lit(2.0), F.least(F.col("slot_before"), F.lit(900)) - 1)
    late = (F.col("slot_before") > 900) & F.coalesce(F.max(F.when(F.col("original").isNull(), F.col("impact"))).over(before) > 0, F.lit(False))
    return x.withColumn("impact_pct", F.when(late, 100.0).otherwise(F.least(F.col("impact") + small, F.lit(100.0))))


def detect(sells: DataFrame, exit_impact: float = EXIT_IMPACT, exit_confidence: float = EXIT_CONFIDENCE, arm_without_benefit: bool = True) -> DataFrame:
    """One row a tentative sell with its copy (original), estimates, costs and benefits, warning level, reasons, and whether an exit is armed and triggered.

    sells: the columns of INPUTS; threat columns are null for sellers outside the index, position columns without a position.
    A copy of an earlier intent (same signature; or, where one has none, same seller and slot and an amount within AMOUNT) has its
    estimates, but no level of its own: level, reasons, armed and triggered are null, and it is pending nowhere.
    """
    as_intents = sells.select("id", "mint", "signature", F.col("seller").alias("wallet"), (F.col("slot") * 2 * (SLOTS + 1)).alias("us"), F.col("token_in").alias("quote"))
    copies = duplicate_intents(as_intents, 2 * SLOTS + 1, AMOUNT)
    c, k = F.col, lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    indexed = c("threat_class").isNotNull()
    kind = F.coalesce("threat_class", F.when(c("is_creator"), "dev").when(c("is_top_holder"), "top3holder").otherwise("unknown"))
    decode = F.when(c("partial"), F.greatest(c("decode_confidence") - 0.25, F.lit(0.0))).otherwise(c("decode_confidence"))
    account = (
        F.when(c("is_creator"), 0.92).when(c("is_top_holder") | c("top_rank").isNotNull(), 0.85).when(indexed, F.when(c("balance") > 0, 0.85).otherwise(0.60)).when((c("token_in") > 0) & (c("quote_out") > 0), 0.60).otherwise(0.55)
    )
    decoded = F.coalesce(impact_pct(c("price_before"), c("price_after")), F.lit(0.0))
    fallback = F.least(F.greatest(c("quote_out"), c("token_in") * c("latest_price")) / F.greatest(c("depth"), F.lit(1.0)), F.lit(1.0)) * 100
    own = F.when(~indexed, fallback).when(c("balance") > 0, c("full_exit_impact_pct") * F.least(c("token_in") / c("balance"), F.lit(1.0))).otherwise(c("full_exit_impact_pct"))
    x = sells.join(copies, "id", "left").withColumns({"seller_class": kind, "decoded_confidence": decode, "account_confidence": account, "impact": F.greatest(own, decoded)})
    x = slot_impacts(x)
    grave = c("seller_class").isin(CATASTROPHIC)
    share = c("impact_pct") / 100
    x = x.withColumns({
        "confidence": F.least("decoded_confidence", "account_confidence"), "grave": grave, "latency_edge_ratio": F.greatest(k("latency_ms"), F.lit(0.0)) / F.greatest(k("lead_ms"), F.lit(1.0)), "held": c("size_quote").isNotNull(),
        "absorption_health_score": k("absorption"), "post_sell_absorption_probability": clamp01(k("absorption") + k("stickiness") / 3 + k("growth") / 4),
    })
    edge = clamp01(c("latency_edge_ratio"))
    kept = F.when(c("grave"), 1.0).otherwise(F.least(F.greatest(1 - c("absorption_health_score"), F.lit(0.1)), F.lit(1.0)))
    penalty = F.when(~c("grave") & (c("absorption_health_score") >= ABSORBED), k("size_quote") * c("absorption_health_score") * 0.2).otherwise(F.lit(0.0))
    x = x.withColumns({
        "can_land": c("latency_edge_ratio") >= LEAST_EDGE, "expected_saved_loss": F.when(k("size_quote") > 0, k("size_quote") * share * edge * clamp01(share) * kept).otherwise(F.lit(0.0)),
        "expected_opportunity_cost": F.when(k("size_quote") > 0, k("size_quote") * exit_impact / 100 + penalty).otherwise(F.lit(0.0)),
        "net_benefit_confidence": clamp01(c("confidence") * edge * (1 - c("post_sell_absorption_probability") / 2)),
    }).withColumn("net_benefit", c("expected_saved_loss") - c("expected_opportunity_cost"))
    pays = (c("expected_saved_loss") >= LEAST_SAVED) & (c("net_benefit") >= LEAST_BENEFIT)
    least = F.coalesce(F.create_map(*[F.lit(v) for kv in THRESHOLDS.items() for v in kv])[c("seller_class")], F.lit(WARN_IMPACT))
    asked = (
        F.when(c("confidence") < WARN_CONFIDENCE, 0)
        .when((c("confidence") >= EXIT_CONFIDENCE) & (c("impact_pct") >= F.greatest(F.lit(exit_impact), least)), 4)
        .when((c("confidence") >= ARM_CONFIDENCE) & (c("impact_pct") >= F.greatest(F.lit(ARM_IMPACT), least)), 2)
        .when(c("impact_pct") >= F.least(F.lit(WARN_IMPACT), least), 1)
        .otherwise(0)
    )
    lower = (~c("grave") & ((c("absorption_health_score") >= ABSORBED) | ~c("can_land"))) | (c("held") & ~pays)
    x = x.withColumn("asked", asked).withColumn("rank", F.when((c("asked") >= 3) & lower, 2 if arm_without_benefit else 1).otherwise(c("asked")))
    group = lambda g: c("seller_class").isin(GROUPS[g])
    reasons = F.array_compact(F.array(
        F.when(c("source") == "deshredpreexecution", "deshred_pre_execution_sell_warning").otherwise("early_intent_sell_warning"), F.coalesce(*[F.when(group(g), code) for g, code in CODES.items()]),
        F.when(c("rank") >= 2, "shred_exit_armed"), F.when(c("decoded_confidence") < WARN_CONFIDENCE, "shred_low_confidence"), F.when(c("slot_before") > 0, "shred_same_slot_sell_cluster"), F.when(~c("can_land"), "shred_signal_stale"),
    ))
    fresh = c("original").isNull()
    triggered = c("held") & (c("confidence") >= exit_confidence) & (c("impact_pct") >= exit_impact) & pays & (c("rank") >= 3)
    price = F.coalesce("price_before", "latest_price")
    return x.select(
        "id", "mint", "seller", "slot", "us", "signature", "source", "original", "token_in", "quote_out", "seller_class", "decoded_confidence", "account_confidence", "confidence", F.coalesce("balance", "token_in").alias("seller_balance"), k("holding_pct").alias("seller_holding_pct"), c("impact").alias("own_impact_pct"), "impact_pct", "slot_before",
        price.alias("price_before"), F.coalesce("price_after", c("latest_price") * F.greatest(1 - c("impact_pct") / 100, F.lit(0.0))).alias("price_after"), "latency_edge_ratio", "can_land", F.greatest(k("latency_ms"), F.lit(0.0)).cast("long").alias("latency_advantage_ms"), F.greatest(k("lead_ms"), F.lit(1.0)).cast("long").alias("required_latency_ms"),
        "absorption_health_score", "post_sell_absorption_probability", "expected_saved_loss", "expected_opportunity_cost", "net_benefit", "net_benefit_confidence", F.when(fresh, c("rank")).alias("level"), F.when(fresh, F.element_at(F.array(*[F.lit(v) for v in LEVELS]), c("rank") + 1)).alias("risk_level"),
        F.when(fresh, F.array_join(reasons, "|")).alias("reasons"), F.when(fresh, c("held") & (c("rank") >= 2)).alias("armed"), F.when(fresh, triggered).alias("triggered"), F.when(fresh, c("us") + TTL_US).alias("expires_us"), "size_quote", "size_tokens",
    )


# Events that resolve a sell, by precedence at one time, and the outcomes they stand for.
OUTCOMES = {"reverted": "reorged", "executed": "confirmed_executed", "failed": "confirmed_failed", "balance": "account_effects_observed", "rooted": "rooted_executed", "mismatch": "decode_mismatch"}
FALSE = ["reorged", "confirmed_failed", "decode_mismatch", "not_seen_within_ttl"]


def resolve(found: DataFrame, events: DataFrame, prices: DataFrame, ttl_us: int = TTL_US) -> DataFrame:
    """(id, mint, us, outcome, false_positive, saved, latency_ms) of every sell that isn't a copy, at the time it is resolved.

    events: mint, seller, us, kind (of OUTCOMES), price_after. The first within ttl_us resolves a sell; at one time, the
    first of OUTCOMES. What none resolves expires; prices (mint, us, price) then say what leaving too early has cost.
    Events meet sells of the same mint and seller in stretches of ttl_us.
    """
    own = found.where("original is null").select("id", "mint", "seller", "us", "price_before", "triggered", "size_tokens").withColumn("b", F.explode(F.expr(f"array(us div {ttl_us}, us div {ttl_us} + 1)")))
    order = F.array_position(F.array(*[F.lit(v) for v in OUTCOMES]), F.col("kind"))
    near = events.select("mint", "seller", F.col("us").alias("e_us"), "kind", F.col("price_after").alias("e_price"), F.expr(f"us div {ttl_us}").alias("b"))
    met = own.join(near, ["mint", "seller", "b"]).where(f"e_us > us and e_us <= us + {ttl_us}").groupBy("id").agg(F.min(F.struct("e_us", order.alias("o"), "kind", "e_price")).alias("e"))
    x = found.where("original is null").join(met, "id", "left")
    outcome = F.coalesce(F.create_map(*[F.lit(v) for kv in OUTCOMES.items() for v in kv])[F.col("e.kind")], F.lit("not_seen_within_ttl"))
    x = x.select("id", "mint", F.coalesce("e.e_us", F.col("us") + ttl_us).alias("r_us"), "us", outcome.alias("outcome"), "price_before", "triggered", F.col("size_tokens").cast("double").alias("size"), F.col("e.e_price").alias("e_price"))
    # the latest price at the time of expiry, by one union and one window
    asks = x.select("mint", F.col("r_us").alias("t"), F.lit(None).cast("double").alias("p"), "id")
    ticks = prices.groupBy("mint", "us").agg(F.max("price").alias("p")).select("mint", F.col("us").alias("t"), "p", F.lit(None).cast(found.schema["id"].dataType).alias("id"))
    upto = Window.partitionBy("mint").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    latest = ticks.union(asks).withColumn("p", F.last("p", ignorenulls=True).over(upto)).where("id is not null").select("id", F.col("p").alias("latest"))
    x = x.join(latest, "id", "left")
    loss = F.when(F.col("triggered") & (F.col("price_before") > F.col("e_price")), (F.col("price_before") - F.col("e_price")) * F.col("size")).otherwise(F.lit(0.0))
    missed = F.when(F.col("triggered") & (F.col("latest") > F.col("price_before")), (F.col("price_before") - F.col("latest")) * F.col("size")).otherwise(F.lit(0.0))
    saved = F.when(F.col("outcome").isin("confirmed_executed", "confirmed_failed"), loss).when(F.col("outcome") == "not_seen_within_ttl", missed).otherwise(F.lit(0.0))
    return x.select("id", "mint", F.col("r_us").alias("us"), "outcome", F.col("outcome").isin(FALSE).alias("false_positive"), saved.alias("saved"), F.expr("(r_us - us) div 1000").alias("latency_ms"))


def defence_columns(found: DataFrame, resolved: DataFrame, threats: DataFrame) -> DataFrame:
    """F21, 30 columns, as of every sell and every resolution of a mint; threats: mint, max_impact_pct, lead_ms.

    All are running folds over a mint's events in order of time (at one time sells before resolutions, then id).
    """
    kinds = {n: t for n, t in found.dtypes}
    empty = lambda n, t: F.lit(None).cast(t).alias(n)
    sell = ["seller_class", "quote_out", "impact_pct", "decoded_confidence", "confidence", "level", "reasons", "armed", "triggered", "can_land", "expected_saved_loss", "original"]
    ends = {"outcome": "string", "false_positive": "boolean", "saved": "double", "latency_ms": "bigint"}
    a = found.select("mint", "us", F.lit(0).alias("step"), "id", *sell, *[empty(n, t) for n, t in ends.items()])
    b = resolved.select("mint", "us", F.lit(1).alias("step"), "id", *[empty(n, kinds[n]) for n in sell], *ends)
    upto = Window.partitionBy("mint").orderBy("us", "step", "id").rowsBetween(Window.unboundedPreceding, 0)
    c, is_sell = F.col, F.col("step") == 0
    warned = is_sell & c("level").isNotNull()
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long")).over(upto)
    total = lambda v: F.coalesce(F.sum(v).over(upto), F.lit(0.0))
    last = lambda cond, v: F.last(F.when(cond, v), ignorenulls=True).over(upto)
    of = lambda g: count(warned & c("seller_class").isin(GROUPS[g]))
    took = lambda *o: last(c("outcome").isin(*o), c("latency_ms"))
    top = F.max("decoded_confidence").over(upto)
    x = a.union(b).withColumns({
        "n": count(is_sell), "volume": total("quote_out"), "dev": of("dev"), "holder": of("top_holder"), "bundle": of("bundle"), "whale": of("whale"), "cluster": count(warned & F.array_contains(F.split("reasons", r"\|"), "shred_same_slot_sell_cluster")),
        "impact_max": F.coalesce(F.max("impact_pct").over(upto), F.lit(0.0)), "impact_sum": total("impact_pct"), "conf_max": F.coalesce(top, F.lit(0.0)), "conf_mean": F.coalesce(F.avg("decoded_confidence").over(upto), F.lit(0.0)), "warned_level": F.coalesce(last(warned, c("level")), F.lit(0)),
        # armed until the next resolution
        "is_armed": F.coalesce(F.last(F.when(c("step") == 1, False).when(c("armed"), True), ignorenulls=True).over(upto), F.lit(False)), "was_triggered": F.coalesce(F.max(c("triggered").cast("int")).over(upto) == 1, F.lit(False)),
        "processed": took("confirmed_executed"), "effect": took("account_effects_observed"), "rooted": took("rooted_executed"), "wrong": count(c("false_positive")), "estimate": F.coalesce(last(c("triggered"), c("expected_saved_loss")), F.lit(0.0)), "realised": total(F.when(c("outcome") == "confirmed_executed", c("saved"))),
        "cost": total(F.when(c("false_positive"), F.abs("saved"))), "stale": F.coalesce(last(warned, ~c("can_land")), F.lit(False)), "intent": F.coalesce(last(warned, clamp01(c("impact_pct") / 100 + c("confidence") / 2)), F.lit(0.0)),
        "sure": F.coalesce(last(is_sell, F.when(warned, c("confidence")).otherwise(top)), F.lit(0.0)),
    }).join(threats, "mint", "left")
    x = x.withColumn("score", clamp01(F.coalesce("max_impact_pct", F.lit(0.0)) / 100))
    rate = F.when(c("n") > 0, c("wrong") / c("n")).otherwise(F.lit(0.0))
    zero = lambda n: F.coalesce(c(n), F.lit(0)).cast("long")
    return x.select(
        "mint", "us", "step", "id", c("n").alias("tentative_sell_count_window"), c("volume").alias("tentative_sell_volume_quote_window"), c("dev").alias("tentative_sell_from_dev_count"), c("holder").alias("tentative_sell_from_top_holder_count"), c("bundle").alias("tentative_sell_from_bundle_count"), c("whale").alias("tentative_sell_from_whale_count"),
        c("cluster").alias("tentative_sell_same_slot_cluster_count"), c("impact_max").alias("tentative_sell_impact_max_pct"), c("impact_sum").alias("tentative_sell_impact_sum_pct"), c("conf_max").alias("tentative_sell_confidence_max"), c("conf_mean").alias("tentative_sell_confidence_mean"), c("warned_level").alias("shred_sell_warning_level"),
        c("is_armed").alias("shred_exit_armed_flag"), c("was_triggered").alias("shred_emergency_exit_triggered_flag"), zero("processed").alias("shred_to_geyser_processed_ms"), zero("effect").alias("shred_to_account_effect_confirmation_ms"), zero("rooted").alias("shred_to_rooted_confirmation_ms"),
        rate.alias("shred_sell_false_positive_rate_wallet"), rate.alias("shred_sell_false_positive_rate_source"), c("estimate").alias("shred_sell_saved_loss_estimate"), c("realised").alias("shred_sell_saved_loss_realized"), c("cost").alias("shred_exit_opportunity_cost"), c("stale").alias("shred_signal_stale_flag"),
        zero("lead_ms").alias("shred_exit_latency_budget_ms"), F.coalesce("processed", "effect", "rooted", F.lit(0)).cast("long").alias("shred_exit_latency_used_ms"), F.greatest(c("estimate") + c("realised") - c("cost"), F.lit(0.0)).alias("shred_exit_edge_score"), c("intent").alias("malicious_sell_intent_score"), c("sure").alias("preconfirmation_exit_confidence"),
        c("score").alias("dangerous_seller_precomputed_impact_score"), c("score").alias("exit_threat_index_score"),
    )


def threat_index(threats: DataFrame) -> DataFrame:
    """(mint, max_impact_pct, lead_ms) of the index's sellers (mint, full_exit_impact_pct): the worst exit, and how early it has to be known."""
    x = threats.groupBy("mint").agg(F.max("full_exit_impact_pct").alias("max_impact_pct"))
    return x.withColumn("lead_ms", F.when(F.col("max_impact_pct") >= EXIT_IMPACT, 120).otherwise(350).cast("long"))
