"""how a mint survives its large sells, and who stands behind its rise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.math import clamp01, weighted
from ..operators.joins import side_by_side
from ..sources.shared import cut, spread

SECOND = 1_000_000


def sell_episodes(trades: DataFrame, large: float) -> DataFrame:
    """(mint, episode, us, price, buys, volume, buyers, recovery_us, end_us): each sell of `large` or more opens an episode.

    It closes with the first buy at its price or above, or with the next large sell; buys count up to there.
    """
    order = Window.partitionBy("mint").orderBy("us", "seq")
    opens = (F.col("side") == "sell") & (F.col("quote") >= large)
    x = trades.withColumns({"episode": F.sum(opens.cast("long")).over(order), "floor": F.last(F.when(opens, F.col("price")), ignorenulls=True).over(order), "opens": opens}).where("episode > 0")
    x = x.withColumn("back", (F.col("side") == "buy") & (F.col("price") >= F.col("floor")))
    earlier = Window.partitionBy("mint", "episode").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("over", F.coalesce(F.max(F.col("back").cast("int")).over(earlier), F.lit(0))).where("over = 0")
    buy = (F.col("side") == "buy") & ~F.col("opens")
    return x.groupBy("mint", "episode").agg(
        F.min(F.when(F.col("opens"), F.col("us"))).alias("us"), F.max("floor").alias("price"), F.count_if(buy).alias("buys"), F.coalesce(F.sum(F.when(buy, F.col("quote"))), F.lit(0.0)).alias("volume"), F.count_distinct(F.when(buy, F.col("wallet"))).alias("buyers"),
        F.min(F.when(F.col("back"), F.col("us"))).alias("back_us"), F.max("us").alias("end_us"),
    ).select("mint", "episode", "us", "price", "buys", "volume", "buyers", (F.col("back_us") - F.col("us")).alias("recovery_us"), "end_us")


def absorption_success(trades: DataFrame, large: float) -> DataFrame:
    """(mint, absorption_success_score) of `survival_columns` over whole mints, where no other of its columns is wanted."""
    hits = trades.where((F.col("side") == "sell") & (F.col("quote") >= large)).groupBy("mint").agg(F.min("us").alias("hit"))
    after = trades.where("side = 'buy'").join(hits, "mint").where("us > hit").groupBy("mint").agg(F.count_distinct("wallet").alias("buyers_after"))
    return after.select("mint", clamp01(F.col("buyers_after") / F.lit(5.0)).alias("absorption_success_score"))


def survival_columns(trades: DataFrame, anchors: DataFrame, held: DataFrame, context: DataFrame, large: float = 5.0, short: int = 5, long: int = 30) -> DataFrame:
    """F14, 29 columns, at each mint's observed_us; NULL where there was no large sell to speak of.

    anchors: mint, observed_us; held: mint, wallet, balance; context: mint, return_pct_30s, holder_growth_rate,
    organic_flow_score, creator_first_sell_us, creator_sell_percentage, holders_1m (missing counts as 0; holders_1m as today's).
    Trades are summed by wallet first, so that a mint with many trades is not one task; `short`, `long`: seconds of the windows of buyers.
    Trades, holders and sums are written between the steps, so that no task holds the sorts of all of them; wallets' sums
    take as many tasks as trades need.
    """
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    x = trades.join(anchors, "mint").where("us <= observed_us")
    hits = x.where(sell & (F.col("quote") >= large)).groupBy("mint").agg(F.min(F.struct("us", "seq", "price")).alias("hit"))
    x = cut(x.join(hits, "mint", "left").select("mint", "wallet", "side", "us", "seq", "quote", "price", "observed_us", "hit"), "trades")
    x = spread(x, x.count(), "mint", "wallet")
    held = cut(held.where("balance > 0").select("mint", "wallet", "balance"), "held")
    after = buy & (F.col("us") > F.col("hit.us"))
    at = F.struct("us", "seq", "price")
    by = x.groupBy("mint", "wallet", "observed_us", "hit").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"), F.sum(F.when(buy, F.col("quote"))).alias("bought"), F.sum(F.when(sell, F.col("quote"))).alias("sold"), F.max(F.when(buy, F.col("quote"))).alias("top_buy"),
        F.count_if(buy & (F.col("quote") >= large)).alias("large_buys"), F.count_if(sell & (F.col("quote") >= large)).alias("large_sells"), F.sum(F.when(sell & (F.col("quote") >= large), F.col("quote"))).alias("large_sold"),
        F.max(F.when(buy, F.col("us"))).alias("last_buy"), F.count_if(after).alias("buys_after"), F.sum(F.when(after, F.col("quote"))).alias("bought_after"), F.min(F.when(after & (F.col("price") >= F.col("hit.price")), at)).alias("back"), F.max(at).alias("last"), F.max("price").alias("high"),
    )
    first = x.where(buy).withColumn("r", F.row_number().over(Window.partitionBy("mint").orderBy("us", "seq"))).where("r <= 8").select("mint", "wallet", F.lit(1).alias("early")).distinct()
    ranked = held.withColumn("r", F.row_number().over(Window.partitionBy("mint").orderBy(F.desc("balance"), "wallet")))
    top = ranked.where("r <= 5").select("mint", "wallet", F.lit(1).alias("top"), "r", "balance")
    supply = held.groupBy("mint").agg(F.sum("balance").alias("supply"), F.count(F.lit(1)).alias("holders"))
    shares = top.join(supply, "mint").groupBy("mint", "holders").agg((F.sum(F.when(F.col("r") <= 3, F.col("balance"))) / F.max("supply")).alias("top3"), (F.sum("balance") / F.max("supply")).alias("top5"))
    by = by.join(top.select("mint", "wallet", "top"), ["mint", "wallet"], "left").join(first, ["mint", "wallet"], "left")
    recent = lambda s: F.count_if(F.col("last_buy") >= F.col("observed_us") - s * SECOND)
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    y = cut(by.groupBy("mint", "observed_us", "hit").agg(
        F.sum("n").alias("n"), F.sum("buys").alias("buys"), z("bought").cast("double").alias("bought"), z("sold").cast("double").alias("sold"), F.coalesce(F.max("top_buy"), F.lit(0.0)).alias("top_buy"), F.sum("large_buys").alias("large_buys"), F.sum("large_sells").alias("large_sells"), z("large_sold").cast("double").alias("large_sold"),
        F.count_if(F.col("buys") > 0).alias("buyers"), F.count_if(F.col("buys_after") > 0).alias("buyers_after"), F.sum("buys_after").alias("buys_after"), z("bought_after").cast("double").alias("bought_after"), F.min("back").alias("back"), F.max("last").alias("last"), F.max("high").alias("high"),
        recent(long).alias("long_buyers"), recent(short).alias("short_buyers"), z(F.when(F.col("top") == 1, F.col("sells"))).alias("top_sells"), z(F.when(F.col("early") == 1, F.col("sells"))).alias("early_sells"),
    ), "sums")
    y = y.join(side_by_side([shares, context], "mint"), "mint", "left").fillna(0, ["holders", "top3", "top5"])
    c = F.col
    k = lambda n: F.coalesce(c(n).cast("double"), F.lit(0.0))
    hit = c("hit").isNotNull()
    up, few = k("return_pct_30s") > 0, c("buyers") <= 2
    part = F.when(c("bought") > 0, c("top_buy") / c("bought")).otherwise(F.lit(0.0))
    absorbed = F.when(hit, clamp01(c("buyers_after") / F.lit(5.0))).otherwise(F.lit(0.0))
    breadth = up & few & (c("buys") >= 2)
    top_selling, early_selling = up & (c("top_sells") > 0), up & (c("early_sells") > 0)
    one_or_two = up & c("large_buys").between(1, 2) & (part >= 0.55) & few
    d = lambda b: b.cast("double")
    doubt = weighted([(d(breadth), 0.35), (d(one_or_two), 0.35), (d(top_selling), 0.15), (d(early_selling), 0.15)])
    authentic = clamp01(weighted([(k("organic_flow_score"), 0.35), (F.greatest(k("holder_growth_rate"), F.lit(0.0)), 0.25), (clamp01(c("buyers") / F.lit(6.0)), 0.15), (1 - doubt, 0.25)]) - k("creator_sell_percentage"))
    steady = k("return_pct_30s") >= 0
    return y.select(
        "mint", c("large_sells").alias("large_sell_count"), c("large_sold").alias("large_sell_total_quote"), F.when(hit & (c("high") > 0), clamp01(F.abs(c("hit.price") - c("last.price")) / c("high"))).alias("price_impact_of_large_sells"),
        F.expr("(back.us - hit.us) div 1000").alias("recovery_after_large_sell_ms"), F.when(c("back").isNotNull() & (c("hit.price") > 0), clamp01((c("back.price") - c("hit.price")) / c("hit.price"))).alias("recovery_after_large_sell_pct"),
        F.when(hit, c("buys_after")).alias("buyers_after_large_sell_count"), F.when(hit, c("buyers_after")).alias("unique_buyers_after_large_sell"), F.when(hit, c("bought_after")).alias("buy_volume_after_large_sell"), F.when(hit, c("holders")).alias("holder_count_after_large_sell"),
        absorbed.alias("absorption_success_score"), (1 - absorbed).alias("absorption_failure_score"), F.greatest(c("large_sells") - 1, F.lit(0)).alias("repeated_absorption_count"), clamp01(c("top3") * 2 / 3).alias("distribution_into_buyers_score"),
        ((F.abs(k("return_pct_30s")) <= 0.05) & (c("bought") + c("sold") >= 10) & (c("top_sells") > 0)).alias("price_flat_volume_high_distribution_warning"),
        ((k("return_pct_30s") >= 0.5) & (k("holder_growth_rate") <= 0) & few & (c("holders") <= 2)).alias("vertical_move_without_holder_growth"), ((k("return_pct_30s") >= 0.5) & few).alias("vertical_move_without_unique_buyers"),
        top_selling.alias("price_up_top_holders_selling"), early_selling.alias("price_up_bundle_selling"), (up & c("creator_first_sell_us").isNotNull()).alias("price_up_dev_selling"), (up & (c("short_buyers") < c("long_buyers"))).alias("price_up_unique_buyers_down"),
        (up & (c("holders") < F.coalesce("holders_1m", "holders"))).alias("price_up_holder_count_down"), (part >= 0.6).alias("price_up_buy_size_concentration_high"), one_or_two.alias("price_up_only_one_or_two_large_buys"), breadth.alias("price_up_no_retail_breadth"),
        authentic.alias("momentum_authenticity_score"), (clamp01(d(top_selling) + d(early_selling) + d(one_or_two)) / 3).alias("exit_liquidity_trap_score"), (c("creator_first_sell_us").isNull() & steady).alias("dev_not_selling_while_price_up"),
        (clamp01(authentic + absorbed + (1 - c("top5")) + F.when(steady, 0.2).otherwise(0.0)) / 3).alias("organic_survival_score"), clamp01(F.least(c("n"), F.lit(20)) / F.lit(20.0)).alias("anti_rug_confidence_score"),
    )
