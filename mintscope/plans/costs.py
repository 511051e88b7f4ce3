"""Fee, impact and profit columns of orders and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import LAMPORTS_PER_SOL

# The default fee schedule.
FEES = {"base_lamports": 5_000, "compute_limit": 300_000, "compute_price": 50_000, "tip_lamports": 0, "rent_lamports": 0, "creator_bps": 30, "protocol_bps": 95, "lp_bps": 0, "slippage_bps": 100, "failed_lamports": 5_000}


def fees(notional: Column, failed=False, fee: dict = FEES) -> dict[str, Column]:
    """Parts of an order's fee in quote units, and their sum."""
    sol = lambda lamports: F.lit(lamports / LAMPORTS_PER_SOL)
    failed = failed if isinstance(failed, Column) else F.lit(failed)
    parts = {
        "base_fee": sol(fee["base_lamports"]),
        "priority_fee": sol(-(-fee["compute_limit"] * fee["compute_price"] // 1_000_000)),
        "tip": sol(fee["tip_lamports"]),
        "rent": sol(fee["rent_lamports"]),
        "creator_fee": notional * fee["creator_bps"] / F.lit(10_000.0),
        "protocol_fee": notional * fee["protocol_bps"] / F.lit(10_000.0),
        "lp_fee": notional * fee["lp_bps"] / F.lit(10_000.0),
        "failed_fee": F.when(failed, sol(fee["failed_lamports"])).otherwise(F.lit(0.0)),
    }
    return parts | {"total_fee": sum(list(parts.values())[1:], parts["base_fee"])}


def fill_price(side: Column, price: Column, notional: Column, depth: Column, fee: dict = FEES) -> tuple[Column, Column]:
    """(price after impact and slippage, impact): a buy's price is multiplied, a sell's divided."""
    impact = F.when(depth > 0, F.greatest(F.lit(0.0), F.try_divide(notional, depth))).otherwise(F.lit(1.0))
    up = 1 + impact + fee["slippage_bps"] / 10_000
    return F.when(side == "buy", price * up).otherwise(price / up), impact


def orders(x: DataFrame, fee: dict = FEES) -> DataFrame:
    """Adds price, size and fees to orders (side, size, price, depth, failed); size is quote for buys and tokens for sells."""
    buy = F.col("side") == "buy"
    reference = F.when(buy, F.col("size")).otherwise(F.col("size") * F.col("price"))
    filled, impact = fill_price(F.col("side"), F.col("price"), reference, F.col("depth"), fee)
    x = x.withColumns({"fill_price": filled, "impact": impact})
    x = x.withColumn("notional", F.when(buy, F.col("size")).otherwise(F.col("size") * F.col("fill_price")))
    got = F.when(F.col("failed") | (F.col("fill_price") <= 0), F.lit(0.0)).when(buy, F.try_divide(F.col("size"), F.col("fill_price"))).otherwise(F.col("size"))
    return x.withColumns({"filled": got, **fees(F.col("notional"), F.col("failed"), fee)})


def trip(size: Column, entry: Column, exit_: Column, depth: Column, fee: dict = FEES) -> dict[str, Column]:
    """Columns of a round trip, buy at entry and sell all at exit: tokens, proceeds, fees, impacts of both orders, gross and net profit."""
    bought, buy_impact = fill_price(F.lit("buy"), entry, size, depth, fee)
    tokens = size / bought
    sold, sell_impact = fill_price(F.lit("sell"), exit_, tokens * exit_, depth, fee)
    proceeds = tokens * sold
    total = fees(size, False, fee)["total_fee"] + fees(proceeds, False, fee)["total_fee"]
    return {"tokens": tokens, "proceeds": proceeds, "fees": total, "buy_impact": buy_impact, "sell_impact": sell_impact, "gross_pnl": proceeds - size, "net_pnl": proceeds - size - total}


def round_trips(x: DataFrame, fee: dict = FEES) -> DataFrame:
    """Adds gross and net profit to intents (size, entry_price, exit_price, depth): buy at entry, sell all at exit."""
    t = trip(F.col("size"), F.col("entry_price"), F.col("exit_price"), F.col("depth"), fee)
    x = x.withColumn("tokens", t["tokens"]).withColumn("proceeds", t["proceeds"])
    total = fees(F.col("size"), False, fee)["total_fee"] + fees(F.col("proceeds"), False, fee)["total_fee"]
    gross = F.col("proceeds") - F.col("size")
    slip = (F.col("size") + F.col("proceeds")) * (fee["slippage_bps"] / 10_000)
    return x.withColumns({"gross_pnl": gross, "fees": total, "net_pnl": gross - total, "slippage_cost": slip})


def backtest(trips: DataFrame) -> DataFrame:
    return trips.agg(F.count(F.lit(1)).alias("trades"), F.sum("gross_pnl").alias("total_pnl"), F.sum("net_pnl").alias("net_pnl"), F.sum("fees").alias("fee_drag"), F.sum("slippage_cost").alias("slippage_drag"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("hit_rate"))


def mark_to_market(entries: DataFrame, exits: DataFrame, prices: DataFrame) -> DataFrame:
    """Closing fills of positions (position, mint, tokens, cost) without an exit, at the mint's latest price (mint, price)."""
    return entries.join(exits.select("position").distinct(), "position", "left_anti").join(prices, "mint", "left").select("position", "mint", "tokens", "price", (F.col("tokens") * F.col("price")).alias("value"), (F.col("tokens") * F.col("price") - F.col("cost")).alias("pnl"))


def exits(positions: DataFrame, marks: DataFrame, take: float = 0.5, stop: float = 0.3, trail: float = 0.25, hold_us: int = 10 * 86_400_000_000) -> DataFrame:
    """The first mark (mint, us, seq, price) after each position's entry (position, mint, us, price) at which a rule fires.

    In order: take profit, stop loss, trailing stop from the best price so far, longest holding time; `open` if none does.
    """
    from pyspark.sql.window import Window

    m = marks.select("mint", F.col("us").alias("m_us"), F.col("seq").alias("m_seq"), F.col("price").alias("m_price"))

    def rule(best):
        return F.when(F.col("m_price") >= F.col("price") * (1 + take), "take_profit").when(F.col("m_price") <= F.col("price") * (1 - stop), "stop_loss").when(F.col("m_price") <= best * (1 - trail), "trailing_stop").when(F.col("m_us") - F.col("us") >= hold_us, "max_hold")

    # marks within the holding time, by buckets of it
    near = positions.withColumn("b", F.explode(F.expr(f"array(us div {hold_us}, us div {hold_us} + 1)")))
    x = near.join(m.withColumn("b", F.expr(f"m_us div {hold_us}")), ["mint", "b"]).where(f"m_us > us and m_us < us + {hold_us}")
    best = F.max("m_price").over(Window.partitionBy("position").orderBy("m_us", "m_seq").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("rule", rule(best))
    hit = x.groupBy("position").agg(F.min_by(F.when(F.col("rule").isNotNull(), F.struct("rule", "m_us", "m_price")), F.when(F.col("rule").isNotNull(), F.struct("m_us", "m_seq"))).alias("h"), F.max("m_price").alias("top"))
    # the first mark at or after its end, at which the longest holding time fires at last: a union and one window
    ends = positions.select("mint", (F.col("us") + hold_us).alias("t"), F.lit(0).alias("kind"), "position", F.lit(None).cast(m.schema["m_seq"].dataType).alias("m_seq"), F.lit(None).cast("double").alias("m_price"))
    both = ends.union(m.select("mint", "m_us", F.lit(1), F.lit(None).cast(positions.schema["position"].dataType), "m_seq", "m_price"))
    after = Window.partitionBy("mint").orderBy("t", "kind", "m_seq").rowsBetween(0, Window.unboundedFollowing)
    late = both.withColumn("next", F.first(F.when(F.col("kind") == 1, F.struct(F.col("t").alias("m_us"), "m_price")), ignorenulls=True).over(after)).where("kind = 0").select("position", "next.*")
    y = positions.join(hit, "position", "left").join(late, "position", "left")
    last = F.when(F.col("m_us").isNotNull(), F.struct(rule(F.greatest(F.coalesce("top", "m_price"), "m_price")).alias("rule"), "m_us", "m_price"))
    y = y.withColumn("h", F.coalesce("h", last))
    return y.select("position", "mint", F.coalesce("h.rule", F.lit("open")).alias("rule"), F.col("h.m_us").alias("exit_us"), F.col("h.m_price").alias("exit_price"))


def token_labels(trades: DataFrame, size: float, depth: float, horizon_s: int, fee: dict = FEES) -> DataFrame:
    """Per mint from its first price: profit of a perfect exit and of one at the last price, both after fees, and what that makes it."""
    from ..operators.windows import forward_extremes

    starts = trades.groupBy("mint").agg(F.min("us").alias("start_us"), F.min_by("price", F.struct("us", "seq")).alias("start_price"), F.max_by("price", F.struct("us", "seq")).alias("last_price"))
    x = starts.join(forward_extremes(trades, starts.select("mint", "start_us", "start_price"), [horizon_s]), "mint")
    one = lambda exit_: round_trips(x.select("mint", F.lit(size).alias("size"), F.col("start_price").alias("entry_price"), exit_.alias("exit_price"), F.lit(depth).alias("depth")), fee).select("mint", "net_pnl")
    best = one(F.col("start_price") * (1 + F.col(f"max_return_{horizon_s}s"))).withColumnRenamed("net_pnl", "oracle_pnl")
    real = one(F.col("last_price")).withColumnRenamed("net_pnl", "realistic_pnl")
    y = x.join(best, "mint").join(real, "mint")
    return y.select("mint", "oracle_pnl", "realistic_pnl", (F.col("oracle_pnl") > 0).alias("scalpable"), F.col("down50_us").isNotNull().alias("rug"), (F.col("realistic_pnl") > 0).alias("profitable"))
