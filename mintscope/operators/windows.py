"""Time-series operators per mint; times are microseconds and every order is total by (us, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.math import quotient

SECOND = 1_000_000
ORDER = ["us", "seq"]


def _w(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy(*ORDER)


def bounded_history(trades: DataFrame, n: int = 512) -> DataFrame:
    """The last n trades of each mint."""
    last = Window.partitionBy("mint").orderBy(F.desc("us"), F.desc("seq"))
    return trades.withColumn("place", F.row_number().over(last)).where(F.col("place") <= n)


def window_returns(trades: DataFrame, seconds: list[int]) -> DataFrame:
    """Each trade with the return, and the price change per millisecond, since the first price of each look-back window."""
    out = trades
    for s in seconds:
        frame = Window.partitionBy("mint").orderBy("us").rangeBetween(-s * SECOND, 0)
        first = F.min_by(F.struct("price", "us"), F.struct("us", "seq")).over(frame)
        out = out.withColumn(f"first_{s}", first)
        change = F.col("price") - F.col(f"first_{s}.price")
        ms = (F.col("us") - F.col(f"first_{s}.us")) / F.lit(1000.0)
        out = out.withColumns({f"return_{s}s": F.when(F.col(f"first_{s}.price") > 0, change / F.col(f"first_{s}.price")), f"velocity_{s}s": F.when(ms > 0, change / ms)}).drop(f"first_{s}")
    return out


def mean_absolute_return(trades: DataFrame, anchors: DataFrame, seconds: int) -> DataFrame:
    """(mint, at, volatility): mean absolute return of neighbouring prices in the window before each anchor (mint, at); NULL below two prices.

    Buckets of the window's width bound what an anchor meets.
    """
    width = seconds * SECOND
    near = anchors.withColumn("b", F.explode(F.expr(f"array(at div {width} - 1, at div {width})")))
    inside = trades.withColumn("b", F.expr(f"us div {width}")).join(near, ["mint", "b"]).where((F.col("us") >= F.col("at") - width) & (F.col("us") <= F.col("at")))
    before = F.lag("price").over(Window.partitionBy("mint", "at").orderBy(*ORDER))
    moves = inside.withColumn("before", before).where("before > 0")
    found = moves.groupBy("mint", "at").agg(F.avg(F.abs(F.col("price") / F.col("before") - 1)).alias("volatility"))
    return anchors.join(found, ["mint", "at"], "left")


def price_path(trades: DataFrame) -> DataFrame:
    """Per mint: time of the all-time high, number of new highs, worst drawdown, drawdown at the end, longest time without a buy."""
    high = F.max("price").over(_w("mint").rowsBetween(Window.unboundedPreceding, -1))
    run = F.max("price").over(_w("mint").rowsBetween(Window.unboundedPreceding, 0))
    before_buy = F.max(F.when(F.col("side") == "buy", F.col("us"))).over(_w("mint").rowsBetween(Window.unboundedPreceding, -1))
    x = trades.withColumns({"high": high, "run": run, "before": before_buy})
    last = F.max_by("price", F.struct("us", "seq"))
    return x.groupBy("mint").agg(
        F.min_by("us", F.struct((-F.col("price")).alias("p"), "us", "seq")).alias("ath_us"),
        F.count_if(F.col("high").isNotNull() & (F.col("price") > F.col("high"))).alias("new_highs"),
        F.max(quotient(F.col("run") - F.col("price"), F.col("run"))).alias("max_drawdown"),
        (1 - quotient(last, F.max("price"))).alias("end_drawdown"),
        F.max(F.when((F.col("side") == "buy") & F.col("before").isNotNull(), F.col("us") - F.col("before"))).alias("longest_gap_us"),
    )


def window_flow(trades: DataFrame, seconds: int) -> DataFrame:
    """Each trade with buy volume, net flow and distinct buyers of the look-back window.

    A wallet counts from a buy until the window has passed its last one: +1 where it comes in, -1 just after it is out,
    and their running sum is the number of buyers; no set of wallets is held for a row.
    """
    width = seconds * SECOND
    frame = Window.partitionBy("mint").orderBy("us").rangeBetween(-width, 0)
    buy = F.col("side") == "buy"
    own = Window.partitionBy("mint", "wallet").orderBy(*ORDER)
    buys = trades.where(buy).select("mint", "us", (F.coalesce(F.lag("us").over(own) < F.col("us") - width, F.lit(True))).alias("comes"), (F.coalesce(F.lead("us").over(own) > F.col("us") + width, F.lit(True))).alias("goes"))
    turns = buys.select("mint", F.explode(F.array_compact(F.array(F.when(F.col("comes"), F.struct("us", F.lit(1).alias("d"))), F.when(F.col("goes"), F.struct((F.col("us") + width + 1).alias("us"), F.lit(-1).alias("d")))))).alias("t")).select("mint", "t.us", "t.d")
    x = trades.withColumns({
        "buy_volume": F.coalesce(F.sum(F.when(buy, F.col("quote"))).over(frame), F.lit(0.0)),
        "net_flow": F.sum(F.when(buy, F.col("quote")).otherwise(-F.col("quote"))).over(frame),
    })
    x = x.unionByName(turns, allowMissingColumns=True)
    upto = Window.partitionBy("mint").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("buyers", F.coalesce(F.sum("d").over(upto), F.lit(0)).cast("int"))
    return x.where("d is null").drop("d")


def first_trades(trades: DataFrame, n: int) -> DataFrame:
    return trades.withColumn("place", F.row_number().over(_w("mint"))).where(F.col("place") <= n)


def first_buyers(trades: DataFrame, n: int, top: int = 0) -> DataFrame:
    """(mint, wallet, place, us, quote): the first n distinct buyers; with `top`, also whether each is among the mint's `top` largest holders, who hold what they bought less what they sold."""
    buy = F.col("side") == "buy"
    at = F.struct("us", "seq", "quote")
    place = F.row_number().over(Window.partitionBy("mint").orderBy(F.asc_nulls_last("f")))
    if not top:
        first = trades.where(buy).groupBy("mint", "wallet").agg(F.min(at).alias("f"))
        return first.withColumn("place", place).where(F.col("place") <= n).select("mint", "wallet", "place", "f.us", "f.quote")
    own = trades.groupBy("mint", "wallet").agg(F.min(F.when(buy, at)).alias("f"), F.sum(F.when(buy, F.col("tokens")).otherwise(-F.col("tokens"))).alias("balance"))
    own = own.withColumn("balance", F.when(F.col("balance") > 0, F.col("balance")))
    rank = F.row_number().over(Window.partitionBy("mint").orderBy(F.desc_nulls_last("balance"), "wallet"))
    there = F.col("balance").isNotNull() & (rank <= top) & F.col("wallet").isNotNull()
    first = own.select("mint", "wallet", "f", there.alias("on_top")).withColumn("place", place)
    return first.where((F.col("place") <= n) & F.col("f").isNotNull()).select("mint", "wallet", "place", "f.us", "f.quote", "on_top")


def holding_times(trades: DataFrame) -> DataFrame:
    """Per mint: mean seconds from a wallet's first buy to its first sell, 0 where the sell came first."""
    times = trades.groupBy("mint", "wallet").agg(F.min(F.when(F.col("side") == "buy", F.col("us"))).alias("b"), F.min(F.when(F.col("side") == "sell", F.col("us"))).alias("s")).where("b is not null and s is not null")
    held = F.greatest(F.lit(0), F.col("s") - F.col("b")) / F.lit(SECOND)
    return times.groupBy("mint").agg(F.count(F.lit(1)).alias("wallets"), F.avg(held).alias("mean_seconds"), F.max(held).alias("max_seconds"))


def retention(trades: DataFrame, held: DataFrame, n: int) -> DataFrame:
    """(mint, retention): the part of the first n buyers with a balance left."""
    return retentions(trades, held, [n]).select("mint", F.col(f"retention_{n}").alias("retention"))


def retentions(trades: DataFrame, held: DataFrame, ns: list[int]) -> DataFrame:
    """(mint, retention_<n>, ...): for each n the part of the first n buyers with a balance left; the buyers are found once."""
    first = first_buyers(trades, max(ns)).select("mint", "wallet", "place")
    own = held.where("balance > 0").select("mint", "wallet", F.lit(1).alias("there"))
    part = lambda n: F.count(F.when(F.col("place") <= n, F.col("there"))) / F.count(F.when(F.col("place") <= n, 1))
    return first.join(own, ["mint", "wallet"], "left").groupBy("mint").agg(*[part(n).alias(f"retention_{n}") for n in ns])


def absorption(trades: DataFrame, large: float) -> DataFrame:
    """Per mint with a large sell: buys, volume and buyers after it, and how fast and far the price came back to the one before."""
    sells = trades.where((F.col("side") == "sell") & (F.col("quote") >= large)).groupBy("mint").agg(F.min(F.struct("us", "seq")).alias("hit"))
    x = trades.join(sells, "mint").withColumn("at", F.struct("us", "seq"))
    before = x.where("at < hit").groupBy("mint").agg(F.max_by("price", "at").alias("price_before"))
    after = x.where("at > hit").join(before, "mint", "left")
    buy = F.col("side") == "buy"
    out = after.groupBy("mint").agg(
        F.count_if(buy).alias("buys_after"),
        F.coalesce(F.sum(F.when(buy, F.col("quote"))), F.lit(0.0)).alias("volume_after"),
        F.count_distinct(F.when(buy, F.col("wallet"))).alias("buyers_after"),
        F.min(F.when(F.col("price") >= F.col("price_before"), F.col("us") - F.col("hit.us"))).alias("recovery_us"),
        F.max(quotient(F.col("price"), F.col("price_before"))).alias("recovery"),
    )
    return sells.select("mint").join(out, "mint", "left").fillna(0, ["buys_after", "volume_after", "buyers_after"])


def forward_extremes(trades: DataFrame, starts: DataFrame, seconds: list[int]) -> DataFrame:
    """Post-launch labels per mint of starts (mint, start_us, start_price): best return and worst drawdown by each horizon, first times at +20 % and -50 %."""
    x = trades.join(starts, "mint").where("us >= start_us and start_price > 0").withColumn("move", F.col("price") / F.col("start_price") - 1)
    by = {}
    for s in seconds:
        inside = F.col("us") <= F.col("start_us") + s * SECOND
        by |= {f"max_return_{s}s": F.max(F.when(inside, F.col("move"))), f"max_drawdown_{s}s": F.min(F.when(inside, F.col("move")))}
    return x.groupBy("mint").agg(*[v.alias(k) for k, v in by.items()], F.min(F.when(F.col("move") >= 0.2, F.col("us") - F.col("start_us"))).alias("up20_us"), F.min(F.when(F.col("move") <= -0.5, F.col("us") - F.col("start_us"))).alias("down50_us"))


def trailing_mean(trades: DataFrame, n: int = 12) -> DataFrame:
    return trades.withColumn("trailing_mean", F.avg("price").over(_w("mint").rowsBetween(-(n - 1), 0)))


#: States that end a lifecycle, or hold it until it is looked at again: activity changes them no more.
HELD = ["DataGap", "SoftDiscarded", "HardDiscarded", "RugArchive", "Migrated", "Completed"]
#: Seconds without an event after which a token in a state expires.
TTL = {"Discovered": 900, "FirstPass": 1800, "ActiveLight": 1800, "ActiveDeep": 7200, "SoftDiscarded": 259_200, "HardDiscarded": 259_200, "RugArchive": 604_800, "Migrated": 259_200, "Completed": 259_200, "DataGap": 259_200}


def target_state(trades: Column, holders: Column, buyers: Column) -> Column:
    """The state that activity asks for: by trades so far, holders with a balance, distinct buyers so far."""
    return F.when((trades >= 4) | (holders >= 4) | (buyers >= 3), "ActiveDeep").when((trades >= 2) | (holders >= 2), "ActiveLight").when(trades >= 1, "FirstPass").otherwise("Discovered")


def lifecycle_states(trades: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Every trade, and every mark (mint, us, seq, mark), with n, holders, buyers so far and the mint's state.

    A mark names one of HELD; the first holds from then on. Counts are running sums: a wallet's first buy, and its
    balance's turns to and from zero, count once each.
    """
    own = Window.partitionBy("mint", "wallet").orderBy(*ORDER)
    buy = F.col("side") == "buy"
    signed = F.when(buy, F.col("tokens")).otherwise(-F.col("tokens"))
    after = F.sum(signed).over(own.rowsBetween(Window.unboundedPreceding, 0))
    x = trades.withColumns({"after": after, "first": buy & (F.coalesce(F.sum(buy.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0)})
    x = x.withColumn("turn", (F.col("after") > 0).cast("int") - (F.col("after") - signed > 0).cast("int"))
    x = x.select("mint", "us", "seq", F.lit(1).alias("one"), "turn", F.col("first").cast("int").alias("first"), F.lit(None).cast("string").alias("mark"))
    if marks is not None:
        x = x.union(marks.select("mint", "us", "seq", F.lit(0), F.lit(0), F.lit(0), "mark"))
    upto = _w("mint").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"n": F.sum("one").over(upto), "holders": F.sum("turn").over(upto), "buyers": F.sum("first").over(upto), "held": F.first("mark", ignorenulls=True).over(upto)})
    return x.select("mint", "us", "seq", "n", "holders", "buyers", F.coalesce("held", target_state(F.col("n"), F.col("holders"), F.col("buyers"))).alias("state"))


def ttl_seconds(state: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in TTL.items() for v in kv])[state].cast("long")


def lifecycle(trades: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Where a mint's state changes (from Discovered at first), and when it would expire."""
    x = lifecycle_states(trades, marks)
    x = x.withColumn("was", F.coalesce(F.lag("state").over(_w("mint")), F.lit("Discovered"))).where("was <> state")
    return x.select("mint", "us", "seq", "was", "state", "n", "holders", "buyers", (F.col("us") + ttl_seconds(F.col("state")) * SECOND).alias("expires_us"))


def expiries(rows: DataFrame, ttl: Column, *more: str) -> DataFrame:
    """Rows (mint, us, seq) after which a mint expires: none follows within ttl (seconds, by row), or none at all."""
    nxt = F.lead("us").over(_w("mint"))
    x = rows.withColumns({"next_us": nxt, "expires_us": F.col("us") + ttl * SECOND})
    return x.where("next_us is null or next_us > expires_us").select("mint", "us", "seq", *more, "expires_us", "next_us")


def horizon_peaks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each (keys, horizon): the peak of value at this or a later horizon, the earliest horizon that has it, and the time to it."""
    later = Window.partitionBy(*keys).orderBy("horizon").rowsBetween(0, Window.unboundedFollowing)
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col("horizon")).alias("h"))).over(later)
    return rows.withColumn("best", best).select(*keys, "horizon", F.col("best.v").alias("peak"), (-F.col("best.h")).alias("peak_horizon"), (-F.col("best.h") - F.col("horizon")).alias("time_to_peak"))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def excursions(marks: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running best and worst value so far."""
    upto = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumns({"best": F.max(value).over(upto), "worst": F.min(value).over(upto)})
