"""L3: what trades, holders and the curve of a mint had come to by each horizon, rebuilt from change logs in one pass.

A change belongs to the first horizon that it lies before. Changes are summed up by horizon once, and what holds at a horizon
is the running sum, or the last value, over the horizons up to it: no change is written for every horizon it falls in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .labels import HORIZONS, asof_base


def _placed(log: DataFrame, labels: DataFrame, horizons: list[int], unit_us: int) -> DataFrame:
    """The log's rows from first_us on, with the first horizon at or after each; what is later than all horizons is out."""
    x = log.join(labels.select("mint", "first_us"), "mint").where("us >= first_us")
    first = F.array_min(F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: F.col("us") <= F.col("first_us") + h * unit_us))
    return x.withColumn("horizon", first).where("horizon is not null")


def _sum(c: str, by: list[str]) -> Column:
    return F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def trade_state(trades: DataFrame, grid: DataFrame, labels: DataFrame, horizons: list[int], unit_us: int) -> DataFrame:
    x = _placed(trades, labels, horizons, unit_us)
    buy = F.col("side") == "buy"
    by = x.groupBy("mint", "wallet", "horizon").agg(F.count_if(buy).alias("b"), F.count_if(~buy).alias("s"), F.sum("quote").alias("v"), F.max("us").alias("at"))
    seen = Window.partitionBy("mint", "wallet").orderBy("horizon")
    by = by.withColumn("new", (F.row_number().over(seen) == 1).cast("long"))
    own = by.groupBy("mint", "horizon").agg(*[F.sum(c).alias(c) for c in ("b", "s", "v", "new")], F.max("at").alias("at"))
    y = grid.join(own, ["mint", "horizon"], "left")
    upto = Window.partitionBy("mint").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("b") + F.col("s")
    y = y.withColumns({c: _sum(c, ["mint"]) for c in ("b", "s", "v", "new")} | {"recent": F.coalesce(n, F.lit(0)), "last": F.max("at").over(upto)})
    return y.select(
        "mint", "horizon", n.alias("trade_update_count_asof"), F.col("b").alias("buy_count_delta_asof"), F.col("s").alias("sell_count_delta_asof"), (F.col("b") - F.col("s")).alias("net_buy_sell_delta_asof"), F.col("v").cast("double").alias("volume_delta_asof"), F.col("new").alias("unique_trade_accounts_asof"),
        F.expr("(asof_us - last) div 1000").alias("last_trade_age_ms_asof"), F.when(n > 0, F.col("recent") / n).alias("trade_burst_score_asof"), F.when(n > 0, (F.col("b") - F.col("s")) / n).alias("trade_direction_imbalance_asof"),
    )


def holder_state(changes: DataFrame, creators: DataFrame, grid: DataFrame, labels: DataFrame, horizons: list[int], unit_us: int) -> DataFrame:
    """changes: mint, wallet, us, seq, balance after it. A wallet is written once a horizon at most, from its first change on."""
    x = _placed(changes, labels, horizons, unit_us)
    order = Window.partitionBy("mint", "wallet").orderBy("us", "seq")
    was = F.lag("balance", 1, 0.0).over(order)
    x = x.withColumns({"come": ((F.col("balance") > 0) & (was <= 0)).cast("long"), "go": ((F.col("balance") <= 0) & (was > 0)).cast("long")})
    by = x.groupBy("mint", "wallet", "horizon").agg(F.count(F.lit(1)).alias("n"), F.sum("come").alias("come"), F.sum("go").alias("go"), F.max_by("balance", F.struct("us", "seq")).alias("balance"))
    # a balance holds until the wallet's next change: it is carried to the horizons before that
    nxt = F.lead("horizon").over(Window.partitionBy("mint", "wallet").orderBy("horizon"))
    own = by.withColumn("next", nxt).withColumn("new", (F.row_number().over(Window.partitionBy("mint", "wallet").orderBy("horizon")) == 1).cast("long"))
    carried = own.withColumn("h", F.explode(F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: (h >= F.col("horizon")) & (F.col("next").isNull() | (h < F.col("next"))))))
    dev = creators.select("mint", F.col("wallet").alias("dev"))
    held = carried.join(dev, "mint", "left").groupBy("mint", F.col("h").alias("horizon")).agg(
        F.count_if(F.col("balance") > 0).alias("holders"), F.sum(F.greatest("balance", F.lit(0.0))).alias("supply"), F.max("balance").alias("top"), F.max(F.when(F.col("wallet") == F.col("dev"), F.greatest("balance", F.lit(0.0)))).alias("dev_balance"),
        *[F.sum(F.when(F.col("h") == F.col("horizon"), F.col(c))).alias(c) for c in ("n", "come", "go", "new")],
    )
    y = grid.join(held, ["mint", "horizon"], "left")
    upto = Window.partitionBy("mint").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    y = y.withColumns({c: _sum(c, ["mint"]) for c in ("n", "come", "go", "new")} | {"peak": F.max("holders").over(upto)})
    share = lambda c: F.when(F.col("supply") > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col("supply"))
    return y.select(
        "mint", "horizon", F.col("n").alias("holder_update_count_asof"), F.col("new").alias("unique_holder_accounts_seen_asof"), share("top").alias("top_holder_concentration_asof"), share("dev_balance").alias("dev_or_creator_holding_proxy_asof"),
        F.when(F.col("come") > 0, F.col("go") / F.col("come")).alias("holder_churn_proxy_asof"), F.when(F.col("peak") > 0, 1 - F.coalesce("holders", F.lit(0)) / F.col("peak")).alias("holder_collapse_proxy_asof"), F.col("come").alias("new_holder_count_delta_asof"), F.col("go").alias("exiting_holder_count_delta_asof"),
    )


def curve_state(curve: DataFrame, grid: DataFrame, labels: DataFrame, horizons: list[int], unit_us: int) -> DataFrame:
    """curve: mint, us, seq, vault (is it the vault that changed), liquidity, reserve, progress, price after each update."""
    x = _placed(curve, labels, horizons, unit_us)
    at = F.struct("us", "seq")
    values = F.struct("liquidity", "reserve", "progress", "price")
    own = x.groupBy("mint", "horizon").agg(F.count_if("vault").alias("vaults"), F.count_if(~F.col("vault")).alias("curves"), F.min_by(values, at).alias("first"), F.max_by(values, at).alias("last"), F.max("liquidity").alias("top"))
    y = grid.join(own, ["mint", "horizon"], "left")
    upto = Window.partitionBy("mint").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    y = y.withColumns({"vaults": _sum("vaults", ["mint"]), "curves": _sum("curves", ["mint"]), "first": F.first("first", ignorenulls=True).over(upto), "last": F.last("last", ignorenulls=True).over(upto), "top": F.max("top").over(upto)})
    moved = lambda c: F.col(f"last.{c}") - F.col(f"first.{c}")
    return y.select(
        "mint", "horizon", F.col("vaults").alias("vault_update_count_asof"), F.col("curves").alias("bonding_curve_update_count_asof"), moved("liquidity").alias("liquidity_delta_asof"), moved("reserve").alias("reserve_delta_asof"), F.col("last.progress").alias("curve_progress_proxy_asof"),
        F.when(F.col("top") > 0, 1 - F.col("last.liquidity") / F.col("top")).alias("liquidity_exit_proxy_asof"), F.when(F.col("first.price") > 0, F.col("last.price") / F.col("first.price") - 1).alias("price_or_curve_move_proxy_asof"),
    )


def alpha_features(trades: DataFrame, changes: DataFrame, curve: DataFrame, creators: DataFrame, labels: DataFrame, horizons: list[int] = HORIZONS, unit_us: int = 1_000_000) -> DataFrame:
    """L3: (mint, horizon, asof_us, reached, 24 columns) of every label (mint, first_us, last_us) and horizon; NULL where the log ends before it."""
    base = asof_base(labels, horizons, unit_us)
    grid = base.select("mint", "horizon", "asof_us")
    out = base.withColumn("reached", F.col("asof_us") <= F.col("last_us"))
    parts = [trade_state(trades, grid, labels, horizons, unit_us), holder_state(changes, creators, grid, labels, horizons, unit_us), curve_state(curve, grid, labels, horizons, unit_us)]
    for p in parts:
        out = out.join(p, ["mint", "horizon"])
    names = [c for p in parts for c in p.columns[2:]]
    return out.select("mint", "horizon", "asof_us", "reached", *[F.when(F.col("reached"), F.col(c)).alias(c) for c in names])
