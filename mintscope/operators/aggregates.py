"""Aggregations over trades, balances and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGE_SELL = 5.0


def _buy(x=None) -> Column:
    return F.when(F.col("side") == "buy", F.lit(1) if x is None else x)


def _sell(x=None) -> Column:
    return F.when(F.col("side") == "sell", F.lit(1) if x is None else x)


def trade_stats(trades: DataFrame, large: float = LARGE_SELL) -> DataFrame:
    """One row per mint: counts, volumes, unique wallets, extremes, last prices and the first large sell; one pass over trades."""
    big = (F.col("side") == "sell") & (F.col("quote") >= large)
    return trades.groupBy("mint").agg(
        F.count(_buy()).alias("buys"),
        F.count(_sell()).alias("sells"),
        F.coalesce(F.sum(_buy(F.col("quote"))), F.lit(0.0)).alias("buy_volume"),
        F.coalesce(F.sum(_sell(F.col("quote"))), F.lit(0.0)).alias("sell_volume"),
        F.count_distinct(_buy(F.col("wallet"))).alias("unique_buyers"),
        F.count_distinct(_sell(F.col("wallet"))).alias("unique_sellers"),
        F.max("price").alias("ath"),
        F.min("price").alias("atl"),
        F.max_by("price", F.struct("us", "seq")).alias("latest_price"),
        F.min_by("price", F.struct("us", "seq")).alias("first_price"),
        F.max(_buy(F.col("us"))).alias("last_buy_us"),
        F.max(_sell(F.col("us"))).alias("last_sell_us"),
        F.min(F.when(big, F.col("us"))).alias("first_large_sell_us"),
    )


def nearest_rank(values: Column, p: int) -> Column:
    """The element at floor((n - 1) p / 100) of a sorted array, as an aggregate's finish."""
    return F.get(values, F.floor((F.size(values) - 1) * p / F.lit(100)).cast("int"))


def percentiles(df: DataFrame, by: list[str], value: str, ps: list[int]) -> DataFrame:
    """Lower-nearest-rank percentiles per group, exact. Ranks by window sort, so a large group is never one row's array."""
    own = df.where(F.col(value).isNotNull())
    w = f"partition by {', '.join(by)} order by {value}"
    ranked = own.withColumns({"__r": F.expr(f"row_number() over ({w}) - 1"), "__n": F.expr(f"count(1) over (partition by {', '.join(by)})")})
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("__r") == F.expr(f"((__n - 1) * {p}) div 100"), F.col(value))).alias(f"p{p}") for p in ps])


def concentration(held: DataFrame, tops: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """Gini, HHI and top-N shares of positive balances per mint; held has (mint, wallet, balance)."""
    pos = held.where("balance > 0")
    ranked = pos.withColumns({
        "up": F.expr("row_number() over (partition by mint order by balance, wallet)"),
        "down": F.expr("row_number() over (partition by mint order by balance desc, wallet)"),
    })
    out = ranked.groupBy("mint").agg(
        F.count(F.lit(1)).alias("holders"),
        F.sum("balance").alias("supply"),
        F.sum(F.col("up") * F.col("balance")).alias("weighted"),
        F.sum(F.col("balance") * F.col("balance")).alias("squares"),
        *[F.sum(F.when(F.col("down") <= n, F.col("balance"))).alias(f"top{n}") for n in tops],
    )
    n, s = F.col("holders"), F.col("supply")
    return out.select(
        "mint",
        "holders",
        "supply",
        (2 * F.col("weighted") / (n * s) - (n + 1) / n).alias("gini"),
        (F.col("squares") / (s * s)).alias("hhi"),
        *[(F.col(f"top{k}") / s * 100).alias(f"top{k}_pct") for k in tops],
    )


def top_share(held: DataFrame, excluded: DataFrame, supply: DataFrame, n: int) -> DataFrame:
    """(mint, holders, top_pct): top-n share by a given supply (mint, supply) without excluded (mint, wallet) owners."""
    left = held.where("balance > 0").join(excluded, ["mint", "wallet"], "left_anti")
    ranked = left.withColumn("r", F.expr("row_number() over (partition by mint order by balance desc, wallet)"))
    sums = ranked.groupBy("mint").agg(F.count(F.lit(1)).alias("holders"), F.sum(F.when(F.col("r") <= n, F.col("balance"))).alias("top"))
    return sums.join(supply, "mint").select("mint", "holders", F.when(F.col("supply") > 0, F.col("top") / F.col("supply") * 100).alias("top_pct"))


def dominant_share(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Largest group's size, its share, and the number of groups."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).count()
    return counts.groupBy(*by).agg(F.max("count").alias("max_group"), (F.max("count") / F.sum("count")).alias("dominant_share"), F.count(F.lit(1)).alias("groups"))


def identical_amounts(first: DataFrame, digits: int = 4) -> DataFrame:
    """Size of the largest group of equal amounts (half-even rounding) per mint."""
    rounded = first.groupBy("mint", F.bround(F.col("quote").cast("decimal(38,9)"), digits).alias("q")).count()
    return rounded.groupBy("mint").agg(F.max("count").alias("identical_amounts"))


def wallet_summary(trades: DataFrame) -> DataFrame:
    """Per wallet: first and last seen, mints touched, tokens bought and sold."""
    return trades.groupBy("wallet").agg(
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.count_distinct("mint").alias("mints"),
        F.coalesce(F.sum(_buy(F.col("tokens"))), F.lit(0.0)).alias("bought"),
        F.coalesce(F.sum(_sell(F.col("tokens"))), F.lit(0.0)).alias("sold"),
    )


def creator_state(trades: DataFrame, creators: DataFrame) -> DataFrame:
    """Per mint what its creator (mint, wallet) did: net tokens and quote, first sell, share sold."""
    own = trades.join(creators, ["mint", "wallet"])
    bought, sold = F.coalesce(F.sum(_buy(F.col("tokens"))), F.lit(0.0)), F.coalesce(F.sum(_sell(F.col("tokens"))), F.lit(0.0))
    return own.groupBy("mint", "wallet").agg(
        (bought - sold).alias("net_tokens"),
        F.sum(F.when(F.col("side") == "buy", -F.col("quote")).otherwise(F.col("quote"))).alias("net_quote"),
        F.min(_sell(F.col("us"))).alias("first_sell_us"),
        F.when(bought > 0, F.least(F.lit(1.0), sold / bought)).alias("sold_share"),
    )


def top_mints(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("buy_volume"), F.desc("buys"), "mint").limit(n).select("mint", "buy_volume", "buys")


def histogram(df: DataFrame, codes: str, out: str = "code") -> DataFrame:
    """How often each element of an array column comes."""
    return df.select(F.explode(codes).alias(out)).groupBy(out).count()


def missingness(df: DataFrame, by: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """(by, feature_group, rows, present_ratio, complete): the share of present cells of each group of columns."""
    cells = F.array(*[F.struct(F.lit(g).alias("g"), (sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int")) / len(cols)).alias("p")) for g, cols in groups.items()])
    return df.select(*by, F.explode(cells).alias("x")).groupBy(*by, F.col("x.g").alias("feature_group")).agg(F.count(F.lit(1)).alias("rows"), F.avg("x.p").alias("present_ratio"), F.count_if(F.col("x.p") == 1).alias("complete"))


def overlapping_rates(df: DataFrame, cohorts: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """Mean of each measure per cohort, where rows may be in several cohorts."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cohorts.items()]))
    rows = df.select(*[m.alias(k) for k, m in measures.items()], F.explode(names).alias("cohort"))
    return rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.col(k).cast("double")).alias(k) for k in measures])


def long_summary(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One aggregate row turned into (metric, value) rows."""
    one = df.agg(*[m.cast("double").alias(k) for k, m in measures.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in measures])).alias("m")).select("m.*")


def top_reasons(df: DataFrame, by: list[str], codes: str, n: int) -> DataFrame:
    """The n most frequent codes per group, ties by name."""
    counts = df.select(*by, F.explode(codes).alias("code")).groupBy(*by, "code").count()
    part = f"partition by {', '.join(by)} " if by else ""
    return counts.withColumn("place", F.expr(f"row_number() over ({part}order by count desc, code)")).where(F.col("place") <= n)




def count_alike(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with how many of its rows have the row's value of `by`; 0 where that is null. Counted before rows meet, so a common value is not one task."""
    n = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("__v")).agg(F.count(F.lit(1)).alias(name))
    return df.join(n, F.col(by) == F.col("__v"), "left").drop("__v").fillna(0, [name])
