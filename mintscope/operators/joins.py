"""Joins that are more than one equality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut, spread
from .windows import first_buyers


def asof(left: DataFrame, right: DataFrame, keys: list[str], us: str, value: str, rows: int = 0) -> DataFrame:
    """left with the last value of right at or before each row's time: both sides in one sort, no pairs; `rows`, about as many as both have, keep a task's sort small."""
    a = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, us, F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = spread(a.unionByName(b, allowMissingColumns=True), rows, *keys)
    seen = F.last("__v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(us, "__side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, seen).where("__side = 1").drop("__side", "__v")


def side_by_side(parts: list[DataFrame], key: str) -> DataFrame:
    """One row a key with the columns of all parts, NULL where a part lacks it; each part has a key at most once.

    Each part is written by tasks of its own, and one aggregate puts them together: a chain of joins would hold the
    sorts and sums of all parts in one task.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [cut(p, "part") for p in parts])
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in rows.columns if c != key])


def latest_funder(edges: DataFrame) -> DataFrame:
    """(wallet, funder, us): each wallet's last funding."""
    return edges.groupBy("wallet").agg(F.max_by("funder", F.struct("us", "edge")).alias("funder"), F.max("us").alias("us"))


def same_funder_pairs(trades: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(mint, pairs, funders): pairs among the first n buyers that share their latest funder: counted by group, not joined."""
    return shared_funders(first_buyers(trades, n), edges)


def shared_funders(first: DataFrame, edges: DataFrame) -> DataFrame:
    """`same_funder_pairs` of buyers (mint, wallet) that are known."""
    groups = first.select("mint", "wallet").join(latest_funder(edges).select("wallet", "funder"), "wallet").groupBy("mint", "funder").count()
    return groups.groupBy("mint").agg(F.sum(F.expr("count * (count - 1) div 2")).alias("pairs"), F.count(F.lit(1)).alias("funders"))


def rotation(trades: DataFrame) -> DataFrame:
    """(mint, rotated_wallets, rotated_notional): wallets that bought the mint and sold others, with what they sold there: totals less own, no pairs."""
    by = trades.groupBy("mint", "wallet").agg(F.coalesce(F.sum(F.when(F.col("side") == "buy", F.col("quote"))), F.lit(0.0)).alias("bought"), F.coalesce(F.sum(F.when(F.col("side") == "sell", F.col("quote"))), F.lit(0.0)).alias("sold"))
    elsewhere = F.sum("sold").over(Window.partitionBy("wallet")) - F.col("sold")
    x = by.withColumn("elsewhere", F.round(elsewhere, 6)).where("bought > 0 and elsewhere > 0")
    return x.groupBy("mint").agg(F.count(F.lit(1)).alias("rotated_wallets"), F.sum("elsewhere").alias("rotated_notional"))


def reconcile(tentative: DataFrame, canonical: DataFrame, ttl_us: int) -> DataFrame:
    """(key, outcome, lag_us) of tentative and canonical (key, us): matched within ttl, missing_later if after it, false_positive, canonical_only."""
    a = tentative.groupBy("key").agg(F.min("us").alias("t_us"))
    b = canonical.groupBy("key").agg(F.min("us").alias("c_us"))
    lag = F.col("c_us") - F.col("t_us")
    outcome = F.when(F.col("t_us").isNull(), "canonical_only").when(F.col("c_us").isNull(), "false_positive").when(lag <= ttl_us, "matched").otherwise("missing_later")
    return a.join(b, "key", "full").select("key", outcome.alias("outcome"), lag.alias("lag_us"))


def first_resolution(pending: DataFrame, events: DataFrame, keys: list[str], ttl_us: int, priority) -> DataFrame:
    """Each pending row (id, keys, us) with the first event of its keys in (us, us + ttl]; at one time the smallest priority; expired if none. Buckets of ttl bound what meets."""
    near = pending.withColumn("b", F.explode(F.expr(f"array(us div {ttl_us}, us div {ttl_us} + 1)")))
    x = near.join(events.select(*keys, F.col("us").alias("e_us"), priority.alias("p"), "kind").withColumn("b", F.expr(f"e_us div {ttl_us}")), [*keys, "b"]).where(f"e_us > us and e_us <= us + {ttl_us}")
    best = x.groupBy("id").agg(F.min(F.struct("e_us", "p", "kind")).alias("m"))
    return pending.join(best, "id", "left").select("id", *keys, "us", F.coalesce("m.kind", F.lit("expired")).alias("resolution"), (F.col("m.e_us") - F.col("us")).alias("latency_us"))


def duplicate_intents(intents: DataFrame, window_us: int, tolerance: float) -> DataFrame:
    """(id, original): the earliest earlier intent (mint, signature, wallet, us, quote) that is the same one.

    Two intents of a mint that both have a signature are the same if it is; otherwise if the seller is, and time and
    amount are near: within window_us, and within `tolerance` of the larger amount (1 at least). Buckets of time bound
    what meets; equal signatures need no pairs, only their first.
    """
    signed = intents.where("signature is not null").select("id", F.expr("first(us) over (partition by mint, signature order by us, id)").alias("o_us"), F.expr("first(id) over (partition by mint, signature order by us, id)").alias("original")).where("original <> id")
    a = intents.withColumn("b", F.explode(F.expr(f"array(us div {window_us} - 1, us div {window_us})")))
    o = intents.select(F.col("id").alias("original"), "mint", "wallet", F.col("us").alias("o_us"), F.col("quote").alias("o_quote"), F.col("signature").alias("o_signature"), F.expr(f"us div {window_us}").alias("b"))
    near = f"(o_us < us or (o_us = us and original < id)) and us - o_us <= {window_us} and abs(quote - o_quote) <= {tolerance} * greatest(quote, o_quote, 1)"
    x = a.join(o, ["mint", "wallet", "b"]).where(f"(signature is null or o_signature is null) and {near}")
    return x.select("id", "o_us", "original").union(signed).groupBy("id").agg(F.min_by("original", F.struct("o_us", "original")).alias("original"))


def fallback(left: DataFrame, right: DataFrame, exact: list[str], loose: list[str], value: str, order: list[str]) -> DataFrame:
    """left with right's value by the exact keys, else that of the first row (in order) with the loose keys."""
    first = Window.partitionBy(*loose).orderBy(*order)
    near = right.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(*loose, F.col(value).alias("__loose"))
    own = Window.partitionBy(*exact).orderBy(*order)
    same = right.withColumn("__r", F.row_number().over(own)).where("__r = 1").select(*exact, F.col(value).alias("__exact"))
    return left.join(same, exact, "left").join(near, loose, "left").withColumn(value, F.coalesce("__exact", "__loose")).drop("__exact", "__loose")


def merge_sources(sources: list[DataFrame], keys: list[str], firsts: list[str], ors: list[str]) -> DataFrame:
    """One row per key over all sources: of `firsts` the first non-empty in the sources' order, of `ors` any, and the list of sources."""
    rows = sources[0].withColumn("__i", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("__i", F.lit(i)), allowMissingColumns=True)
    there = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("__i"))
    return rows.groupBy(*keys).agg(*[F.min_by(c, there(c)).alias(c) for c in firsts], *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ors], F.array_join(F.transform(F.array_sort(F.collect_set("__i")), lambda i: i.cast("string")), ",").alias("sources"))


def pair_fills(fills: DataFrame) -> DataFrame:
    """(position, entry_us, exit_us, entry_quote, exit_quote, pnl, status) from fills (position, side, us, seq, quote)."""
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    x = fills.groupBy("position").agg(
        F.min(F.when(buy, F.col("us"))).alias("entry_us"),
        F.max(F.when(sell, F.col("us"))).alias("exit_us"),
        F.sum(F.when(buy, F.col("quote"))).alias("entry_quote"),
        F.sum(F.when(sell, F.col("quote"))).alias("exit_quote"),
    )
    status = F.when(F.col("entry_us").isNull(), "orphan_exit").when(F.col("exit_us").isNull(), "open").otherwise("closed")
    return x.withColumns({"pnl": F.col("exit_quote") - F.col("entry_quote"), "status": status})


def best_per_key(rows: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x")).select(*keys, "x.*")
