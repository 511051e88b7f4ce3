"""Order-dependent folds: average-cost ledgers, owner balances, holder behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import fold_sorted


def positions(trades: DataFrame) -> DataFrame:
    """Average-cost ledger per (mint, wallet): tokens left, cost basis, average entry, realised profit, tokens bought and sold.

    A sell takes out its share of the average cost; tokens sold beyond what is held count as sold with no cost and no
    proceeds; missing amounts count as 0. The fold runs over one wallet's trades of one mint in total order, as a
    sorted stream whose state is five numbers, so that a wallet may have any number of trades.
    """

    def step(state, side, quote, tokens):
        held, cost, realised, bought, sold = state
        if side == "buy":
            return (held + tokens, cost + quote, realised, bought + tokens, sold), None
        out = min(tokens, held)
        average = cost / held if held > 0 else 0.0
        proceeds = quote * out / tokens if tokens > 0 else 0.0
        return (held - out, cost - average * out, realised + proceeds - average * out, bought, sold + tokens), None

    amount = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    rows = trades.select("mint", "wallet", "us", "seq", "side", amount("quote"), amount("tokens"))
    p = fold_sorted(rows, ["mint", "wallet"], ["us", "seq"], ["side", "quote", "tokens"], "held double, cost double, realised double, bought double, sold double", lambda: (0.0,) * 5, step, lambda s: s)
    return p.withColumns({"average_entry": F.when(F.col("held") > 0, F.col("cost") / F.col("held")), "taken_profit": F.col("realised") > 0, "round_trip": (F.col("sold") > 0) & (F.col("held") <= 0)})


def marked(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """Positions with unrealised profit at the mint's price (mint, price)."""
    x = ledger.join(prices, "mint", "left")
    return x.withColumn("unrealised", F.col("held") * F.col("price") - F.col("cost"))


def owner_balances(changes: DataFrame) -> DataFrame:
    """(mint, owner, balance): the latest row of each token account (us, seq), summed by its owner then; accounts change hands."""
    last = changes.groupBy("mint", "account").agg(F.max_by(F.struct("owner", "balance"), F.struct("us", "seq")).alias("x"))
    return last.groupBy("mint", F.col("x.owner").alias("owner")).agg(F.sum("x.balance").alias("balance"), F.count(F.lit(1)).alias("accounts"))


def balance_history(trades: DataFrame) -> DataFrame:
    """(mint, us, seq, balance, holders): running balance of the trade's wallet and the mint's holder count after it."""
    signed = F.when(F.col("side") == "buy", F.col("tokens")).otherwise(-F.col("tokens"))
    own = Window.partitionBy("mint", "wallet").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    x = trades.withColumn("balance", F.round(F.sum(signed).over(own), 6))
    before = F.lag("balance", 1, 0.0).over(Window.partitionBy("mint", "wallet").orderBy("us", "seq"))
    change = (F.col("balance") > 0).cast("int") - (F.col("before") > 0).cast("int")
    x = x.withColumn("before", before).withColumn("change", change)
    run = Window.partitionBy("mint").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("holders", F.sum("change").over(run)).select("mint", "wallet", "us", "seq", "balance", "holders")


def holder_churn(history: DataFrame) -> DataFrame:
    """Per mint from a holder history: entries, exits, net change and stickiness (1 - exits / entries)."""
    before = F.lag("holders", 1, 0).over(Window.partitionBy("mint").orderBy("us", "seq"))
    x = history.withColumn("step", F.col("holders") - before)
    entries, exits = F.sum(F.greatest("step", F.lit(0))), F.sum(F.greatest(-F.col("step"), F.lit(0)))
    return x.groupBy("mint").agg(entries.alias("entries"), exits.alias("exits"), (entries - exits).alias("net"), F.when(entries > 0, 1 - exits / entries).alias("stickiness"))


def behaviour(ledger: DataFrame) -> DataFrame:
    """Positions with sold share and status: exited, sold_90, partial, holding, seller_only."""
    share = F.when(F.col("bought") > 0, F.least(F.lit(1.0), F.col("sold") / F.col("bought")))
    x = ledger.withColumn("sold_share", share)
    status = F.when(F.col("bought") <= 0, "seller_only").when(F.col("held") <= 0, "exited").when(F.col("sold_share") >= 0.9, "sold_90").when(F.col("sold") > 0, "partial").otherwise("holding")
    return x.withColumn("status", status)


def exit_threats(held: DataFrame, ledger: DataFrame, depth: DataFrame, creators: DataFrame, n: int = 10) -> DataFrame:
    """The n largest holders of each mint with their share, class in order of precedence, free-roll flag and exit impact at 25, 50 and 100 %.

    Impact follows the curve share and the sale against its depth (mint, depth); classes: creator, free_roller, whale (10 % and more), top_holder.
    """
    from ..functions.math import exit_impact_pct

    total = F.sum("balance").over(Window.partitionBy("mint"))
    ranked = held.withColumns({"share": F.col("balance") / total, "place": F.expr("row_number() over (partition by mint order by balance desc, wallet)")}).where(F.col("place") <= n)
    own = creators.select("mint", "wallet", F.lit(True).alias("creator"))
    x = ranked.join(ledger.select("mint", "wallet", "realised", "cost", "sold"), ["mint", "wallet"], "left").join(own, ["mint", "wallet"], "left").join(depth, "mint", "left")
    free = F.coalesce((F.col("realised") >= F.col("cost")) & (F.col("sold") > 0), F.lit(False))
    kind = F.when(F.col("creator"), "creator").when(free, "free_roller").when(F.col("share") >= 0.1, "whale").otherwise("top_holder")
    impact = {f"impact_{p}": exit_impact_pct(F.col("share") * (p / 100), F.col("balance") * (p / 100), F.col("depth")) for p in (25, 50, 100)}
    return x.withColumns({"free_roll": free, "class": kind, **impact}).select("mint", "wallet", "place", "share", "class", "free_roll", *impact)


def invariant_violations(held: DataFrame, supply: DataFrame) -> DataFrame:
    """(mint, wallet, violation): negative balances, holders above the supply, and mints whose holders add up to more."""
    x = held.join(supply, "mint")
    own = x.select("mint", "wallet", F.explode(F.array_compact(F.array(F.when(F.col("balance") < 0, "negative_balance"), F.when(F.col("balance") > F.col("supply"), "share_above_one")))).alias("violation"))
    total = x.groupBy("mint").agg(F.sum("balance").alias("s"), F.max("supply").alias("supply")).where("s > supply")
    return own.union(total.select("mint", F.lit(None).cast(held.schema["wallet"].dataType), F.lit("supply_exceeded")))
