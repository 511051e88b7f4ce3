"""Funding graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import running_digest


def edges(fundings: DataFrame) -> DataFrame:
    """(funder, wallet, amount, last_us, transfers)."""
    return fundings.groupBy("funder", "wallet").agg(F.sum("amount").alias("amount"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("transfers"))


def clusters(graph: DataFrame) -> DataFrame:
    """(wallet, cluster, members): the one-hop neighbourhood of each node (funders, funded and itself), not its component.

    The id is the first 20 characters of `cluster-` and the SHA-256 of the sorted members joined by |; NULL for a node alone.
    Members are hashed one after the other in order, so a hub may have any number of them.
    """
    g = graph.where("funder <> wallet").select(F.col("funder").cast("string").alias("a"), F.col("wallet").cast("string").alias("b")).distinct()
    both = g.union(g.select("b", "a")).distinct()
    members = both.select(F.col("a").alias("wallet"), "b").union(both.select("a", "a").distinct())
    near = running_digest(members, ["wallet"], "b", "digest")
    return near.select("wallet", F.substring(F.concat(F.lit("cluster-"), "digest"), 1, 20).alias("cluster"), F.col("n").cast("int").alias("members"))


def evidence(graph: DataFrame, payers: DataFrame, same_funder: float = 0.10, same_payer: float = 0.15) -> DataFrame:
    """(wallet, evidence): for each other wallet of the same funder, and of the same payer (payer, wallet), a weight. Group sizes give it, no pairs."""
    f = graph.select("funder", "wallet").distinct()
    a = f.join(f.groupBy("funder").agg((F.count(F.lit(1)) - 1).alias("k")), "funder").groupBy("wallet").agg((F.sum("k") * same_funder).alias("e"))
    p = payers.select("payer", "wallet").distinct()
    b = p.join(p.groupBy("payer").agg((F.count(F.lit(1)) - 1).alias("k")), "payer").groupBy("wallet").agg((F.sum("k") * same_payer).alias("e"))
    return a.union(b).groupBy("wallet").agg(F.least(F.lit(1.0), F.sum("e")).alias("evidence"))


def related(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """(wallet): all that share a funder with a seed (wallet), and the seeds."""
    funders = graph.join(seeds, "wallet", "left_semi").select("funder").distinct()
    return graph.join(funders, "funder", "left_semi").select("wallet").union(seeds.select("wallet")).distinct()


def profile(graph: DataFrame, launches: DataFrame, us_window: int) -> DataFrame:
    """(funder, wallets, amount, mean_amount, density, burst, multi_launch): how a funder works; launches has (wallet, mint)."""
    many = launches.groupBy("wallet").agg(F.count_distinct("mint").alias("mints"))
    x = graph.join(many, "wallet", "left")
    return x.groupBy("funder").agg(
        F.count(F.lit(1)).alias("wallets"),
        F.sum("amount").alias("amount"),
        (F.sum("amount") / F.count(F.lit(1))).alias("mean_amount"),
        (F.sum("transfers") / F.count(F.lit(1))).alias("density"),
        (F.max("last_us") - F.min("last_us") <= us_window).alias("burst"),
        F.count_if(F.col("mints") > 1).alias("multi_launch"),
    )
