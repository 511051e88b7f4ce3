"""The provided tables seen as trades, launches, holders, funding and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with a microsecond clock: purchases are buys, errors are sells; price = quote / tokens varies with the wallet."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')")
    wallet = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("user_id").alias("mint"),
        wallet.alias("wallet"),
        F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("side"),
        F.col("value").alias("quote"),
        (F.lit(10.0) + wallet).alias("tokens"),
        (F.col("value") / (F.lit(10.0) + wallet)).alias("price"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_id").alias("seq"),
    )


def ev_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mint, launch_us): the first signup of each user."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.groupBy(F.col("user_id").alias("mint")).agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("launch_us"))


def li_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades in volume, without repeated lines: a line is one trade of its order's customer in its part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
    lines = spread(lines, lines.count(), "l_orderkey").distinct()  # by order at once, as the join wants them
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    quote = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("mint"),
        F.col("o_custkey").alias("wallet"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        quote.alias("quote"),
        F.col("l_quantity").alias("tokens"),
        (quote / F.col("l_quantity")).alias("price"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"),
        (quote * F.col("l_tax")).alias("fee"),
        F.col("l_suppkey").alias("account"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus").alias("seq"),
    )


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mint, wallet, balance): tokens bought less tokens sold, where more than none is left."""
    signed = F.when(F.col("side") == "buy", F.col("tokens")).otherwise(-F.col("tokens"))
    held = li_trades(spark, sf_dir).groupBy("mint", "wallet").agg(F.sum(signed).alias("balance"))
    return held.where("balance > 0")


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(funder, wallet, amount, at, edge): an order is a transfer from the customer's nation, here with the clerk's month as funder of many."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        (F.col("c_nationkey") * 100 + F.col("c_custkey") % 37).cast("long").alias("funder"),
        F.col("o_custkey").alias("wallet"),
        F.col("o_totalprice").alias("amount"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
        F.col("o_orderkey").alias("edge"),
    )


#: The same views for the SQL twins, to be put after WITH.
VIEWS = {
    "ev": """ev AS (
        SELECT user_id AS mint, CAST(json_extract_string(props, '$.k') AS BIGINT) AS wallet,
            CASE WHEN event_type = 'purchase' THEN 'buy' ELSE 'sell' END AS side, value AS quote,
            10.0 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
            value / (10.0 + CAST(json_extract_string(props, '$.k') AS BIGINT)) AS price, epoch_us(ts) AS us, event_id AS seq
        FROM events WHERE event_type IN ('purchase', 'error'))""",
    "launch": "launch AS (SELECT user_id AS mint, min(epoch_us(ts)) AS launch_us FROM events WHERE event_type = 'signup' GROUP BY 1)",
    "li": """li AS (
        SELECT l_partkey AS mint, o_custkey AS wallet, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side,
            l_extendedprice * (1 - l_discount) AS quote, l_quantity AS tokens, l_extendedprice * (1 - l_discount) / l_quantity AS price,
            epoch_us(l_shipdate) AS us, l_extendedprice * (1 - l_discount) * l_tax AS fee, l_suppkey AS account,
            (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus) AS seq
        FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate FROM lineitem)
        JOIN orders ON l_orderkey = o_orderkey)""",
    "bal": """bal AS (
        SELECT mint, wallet, sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) AS balance FROM li GROUP BY 1, 2
        HAVING sum(CASE WHEN side = 'buy' THEN tokens ELSE -tokens END) > 0)""",
    "fund": """fund AS (
        SELECT CAST(c_nationkey * 100 + c_custkey % 37 AS BIGINT) AS funder, o_custkey AS wallet, o_totalprice AS amount, epoch_us(o_orderdate) AS us, o_orderkey AS edge
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
}


def with_views(*names: str, sql: str) -> str:
    return "WITH " + ", ".join(VIEWS[n] for n in names) + (", " if sql.lstrip()[:1].islower() else " ") + sql.strip()
