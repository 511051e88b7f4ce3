"""What a raw update is about, and how many there are of each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import asof
from .quality import class_of

# The 21 classes, by the lane they go to and how much they matter.
LANES = {
    ("critical_launch", "critical"): ["pump_token_created", "transaction_token_created"],
    ("mapping", "mapping_only"): ["transaction_mapping_hint_only", "creator_funding_hint"],
    ("vault_delta", "active_tracked"): ["bonding_curve_vault_change"],
    ("trade_delta", "active_tracked"): ["pump_trade_active_mint", "transaction_active_mint"],
    ("holder_delta", "active_tracked"): ["transaction_active_account", "token_account_update_active_mint", "holder_owner_change"],
    ("cheap_counter", "cheap_skip"): [
        "pump_trade_untracked_mint", "pump_trade_tombstoned_mint", "transaction_untracked_pump", "transaction_account_pinned_unknown", "transaction_tombstoned_mint",
        "transaction_duplicate_signature", "token_account_update_untracked", "other_untracked", "slot_or_liveness_reader_side",
    ],
    ("cheap_counter", "unknown"): ["pump_trade_unknown_mint", "malformed_or_unknown"],
}


def classified(updates: DataFrame, marks: DataFrame, mapping: DataFrame, roles: DataFrame) -> DataFrame:
    """(id, class, lane, relevance, deep) of every update by what was tracked, tombstoned, mapped and pinned at its time.

    updates: id, us, kind (slot, status, account, transaction), signature, body (false: can't be read), create, trade,
    broken, inner_create, pump (what its instructions are), mint (hint), accounts, balance_mints (arrays), owner
    (token, system, other), empty. marks: mint, us, status (active, tombstoned); mapping: account, us, mint; roles:
    account, us, role (pin, curve, creator): the last at or before an update's time counts. A signature's first update by (us,
    id) is no duplicate.
    """
    c = F.col
    one = updates.select("id", "us", F.explode(F.array_distinct("accounts")).alias("account"))
    known = asof(asof(one, mapping.withColumnRenamed("mint", "m"), ["account"], "us", "m"), roles, ["account"], "us", "role")
    mints = updates.select("id", "us", F.explode("balance_mints").alias("mint"), F.lit("balance").alias("via"))
    mints = mints.union(known.where("m is not null").select("id", "us", c("m").alias("mint"), F.lit("mapped"))).union(updates.where("mint is not null").select("id", "us", "mint", F.lit("hint"))).distinct()
    status = asof(mints, marks, ["mint"], "us", "status")
    has = lambda s, *via: F.bool_or((c("status") == s) & c("via").isin(*via))
    by_mint = status.groupBy("id").agg(has("active", "balance").alias("active"), has("active", "mapped").alias("active_account"), has("tombstoned", "balance", "mapped").alias("dead"), F.bool_or(c("via") != "hint").alias("hinted"), has("active", "hint").alias("hint_active"), has("tombstoned", "hint").alias("hint_dead"))
    role = lambda r: F.bool_or(c("role") == r).alias(r)
    by_account = known.groupBy("id").agg(role("pin"), role("curve"), role("creator"))
    again = F.row_number().over(Window.partitionBy("signature").orderBy("us", "id")) > 1
    x = updates.withColumn("again", c("signature").isNotNull() & again).join(by_mint, "id", "left").join(by_account, "id", "left")
    yes = lambda n: F.coalesce(c(n), F.lit(False))
    account, tx = c("kind") == "account", c("kind") == "transaction"
    token = account & (c("owner") == "token")
    rules = [
        (c("kind") == "slot", "slot_or_liveness_reader_side"),
        (c("kind") == "status", "other_untracked"),
        (account & yes("empty"), "other_untracked"),
        (token & yes("active_account"), "token_account_update_active_mint"),
        (token, "token_account_update_untracked"),
        (account & yes("curve"), "bonding_curve_vault_change"),
        (account & (c("owner") == "system") & yes("creator"), "creator_funding_hint"),
        (account, "holder_owner_change"),
        (tx & c("again"), "transaction_duplicate_signature"),
        (tx & ~yes("body"), "malformed_or_unknown"),
        (tx & yes("create"), "pump_token_created"),
        (tx & yes("trade") & c("mint").isNull(), "pump_trade_unknown_mint"),
        (tx & yes("trade") & yes("hint_dead"), "pump_trade_tombstoned_mint"),
        (tx & yes("trade") & yes("hint_active"), "pump_trade_active_mint"),
        (tx & yes("trade"), "pump_trade_untracked_mint"),
        (tx & yes("broken"), "malformed_or_unknown"),
        (tx & yes("inner_create"), "transaction_token_created"),
        (tx & yes("active"), "transaction_active_mint"),
        (tx & yes("active_account"), "transaction_active_account"),
        (tx & yes("dead"), "transaction_tombstoned_mint"),
        (tx & yes("pin"), "transaction_account_pinned_unknown"),
        (tx & yes("pump"), "transaction_untracked_pump"),
        (tx & yes("hinted"), "transaction_mapping_hint_only"),
        (tx, "other_untracked"),
    ]
    x = x.withColumn("class", class_of(rules, "malformed_or_unknown"))
    lane = class_of([(c("class").isin(v), k[0]) for k, v in LANES.items()], "cheap_counter")
    relevance = class_of([(c("class").isin(v), k[1]) for k, v in LANES.items()], "unknown")
    return x.select("id", "class", lane.alias("lane"), relevance.alias("relevance"), relevance.isin("critical", "active_tracked").alias("deep"))


PERCENTILES = (50, 90, 95, 99)


def volume(updates: DataFrame, key: str, value: str, top: int = 10) -> DataFrame:
    """B14, exact: per class its updates, keys, lower-nearest percentiles of value, and its `top` keys by count, then key.

    Percentiles come from counts by value, keys from counts by key, so that a class is never one sorted group of rows.
    """
    counts = updates.groupBy("class", key).agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("class").orderBy(F.desc("n"), key)
    best = counts.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= top)
    keys = best.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", key, "n"))), lambda x: F.concat_ws(":", x[key].cast("string"), x["n"].cast("string"))), "|").alias("top_keys"))
    sizes = counts.groupBy("class").agg(F.sum("n").alias("updates"), F.count(F.lit(1)).alias("keys"))
    steps = updates.where(F.col(value).isNotNull()).groupBy("class", value).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("class").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    seen = steps.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy("class"))})
    at = lambda p: F.min(F.when(F.col("upto") > F.expr(f"(total - 1) * {p} div 100"), F.col(value))).alias(f"p{p}")
    return sizes.join(seen.groupBy("class").agg(*[at(p) for p in PERCENTILES]), "class", "left").join(keys, "class")


def sketches(updates: DataFrame, by: list[str], key: str, value: str, items: int = 400, precision: int = 400) -> DataFrame:
    """B14, as sketches: (by, n, kll, heavy) that merge over any grouping: a quantile sketch of value and the heavy hitters of key.

    A KLL sketch of precision k tells ranks to about 2.3 / k^0.9 of its rows; of `items` counted keys, those with
    more than 1 / (0.75 items) of the rows are all there, each count off by that much at most. Neither grows with its rows.
    """
    return updates.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(precision)).alias("kll"), F.expr(f"approx_top_k_accumulate(`{key}`, {items})").alias("heavy"))


def from_sketches(parts: DataFrame, by: list[str], top: int = 10, items: int = 400) -> DataFrame:
    """(by, updates, p50.., top_keys) of sketches, merged over what `by` leaves out."""
    merged = parts.groupBy(*by).agg(F.sum("n").alias("updates"), F.kll_merge_agg_double("kll").alias("kll"), F.expr(f"approx_top_k_combine(heavy, {items})").alias("heavy"))
    keys = F.expr(f"array_join(transform(approx_top_k_estimate(heavy, {top}), x -> concat_ws(':', x.item, x.count)), '|')")
    return merged.select(*by, "updates", *[F.kll_sketch_get_quantile_double("kll", F.lit(p / 100)).alias(f"p{p}") for p in PERCENTILES], keys.alias("top_keys"))
