"""The canonical metrics of a mint as rows, each with its unit, source, confidence, reason and parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import LAMPORTS_PER_SOL, TOTAL_SUPPLY, curve_progress, market_cap, price_of

# What a metric's parity is by its confidence, and the reasons that go with each.
PARITY = {"verified": "passed", "confidence_scored": "confidence_scored", "unavailable": "unavailable", "failed_invariant": "failed"}
PRICE_SOURCE, CURVE_SOURCE, CAP_SOURCE = "normalized_events.bonding_curve_update", "normalized_events.bonding_curve_update.real_token_reserves", "metric_engine.price_sol_per_token"
REASONS = {
    "price_sol_per_token": ("computed from matching virtual SOL/token reserve pair", "missing or zero virtual reserve denominator"),
    "market_cap_quote_1b": ("price * 1B Pump.fun convention", "price unavailable"),
    "market_cap_quote_total_supply": ("price * Pump.fun curve-economic supply denominator; RPC mint supply is diagnostic-only when it diverges", "price unavailable"),
    "curve_progress_pct": ("real token reserves converted to UI before reserved-supply formula", "missing curve-state snapshot or invalid token decimals"),
    "dev_balance": ("owner-summed holder balance for creator wallet", "creator wallet holder balance unavailable"),
    "dev_holding_pct_total_supply": ("creator raw balance / canonical raw total supply", "creator wallet holder balance unavailable"),
    "dev_holding_pct_circulating": ("uses canonical total supply minus creator balance; circulating denominator is a convention", "creator wallet holder balance unavailable"),
}
EXCEEDS, NO_CIRCULATION = "creator balance exceeds canonical Pump.fun supply", "circulating denominator is zero"


def canonical_metrics(rows: DataFrame, dev_source: str) -> DataFrame:
    """Seven rows a mint. rows: mint, virtual_quote_lamports, virtual_token_raw, real_token_raw, decimals, dev_balance_raw; all but mint may be null.

    A dev balance above the supply fails the invariant: the balance is given as failed, its shares are unavailable.
    """
    c = F.col
    unit = F.pow(F.lit(10.0), c("decimals"))
    price = price_of(c("virtual_quote_lamports") / LAMPORTS_PER_SOL, c("virtual_token_raw") / unit)
    progress = F.when((c("real_token_raw") >= 0) & c("decimals").isNotNull(), curve_progress(c("real_token_raw") / unit))
    dev, supply = F.greatest(c("dev_balance_raw"), F.lit(0)), F.lit(float(TOTAL_SUPPLY)) * unit
    over = F.coalesce(dev > supply, F.lit(False))

    def row(name: str, family: str, value: Column, unit: str, source: str, good: str = "verified", backtest: bool = True, failed: Column | None = None, why: Column | None = None) -> Column:
        fine, missing = REASONS[name]
        failed = F.lit(False) if failed is None else failed
        confidence = F.when(value.isNull(), "unavailable").when(failed, "failed_invariant").otherwise(good)
        return F.struct(
            F.lit(name).alias("metric_name"), F.lit(family).alias("metric_family"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(source).alias("source_artifact"), confidence.alias("confidence"),
            F.when(value.isNotNull(), F.when(failed, EXCEEDS).otherwise(fine)).alias("confidence_reason"), F.when(value.isNull(), F.lit(missing) if why is None else F.coalesce(why, F.lit(missing))).alias("unavailable_reason"),
            F.create_map(*[F.lit(v) for kv in PARITY.items() for v in kv])[confidence].alias("parity_status"), F.lit(backtest).alias("required_for_backtest"), F.lit(True).alias("required_for_tuning"),
        )

    holding, caps = "dev holdings", "market cap"
    why = F.when(dev.isNotNull() & over, EXCEEDS)
    metrics = [
        row("price_sol_per_token", "reserve-implied price", price, "SOL/token", PRICE_SOURCE),
        row("market_cap_quote_1b", caps, market_cap(price, 1_000_000_000), "SOL", CAP_SOURCE),
        row("market_cap_quote_total_supply", caps, market_cap(price, TOTAL_SUPPLY), "SOL", CAP_SOURCE),
        row("curve_progress_pct", "curve progress", progress, "percent", CURVE_SOURCE),
        row("dev_balance", holding, F.when(c("dev_balance_raw").isNotNull(), dev / unit), "tokens", dev_source, failed=over),
        row("dev_holding_pct_total_supply", holding, F.when(c("dev_balance_raw").isNotNull() & ~over, dev / supply), "ratio", dev_source, why=why),
        row("dev_holding_pct_circulating", holding, F.when(c("dev_balance_raw").isNotNull() & ~over & (supply > dev), dev / (supply - dev)), "ratio", dev_source, "confidence_scored", False, why=F.coalesce(why, F.when(dev == supply, NO_CIRCULATION))),
    ]
    return rows.select("mint", F.explode(F.array(*metrics)).alias("m")).select("mint", "m.*")
