"""Reserve, price and score arithmetic as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units and supplies of the launch programme.
LAMPORTS_PER_SOL = 1_000_000_000
TOKEN_UNITS = 1_000_000
TOTAL_SUPPLY = 1_000_000_000
RESERVED_SUPPLY = 206_900_000
INITIAL_REAL_RESERVES = 793_100_000


def lamports_to_sol(x: Column) -> Column:
    return x.cast("decimal(38,9)") / F.lit(LAMPORTS_PER_SOL)


def sol_to_lamports(x: Column) -> Column:
    return (x * LAMPORTS_PER_SOL).cast("long")


def raw_to_tokens(x: Column) -> Column:
    return x.cast("decimal(38,9)") / F.lit(TOKEN_UNITS)


def basis_points(x: Column, bps) -> Column:
    return x * bps / F.lit(10_000)


def price_of(quote: Column, base: Column) -> Column:
    """quote / base, NULL unless both are positive."""
    return F.when((quote > 0) & (base > 0), F.try_divide(quote, base))


def market_cap(price: Column, supply=TOTAL_SUPPLY) -> Column:
    return price * supply


def curve_progress(balance: Column) -> Column:
    """Per cent of the curve that has been sold, from the tokens still on it."""
    left = F.greatest(balance - RESERVED_SUPPLY, F.lit(0)) * 100 / F.lit(INITIAL_REAL_RESERVES)
    return F.least(F.greatest(F.lit(100) - left, F.lit(0)), F.lit(100)).cast("double")


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def known(x: Column) -> Column:
    """0 where missing: only for scores, never for stored features."""
    return F.coalesce(x.cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 unless b is positive."""
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(0.0))


def quotient(a: Column, b: Column) -> Column:
    """a / b by IEEE 754, as the SQL twins divide: infinite, or NaN for 0 / 0, where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.when(b == 0, a.cast("double") * F.lit(float("inf"))))


def exact_sum(x: Column) -> Column:
    """Sum of doubles in 18 decimals, so that the same values give the same sum in any order of rows; of doubles where one or the sum doesn't fit."""
    exact = x.try_cast("decimal(38,18)")
    return F.coalesce(F.when(F.count(exact) == F.count(x), F.try_sum(exact).cast("double")), F.sum(x))


def weighted(pairs: list[tuple[Column, float]]) -> Column:
    """Weighted mean; 0 if the weights don't add up to more."""
    total = sum(w for _, w in pairs)
    return reduce(lambda a, b: a + b, [known(c) * w for c, w in pairs]) / F.lit(total) if total > 0 else F.lit(0.0)


def impact_pct(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.abs((after - before) / before) * 100).otherwise(F.lit(0.0))


def exit_impact_pct(share: Column, balance: Column, depth: Column) -> Column:
    return clamp01(share * 70 + ratio(balance, depth) * F.lit(0.5 * 30)) * 100


def bucket_index(v: Column, thresholds: list[float]) -> Column:
    """How many of the thresholds v reaches."""
    return reduce(lambda a, b: a + b, [(v >= t).cast("int") for t in thresholds])


def range_label(v: Column, edges: list[int]) -> Column:
    """`lo-hi` of the edges around v, `lo+` beyond the last."""
    out = F.lit(f"{edges[-1]}+")
    for lo, hi in list(zip(edges, edges[1:]))[::-1]:
        out = F.when(v < hi, f"{lo}-{hi}").otherwise(out)
    return F.when(v.isNull(), None).otherwise(out)


def descriptive_bin(v: Column, low: float, high: float, nonpositive: str = "LOW") -> Column:
    """MISSING, LOW, MEDIUM or HIGH; `nonpositive` names what values of 0 and less are."""
    return F.when(v.isNull(), "MISSING").when(v <= 0, nonpositive).when(v >= high, "HIGH").when(v >= low, "MEDIUM").otherwise("LOW")


def risk_bin(v: Column, medium: float, high: float, unsafe: float) -> Column:
    return F.when(v.isNull(), "MISSING").when(v >= unsafe, "UNSAFE").when(v >= high, "HIGH").when(v >= medium, "MEDIUM").otherwise("LOW")
