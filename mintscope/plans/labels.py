"""Research tables: as-of features, outcome labels, gates, audits, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZONS = [5, 10, 30, 60, 120, 300, 900]


def asof_base(labels: DataFrame, horizons: list[int] = HORIZONS, unit_us: int = 1_000_000) -> DataFrame:
    """Labels (mint, first_us) by horizons: (mint, horizon, asof_us). The horizons are a literal array, so no join."""
    x = labels.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return x.withColumn("asof_us", F.col("first_us") + F.col("horizon") * unit_us)


def asof_features(trades: DataFrame, labels: DataFrame, horizons: list[int] = HORIZONS, unit_us: int = 1_000_000) -> DataFrame:
    """(mint, horizon, ...): what was known at first_us + horizon: counts, volumes, distinct wallets up to then; NULL where the log ends before."""
    x = trades.join(labels, "mint").where("us >= first_us")
    # each trade counts from its first horizon on; horizons are few, so a trade is written once for each it falls in
    h = F.array(*[F.lit(v) for v in horizons])
    x = x.withColumn("horizon", F.explode(F.filter(h, lambda v: F.col("us") <= F.col("first_us") + v * unit_us)))
    buy = F.col("side") == "buy"
    found = x.groupBy("mint", "horizon").agg(
        F.count_if(buy).alias("buys"),
        F.count_if(~buy).alias("sells"),
        F.sum("quote").alias("volume"),
        F.sum(F.when(buy, F.col("quote")).otherwise(-F.col("quote"))).alias("net_flow"),
        F.count_distinct("wallet").alias("wallets"),
    )
    base = asof_base(labels, horizons, unit_us)
    reached = F.col("asof_us") <= F.col("last_us")
    out = base.join(found, ["mint", "horizon"], "left")
    filled = {c: F.when(reached, F.coalesce(c, F.lit(0).cast(found.schema[c].dataType))) for c in found.columns[2:]}
    return out.select("mint", "horizon", "asof_us", reached.alias("reached"), *[v.alias(k) for k, v in filled.items()])


def positive_outcome(curve_end: Column, curve_max: Column, flow: Column, volume: Column, holders: Column, liquidity: Column) -> tuple[Column, Column]:
    """(strength, best favourable move) from what came after a decision: HIGH, POSITIVE, NEAR_POSITIVE or LOW by fixed cuts."""
    liquid = liquidity > 0
    high = (curve_end >= 75) | (curve_max >= 80) | ((flow >= 10) & (volume > 0) & (holders >= 5)) | (liquid & (curve_end >= 50))
    positive = (curve_end >= 35) | (curve_max >= 45) | ((flow >= 3) & (volume > 0)) | (liquid & (flow > 0)) | ((holders >= 3) & (flow > 0))
    near = (curve_end >= 28) | (flow >= 2) | ((volume > 0) & (holders > 0))
    t = lambda c: F.coalesce(c, F.lit(False))
    best = F.greatest(F.coalesce(curve_max, F.lit(0.0)), F.coalesce(curve_end, F.lit(0.0)), F.least(F.greatest(flow, F.lit(0)) * 5.0, F.lit(50.0)), F.when(volume > 0, 25.0).otherwise(0.0), F.when(holders >= 3, 25.0).otherwise(0.0), F.when(liquid, 20.0).otherwise(0.0))
    return F.when(t(high), "HIGH").when(t(positive), "POSITIVE").when(t(near), "NEAR_POSITIVE").otherwise("LOW"), best


def forward_deltas(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """For each (keys, horizon): the last and the largest later value of each measure less the present one."""
    from pyspark.sql.window import Window

    after = Window.partitionBy(*keys).orderBy("horizon").rowsBetween(1, Window.unboundedFollowing)
    out = rows
    for m in measures:
        out = out.withColumns({f"{m}_forward": F.last(m).over(after) - F.col(m), f"{m}_peak": F.max(m).over(after) - F.col(m)})
    return out


def best_label(rows: DataFrame, order: list[str], key: str = "mint") -> DataFrame:
    """Per mint: its best strength by `order`, first and last horizon with it, how many horizons there are, and a class."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("strength"))
    x = rows.withColumn("rank", rank)
    best = x.groupBy(key).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("horizons"))
    first = x.join(best.select(key, F.col("rank").alias("best")), key).where("rank = best").groupBy(key).agg(F.min("horizon").alias("first_horizon"), F.max("horizon").alias("last_horizon"))
    y = best.join(first, key)
    name = F.element_at(F.array(*[F.lit(o) for o in order]), F.col("rank").cast("int"))
    return y.select(key, name.alias("strength"), "horizons", "first_horizon", "last_horizon", F.when(F.col("rank") == 1, "winner").when(F.col("rank") == 2, "candidate").otherwise("rest").alias("class"))


def gate(checks: dict[str, Column], passed: str, failed: str) -> tuple[Column, Column]:
    """(decision, reasons joined by |): all failed checks in order; missing counts as failed."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))
    return F.when(F.size(reasons) == 0, passed).otherwise(failed), F.array_join(reasons, "|")


def first_match(rules: list[tuple[str, Column]], other: str) -> Column:
    out = F.when(F.lit(False), other)
    for n, c in rules:
        out = out.when(c, n)
    return out.otherwise(other)


def funnel(decisions: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, mints, step_ratio): mints whose furthest stage is this or a later one, by the stage before; decisions has (mint, stage index from 0)."""
    furthest = decisions.groupBy("mint").agg(F.max("stage").alias("stage"))
    marks = furthest.select(F.explode(F.sequence(F.lit(0), F.col("stage"))).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("mints"))
    name = F.element_at(F.array(*[F.lit(s) for s in stages]), F.col("i").cast("int") + 1)
    before = F.expr("lag(mints) over (order by i)")  # as many rows as stages
    return marks.withColumn("before", before).select(name.alias("stage"), "mints", (F.col("mints") / F.col("before")).alias("step_ratio"))


def ablation(rows: DataFrame, blockers: str, result: str, win: float, loss: float) -> DataFrame:
    """(blocker, blocked, recovered_winners, admitted_losers): what dropping each gate alone would let in."""
    only = rows.where(F.size(blockers) == 1).select(F.explode(blockers).alias("blocker"), result)
    return only.groupBy("blocker").agg(F.count(F.lit(1)).alias("blocked"), F.count_if(F.col(result) > win).alias("recovered_winners"), F.count_if(F.col(result) <= loss).alias("admitted_losers"))


def leakage_audit(features: DataFrame, forbidden: list[str], tolerance_us: int, splits: DataFrame, unit_us: int = 1_000_000) -> DataFrame:
    """(check, key) violations, none if clean: forbidden columns, rows known later than their horizon, mints in more than one split."""
    spark = features.sparkSession
    bad = spark.createDataFrame([("forbidden_column", c) for c in sorted(set(forbidden) & set(features.columns))], "check string, key string")
    late = features.where(F.col("feature_us") > F.col("first_us") + F.col("horizon") * unit_us + tolerance_us).select(F.lit("late_feature").alias("check"), F.concat_ws(":", "mint", "horizon").alias("key"))
    twice = splits.groupBy("mint").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("two_splits").alias("check"), F.col("mint").cast("string").alias("key"))
    return bad.union(late).union(twice)


def chronological(rows: DataFrame, buckets: int = 64) -> tuple[DataFrame, int]:
    """rows (mint, first_us) with their place i from 0 by (first_us, mint), and how many there are.

    The rows before a time bucket are summed from the buckets' counts, so no task sorts all rows.
    """
    bounds = rows.agg(F.min("first_us").alias("lo"), F.max("first_us").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not bounds["n"]:
        return rows.withColumn("i", F.lit(0).cast("long")), 0
    width = max(1, (bounds["hi"] - bounds["lo"]) // buckets + 1)
    x = rows.withColumn("b", F.expr(f"(first_us - {bounds['lo']}) div {width}"))
    before = x.groupBy("b").count().withColumn("before", F.expr("coalesce(sum(count) over (order by b rows between unbounded preceding and 1 preceding), 0)"))  # one row a bucket
    x = x.join(F.broadcast(before.select("b", "before")), "b").withColumn("i", F.expr("row_number() over (partition by b order by first_us, mint) - 1") + F.col("before"))
    return x.drop("b", "before"), bounds["n"]


def walk_forward(labels: DataFrame, train: float = 0.6, validate: float = 0.2, embargo: int = 5, buckets: int = 64) -> DataFrame:
    """(mint, split): chronological train, validation, test, without `embargo` rows after each cut; labels has (mint, first_us)."""
    x, n = chronological(labels.groupBy("mint").agg(F.min("first_us").alias("first_us")), buckets)
    a, z = int(n * train), int(n * (train + validate))
    i = F.col("i")
    split = F.when(i < a, "train").when(i < a + embargo, None).when(i < z, "validation").when(i < z + embargo, None).otherwise("test")
    return x.withColumn("split", split).where("split is not null").select("mint", "split")


def walk_forward_two_sided(labels: DataFrame, train: float = 0.6, validate: float = 0.2, buckets: int = 64) -> DataFrame:
    """(mint, split) of every label row, repeated mints included, without a hundredth of the rows (1 to 25) on either side of each cut."""
    x, n = chronological(labels, buckets)
    a, z, e = int(n * train), int(n * (train + validate)), min(25, max(1, n // 100))
    i = F.col("i")
    split = F.when(i < a - e, "train").when((i >= a + e) & (i < z - e), "validation").when(i >= z + e, "test")
    return x.withColumn("split", split).where("split is not null").select("mint", "split")


def readiness(counts: DataFrame, minima: dict[str, float]) -> DataFrame:
    """One row of counts with a decision and all that falls short."""
    short = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) < m, F.lit(c)) for c, m in minima.items()])), "|")
    return counts.withColumns({"blockers": short, "decision": F.when(short == "", "ready").otherwise("not_ready")})


def freeze(df: DataFrame, name: str) -> DataFrame:
    """(dataset, rows, content_hash): an order-free hash of all rows."""
    return df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"), F.sum("h").cast("string").alias("content_hash"))


def validation_rows(rows: DataFrame, keys: list[str], measure: str, exit_after: int) -> DataFrame:
    """For each (keys, horizon) with a known measure: best and worst later change, time to the best, and whether there was time to leave."""
    from ..operators.windows import horizon_peaks

    known = rows.where(F.col(measure).isNotNull())
    low = horizon_peaks(known.withColumn("neg", -F.col(measure)), keys, "neg").select(*keys, "horizon", (-F.col("peak")).alias("low"))
    x = horizon_peaks(known, keys, measure).join(low, [*keys, "horizon"]).join(known.select(*keys, "horizon", measure), [*keys, "horizon"])
    return x.select(*keys, "horizon", (F.col("peak") - F.col(measure)).alias("favourable"), (F.col("low") - F.col(measure)).alias("adverse"), "time_to_peak", ((F.col("peak") > F.col(measure)) & (F.col("time_to_peak") >= exit_after)).alias("could_exit"))
