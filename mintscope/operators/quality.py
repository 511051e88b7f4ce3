"""Normalisation, deduplication, gaps and reconciliation of event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import fold_sorted

#: Kinds that a replay takes from a stored log, with gaps that are not of a replay's own making.
REPLAYED = ["token_created", "buy", "sell", "curve_update", "holder_update", "wallet_funding", "observed_tx"]


def dedup(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def dedup_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(seen, applied, deduped) over all rows; groups are pre-aggregated by key."""
    per = rows.groupBy(*keys).count()
    return per.agg(F.sum("count").alias("seen"), F.count(F.lit(1)).alias("applied"), (F.sum("count") - F.count(F.lit(1))).alias("deduped"))


def newest_versions(rows: DataFrame, keys: list[str], version: str, order: list[str]) -> DataFrame:
    """Rows whose version is above all that arrived before them for their key."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    high = F.max(version).over(before)
    return rows.withColumn("__high", high).where(F.col("__high").isNull() | (F.col(version) > F.col("__high"))).drop("__high")


def slot_gaps(slots: DataFrame, source: str, slot: str, order: list[str], tolerance: int = 0, parent: str | None = None) -> DataFrame:
    """One row per gap: a jump beyond tolerance is high; a parent ahead of the last slot medium."""
    w = Window.partitionBy(source).orderBy(*order)
    x = slots.withColumn("last_slot", F.lag(slot).over(w))
    high = F.col(slot) > F.col("last_slot") + tolerance + 1
    severity = F.when(high, "high")
    if parent:
        severity = severity.when(F.col(parent) > F.col("last_slot"), "medium")
    return x.withColumn("severity", severity).where("severity is not null").select(source, (F.col("last_slot") + 1).alias("start_slot"), (F.col(slot) - 1).alias("end_slot"), "severity")


def sequence_gaps(frames: DataFrame, stream: str, seq: str) -> DataFrame:
    """Where a stream doesn't start at 1 or doesn't go on by 1: (stream, expected, got)."""
    last = F.lag(seq, 1, 0).over(Window.partitionBy(stream).orderBy(seq))
    return frames.withColumn("expected", last + 1).where(F.col(seq) != F.col("expected")).select(stream, "expected", F.col(seq).alias("got"))


def sequence_verdicts(frames: DataFrame, stream: str, seq: str, order: str, ok: str) -> DataFrame:
    """Frames with a verdict in arrival order. The expected number goes on only after a frame that passes, so after a failure the same number is awaited.

    The fold's state is the last number that passed; a stream may have any number of frames.
    """

    def step(last, o, s, k):
        passed = s == last + 1 and bool(k)
        return (s if passed else last), (o, s, passed)

    rows = frames.select(stream, F.col(order).cast("long").alias(order), F.col(seq).cast("long").alias("__seq"), F.col(ok).alias("__ok"))
    out = fold_sorted(rows, [stream], [order], [order, "__seq", "__ok"], f"__{order} long, __s long, passed boolean", lambda: 0, step)
    return out.select(stream, F.col(f"__{order}").alias(order), F.col("__s").alias(seq), "passed")


def payload_ok(payload: Column, digest: Column) -> Column:
    return F.sha2(payload, 256) == digest


def balance_changes(pre: DataFrame, post: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old, new, delta): accounts on either side; one that is closed goes to 0."""
    a, b = pre.withColumnRenamed("amount", "old"), post.withColumnRenamed("amount", "new")
    both = a.join(b, keys, "full")
    old, new = F.coalesce("old", F.lit(0)), F.coalesce("new", F.lit(0))
    return both.select(*keys, old.alias("old"), new.alias("new"), (new - old).alias("delta"))


def transfer_edges(tx: DataFrame) -> DataFrame:
    """Funding edges from (signature, accounts, pre, post): account 0 funds account 1 by its lamport gain, if any."""
    gain = F.get("post", F.lit(1)) - F.get("pre", F.lit(1))
    return tx.select("signature", F.get("accounts", F.lit(0)).alias("funder"), F.get("accounts", F.lit(1)).alias("wallet"), gain.alias("amount")).where("amount > 0")


def owner_delta(balances: Column, owner: Column, mint: Column) -> Column:
    """Net amount of an array of (owner, mint, old, new) for one owner and mint."""
    own = F.filter(balances, lambda b: (b["owner"] == owner) & (b["mint"] == mint))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b["new"] - b["old"])


def shape_hash(parts: Column) -> Column:
    """SHA-256 of an array's elements joined by /, each with its length, so that no two shapes collide."""
    return F.sha2(F.array_join(F.transform(parts, lambda p: F.concat(F.char_length(p).cast("string"), F.lit(":"), p)), "/"), 256)


def evidence_tag(flags: dict[str, Column]) -> Column:
    return F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in flags.items()])


def noisy_keys(updates: DataFrame, key: str, us: str, per_second: int, total: int) -> DataFrame:
    """(key, degraded_us, reason): the first second in which a key exceeds its rate, or its running total its queue."""
    second = updates.groupBy(key, F.expr(f"{us} div 1000000").alias("s")).count()
    run = F.sum("count").over(Window.partitionBy(key).orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    x = second.withColumn("run", run)
    reason = F.when(F.col("count") > per_second, "rate").when(F.col("run") > total, "queued")
    hit = x.withColumn("reason", reason).where("reason is not null")
    return hit.groupBy(key).agg((F.min("s") * 1_000_000).alias("degraded_us"), F.min_by("reason", "s").alias("reason"))


def coalesced(updates: DataFrame, key: str, us: str, interval_us: int, order: list[str]) -> DataFrame:
    """The last update of each key and interval."""
    w = Window.partitionBy(key, F.expr(f"{us} div {interval_us}")).orderBy(*[F.desc(c) for c in order])
    return updates.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def gap_intervals(gaps: DataFrame, end_us: int) -> DataFrame:
    """(scope, key, start_us, stop_us): gaps (scope, key, us, recovered) are open until the next recovery of their scope and key."""
    w = Window.partitionBy("scope", "key").orderBy("us").rowsBetween(1, Window.unboundedFollowing)
    until = F.min(F.when(F.col("recovered"), F.col("us"))).over(w)
    return gaps.withColumn("stop_us", F.coalesce(until, F.lit(end_us))).where("not recovered").select("scope", "key", F.col("us").alias("start_us"), "stop_us")


def trade_allowed(events: DataFrame, intervals: DataFrame, bucket_us: int) -> DataFrame:
    """Events with allowed = no open gap of their key, and no open gap of a wider scope. Intervals meet events by time bucket, tokens also by key."""
    spans = intervals.withColumn("b", F.explode(F.sequence(F.expr(f"start_us div {bucket_us}"), F.expr(f"(stop_us - 1) div {bucket_us}"))))
    x = events.withColumn("b", F.expr(f"us div {bucket_us}"))
    inside = "us >= start_us and us < stop_us"
    token = x.join(spans.where("scope = 'token'").withColumnRenamed("key", "mint"), ["b", "mint"]).where(inside).select("seq")
    wide = x.join(spans.where("scope <> 'token'").drop("key"), "b").where(inside).select("seq")
    blocked = token.union(wide).distinct().withColumn("hit", F.lit(True))
    return events.join(blocked, "seq", "left").withColumn("allowed", F.col("hit").isNull()).drop("hit")


def without_reverted(events: DataFrame, reverted: DataFrame) -> DataFrame:
    """Events but for tentative ones whose signature was reverted later: reverted has (signature, at)."""
    last = reverted.groupBy("signature").agg(F.max("at").alias("reverted_us"))
    x = events.join(last, "signature", "left")
    return x.where("not (tentative and reverted_us is not null and reverted_us >= us)").drop("reverted_us")


def corrected(events: DataFrame, key: str) -> DataFrame:
    """(key, status, tentative_only): the most canonical status each key reached."""
    rank = F.when(F.col("status") == "finalized", 3).when(F.col("status") == "confirmed", 2).when(F.col("status") == "processed", 1).otherwise(0)
    return events.groupBy(key).agg(F.max_by("status", F.struct(rank, "status")).alias("status"), F.every(rank == 0).alias("tentative_only"))


def lookahead_violations(events: DataFrame, key: str, us: str, order: str) -> DataFrame:
    before = F.lag(us).over(Window.partitionBy(key).orderBy(order))
    return events.withColumn("before_us", before).where(F.col("before_us") > F.col(us)).select(key, order, us, "before_us")


def resolved_updates(updates: DataFrame, creates: DataFrame, account: str) -> DataFrame:
    """Curve updates with the mint of their account's create event; an update before it is released by it."""
    x = updates.join(creates.select(account, "mint", F.col("us").alias("created_us")), account)
    return x.withColumn("released_us", F.greatest("us", "created_us"))


def trade_amounts(tokens_delta: Column, stated_tokens: Column, quote_delta: Column, stated_quote: Column) -> tuple[Column, Column]:
    """Tokens: the wallet's delta, else what is stated, else 1. Quote: the wallet's, else what is stated, else 0."""
    return F.coalesce(F.nullif(F.abs(tokens_delta), F.lit(0)), F.nullif(stated_tokens, F.lit(0)), F.lit(1)), F.coalesce(F.nullif(F.abs(quote_delta), F.lit(0)), stated_quote, F.lit(0))


def priority_fee(limit: Column, price: Column, up: bool = False) -> Column:
    """limit x price / 1e6 in lamports: rounded down as observed, up in the cost model."""
    fee = limit * price / F.lit(1_000_000)
    return (F.ceil(fee) if up else F.floor(fee)).cast("long")


def retained(events: DataFrame, launches: DataFrame, after: int) -> DataFrame:
    """Events of launched mints, and others whose slot is within `after` of a launch of their program: (program, slot)."""
    own = events.join(launches.select("mint").distinct(), "mint", "left_semi").select(*events.columns)
    slots = launches.select("program", F.explode(F.sequence(F.col("slot"), F.col("slot") + after)).alias("slot")).distinct()
    return own.union(events.join(slots, ["program", "slot"], "left_semi").select(*events.columns)).distinct()


def replayed(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind").isin(*REPLAYED) | ((F.col("kind") == "data_gap") & (F.col("source") != "replay")))


def class_of(rules: list[tuple[Column, str]], other: str) -> Column:
    """The name of the first rule that holds."""
    out = F.when(F.lit(False), F.lit(other))
    for c, n in rules:
        out = out.when(c, F.lit(n))
    return out.otherwise(F.lit(other))


def preferred_source(rows: DataFrame, keys: list[str], ranks: dict[str, int]) -> DataFrame:
    """One row per key, of the source that comes first; sources that aren't named come last, by name."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col("source")], F.lit(len(ranks)))
    return rows.groupBy(*keys).agg(F.min_by("source", F.struct(rank, "source")).alias("source"), F.count(F.lit(1)).alias("reports"))


def enriched_curve(updates: DataFrame) -> DataFrame:
    """Curve updates (quote, base, price) with price, cap and progress, where each comes from and how far it is trusted: observed 1.0, derived 0.7, missing 0."""
    from ..functions.math import curve_progress, market_cap, price_of

    derived = price_of(F.col("quote"), F.col("base"))
    x = updates.withColumns({
        "price_source": F.when(F.col("price").isNotNull(), "observed").when(derived.isNotNull(), "derived").otherwise("missing"),
        "price": F.coalesce("price", derived),
        "progress": curve_progress(F.col("base")),
    })
    confidence = F.when(F.col("price_source") == "observed", 1.0).when(F.col("price_source") == "derived", 0.7).otherwise(0.0)
    return x.withColumns({"market_cap": market_cap(F.col("price")), "price_confidence": confidence})
