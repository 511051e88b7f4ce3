"""Stream transformations; each takes and returns a streaming DataFrame with an event time `ts`."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first of each key within the watermark; a bound on time stands for a bound on memory."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def per_key_rate(events: DataFrame, key: str, width: str, most: int, late: str) -> DataFrame:
    """(key, start, n) of tumbling windows in which a key exceeds its budget."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", width), key).count()
    return n.where(F.col("count") > most).select(key, F.col("window.start").alias("start"), F.col("count").alias("n"))


def sliding_flow(trades: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Buy volume and net flow per mint in sliding windows: anchors on the slide, where the batch form has one per trade."""
    buy = F.col("side") == "buy"
    x = trades.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "mint")
    out = x.agg(F.coalesce(F.sum(F.when(buy, F.col("quote"))), F.lit(0.0)).alias("buy_volume"), F.sum(F.when(buy, F.col("quote")).otherwise(-F.col("quote"))).alias("net_flow"))
    return out.select("mint", F.col("window.end").alias("end"), "buy_volume", "net_flow")


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Activity sessions whose gap is a SQL expression of the row, such as CASE state WHEN 'hot' THEN '1 hour' ELSE '10 minutes' END."""
    x = events.withWatermark("ts", late).groupBy(F.session_window("ts", F.expr(gap)), key).count()
    return x.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("n"))


def reconciled(tentative: DataFrame, canonical: DataFrame, ttl: str, late: str) -> DataFrame:
    """Tentative rows (key, ts) with the canonical row of their key within ttl; without one they come out unmatched once the watermark has passed."""
    a = tentative.select("key", F.col("ts").alias("t_ts")).withWatermark("t_ts", late)
    b = canonical.select(F.col("key").alias("c_key"), F.col("ts").alias("c_ts")).withWatermark("c_ts", late)
    on = F.expr(f"key = c_key and c_ts >= t_ts and c_ts <= t_ts + interval {ttl}")
    x = a.join(b, on, "leftOuter")
    return x.select("key", "t_ts", "c_ts", F.when(F.col("c_ts").isNull(), "unmatched").otherwise("matched").alias("outcome"))


LEDGER = T.StructType([T.StructField("mint", T.LongType()), T.StructField("wallet", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("held", T.DoubleType()), T.StructField("cost", T.DoubleType()), T.StructField("realised", T.DoubleType())])


def step(held: float, cost: float, realised: float, side: str, tokens: float, quote: float) -> tuple[float, float, float]:
    """A position at average cost after one more trade; what is sold beyond what is held brings nothing."""
    if side == "buy":
        return held + tokens, cost + quote, realised
    gone = min(tokens, held)
    basis = cost / held * gone if held > 0 else 0.0
    return held - gone, cost - basis, realised + (quote * gone / tokens if tokens > 0 else 0.0) - basis


class Ledger(StatefulProcessor):
    """The average-cost position of a (mint, wallet) after each of its trades; trades of one batch are taken in order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", "held double, cost double, realised double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, cost, realised = self.state.get() if self.state.exists() else (0.0, 0.0, 0.0)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            held, cost, realised = step(held, cost, realised, r.side, r.tokens, r.quote)
            out.append((key[0], key[1], r.seq, held, cost, realised))
        self.state.update((held, cost, realised))
        yield pd.DataFrame(out, columns=[f.name for f in LEDGER.fields])

    def close(self) -> None:
        pass


def ledger(trades: DataFrame) -> DataFrame:
    return trades.groupBy("mint", "wallet").transformWithStateInPandas(Ledger(), LEDGER, "append", "none")


#: Groups that a stream's positions are dealt over; a group's state holds its share of them.
BUCKETS = 1024
#: Stands for a missing id in state.
_NONE = -(2**63)


def positions(trades: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """T1, Z5 as `ledger`, with the state in grouped pandas: it needs no particular state store. Trades of one batch are taken in order of (us, seq).

    A group of pandas costs milliseconds, whatever it holds, and most positions have few trades: so positions share a
    group by the hash of their key, and its state is a list of them.
    """

    def fold(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = {(m, w): (h, c, r) for m, w, h, c, r in zip(*state.get, strict=True)} if state.exists else {}
        pdf = pd.concat(list(parts)).sort_values(["us", "seq"])
        out = []
        for mint, wallet, seq, side, tokens, quote in zip(*[pdf[c].tolist() for c in ("mint", "wallet", "seq", "side", "tokens", "quote")], strict=True):
            at = known[mint, wallet] = step(*known.get((mint, wallet), (0.0, 0.0, 0.0)), side, tokens, quote)
            out.append((mint, wallet, seq, *at))
        state.update(tuple(map(list, zip(*[(*k, *v) for k, v in known.items()], strict=True))))
        yield pd.DataFrame(out, columns=LEDGER.names)

    ids = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_NONE)).alias(c)
    x = trades.select(F.pmod(F.xxhash64("mint", "wallet"), F.lit(buckets)).alias("bucket"), ids("mint"), ids("wallet"), "us", "seq", "side", "tokens", "quote")
    rows = x.groupBy("bucket").applyInPandasWithState(fold, LEDGER, "mint array<long>, wallet array<long>, held array<double>, cost array<double>, realised array<double>", "append", "NoTimeout")
    return rows.select(*[F.nullif(F.col(c), F.lit(_NONE)).alias(c) for c in ("mint", "wallet")], *LEDGER.names[2:])


LIFECYCLE = T.StructType([T.StructField(n, T.StringType() if n in ("kind", "was", "state") else T.LongType()) for n in ("mint", "us", "seq", "kind", "was", "state", "n", "holders", "buyers", "expires_us")])
_NEW = (0, 0, 0, "Discovered", None, 0, 0, 0, True)
_LAST = ["n", "holders", "buyers", "state", "held", "us", "seq", "expires_us", "done"]


class Lifecycle(StatefulProcessor):
    """The state machines of the mints of a bucket. Transitions come out as events come in; a timer at the earliest time to live says that none came.

    State: the counts, state and last event of each mint, and the balances of its wallets, as lists that a batch reads and
    writes once: a call of the state store costs as much as hundreds of events, so there is none for an event or a wallet.
    Events of one batch are taken in order of (us, seq). What an event finds expired is given before it; what nothing
    follows is given when the watermark has passed its time to live.
    """

    def __init__(self, target, ttl: dict[str, int]) -> None:
        self.target, self.ttl = target, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = {"state": "string", "held": "string", "done": "boolean"}
        lists = {"mint": "long", **{c: kinds.get(c, "long") for c in _LAST}, "w_mint": "long", "wallet": "long", "balance": "double", "bought": "boolean"}
        self.all = handle.getValueState("mints", ", ".join(f"{c} array<{t}>" for c, t in lists.items()) + ", timer long")

    def _read(self) -> tuple[dict, dict, int]:
        if not self.all.exists():
            return {}, {}, 0
        *lists, timer = self.all.get()
        last, wallets = lists[: len(_LAST) + 1], lists[len(_LAST) + 1 :]
        return {m: v for m, *v in zip(*last, strict=True)}, {(m, w): v for m, w, *v in zip(*wallets, strict=True)}, timer

    def _write(self, mints: dict, wallets: dict, timer: int) -> None:
        nxt = min((-(-v[7] // 1000) for v in mints.values() if not v[8]), default=0)
        turned = lambda rows, n: [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(n)]
        self.all.update((*turned([(m, *v) for m, v in mints.items()], len(_LAST) + 1), *turned([(*k, *v) for k, v in wallets.items()], 4), nxt))
        if nxt != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if nxt:
                self.handle.registerTimer(nxt)

    def _rows(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=LIFECYCLE.names).astype({c: "Int64" for c in ("n", "holders", "buyers")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mints, wallets, timer = self._read()
        out = []
        pdf = pd.concat(list(rows)).sort_values(["us", "seq"])
        for mint, us, seq, w, side, tokens, mark in zip(*[pdf[c].tolist() for c in ("mint", "us", "seq", "wallet", "side", "tokens", "mark")], strict=True):
            n, holders, buyers, state, held, last_us, last_seq, expires, done = mints.get(mint, _NEW)
            if not done and us > expires:
                out.append((mint, last_us, last_seq, "expiry", None, state, None, None, None, expires))
            if isinstance(mark, str):
                held = held or mark
            else:
                balance, bought = wallets.get((mint, w), (0.0, False))
                signed = tokens if side == "buy" else -tokens
                after = balance + signed
                holders += int(after > 0) - int(after - signed > 0)
                buyers += int(side == "buy" and not bought)
                wallets[mint, w] = (after, bought or side == "buy")
                n += 1
            was, state = state, held or self.target(n, holders, buyers)
            expires = us + self.ttl[state] * 1_000_000
            mints[mint] = (n, holders, buyers, state, held, us, seq, expires, False)
            if was != state:
                out.append((mint, us, seq, "transition", was, state, n, holders, buyers, expires))
        self._write(mints, wallets, timer)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mints, wallets, timer = self._read()
        at = expiredTimerInfo.getExpiryTimeInMs()
        passed = max(at, timerValues.getCurrentWatermarkInMs() - 1)
        out = []
        for mint, (n, holders, buyers, state, held, us, seq, expires, done) in mints.items():
            if not done and -(-expires // 1000) <= passed:
                out.append((mint, us, seq, "expiry", None, state, None, None, None, expires))
                mints[mint] = (n, holders, buyers, state, held, us, seq, expires, True)
        if out:
            self._write(mints, wallets, 0 if at == timer else timer)
        yield self._rows(out)

    def close(self) -> None:
        pass


def active_state(n: int, holders: int, buyers: int) -> str:
    """The state that activity asks for, as `windows.target_state` has it."""
    return "ActiveDeep" if n >= 4 or holders >= 4 or buyers >= 3 else "ActiveLight" if n >= 2 or holders >= 2 else "FirstPass" if n >= 1 else "Discovered"


def lifecycle(events: DataFrame, ttl: dict[str, int], late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Transitions and expiries of events (mint, us, seq, ts, wallet, side, tokens, mark): trades, and marks that hold a state. Mints share buckets by their hash. Needs the RocksDB state store."""
    ids = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_NONE)).alias(c)
    x = events.withWatermark("ts", late).select(F.pmod(F.xxhash64("mint"), F.lit(buckets)).alias("bucket"), ids("mint"), "us", "seq", "ts", ids("wallet"), "side", "tokens", "mark")
    rows = x.groupBy("bucket").transformWithStateInPandas(Lifecycle(active_state, ttl), LIFECYCLE, "append", "eventtime")
    return rows.select(F.nullif(F.col("mint"), F.lit(_NONE)).alias("mint"), *LIFECYCLE.names[1:])


def newest_versions(updates: DataFrame, key: str, version: str) -> DataFrame:
    """B2: updates whose version is above all that came before for their key; versions of one batch are taken in order of arrival."""

    def keep(k, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        high = state.get[0] if state.exists else None
        for pdf in parts:
            best = pdf[version].cummax().shift()
            ok = (best.isna() | (pdf[version] > best)) & ((high is None) | (pdf[version] > (high or 0)))
            top = int(pdf[version].max())
            high = top if high is None else max(high, top)
            yield pdf[ok]
        state.update((high,))

    return updates.groupBy(key).applyInPandasWithState(keep, updates.schema, "high long", "append", "NoTimeout")


@contextmanager
def rocksdb(spark):
    """The state store that state with timers and maps needs, for the streams that are started inside."""
    name, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_once(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Takes all that is there, writes it as Parquet, and stops; a later call goes on from there."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
