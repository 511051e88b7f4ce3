"""Small frames with results worked out by hand."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from mintscope.functions import math as M
from mintscope.functions import text as T
from mintscope.operators import aggregates as A
from mintscope.operators import cohorts as CO
from mintscope.operators import defence as D
from mintscope.operators import graph as G
from mintscope.operators import joins as J
from mintscope.operators import ledger as L
from mintscope.operators import quality as Q
from mintscope.operators import updates as U
from mintscope.operators import windows as W
from mintscope.plans import labels as P
from mintscope.sources import files
from mintscope.streaming import operators as S

TRADE = "mint long, wallet long, side string, quote double, tokens double, price double, us long, seq long"


def trades(spark, *rows):
    return spark.createDataFrame([(1, w, s, float(q), float(t), q / t, u, i) for i, (w, s, q, t, u) in enumerate(rows)], TRADE)


def test_ledger_by_hand(spark):
    t = trades(spark, (7, "buy", 10, 10, 1), (7, "buy", 30, 10, 2), (7, "sell", 30, 10, 3), (7, "sell", 60, 20, 4))
    r = L.positions(t).first()
    # average 2; ten sold at 3 gain 10; of the last twenty at 3 only ten were held and gain 10
    assert (r.held, r.cost, r.realised, r.bought, r.sold, r.round_trip) == (0, 0, 20, 20, 30, True)
    one = L.positions(trades(spark, (7, "buy", 10, 10, 1), (7, "sell", 5, 2, 2))).first()
    assert (one.held, one.cost, one.average_entry, one.realised) == (8, 8, 1, 3)


def test_order_of_rows_does_not_matter(spark):
    rng = random.Random(0)
    rows = [(1, rng.randint(1, 5), rng.choice(["buy", "sell"]), float(rng.randint(1, 9)), float(rng.randint(1, 9)), 1.0 * rng.randint(1, 9), rng.randint(1, 20), i) for i in range(60)]
    shuffled = rng.sample(rows, len(rows))
    for op in (L.positions, A.trade_stats, W.price_path, W.lifecycle, W.holding_times, L.balance_history, lambda t: W.first_buyers(t, 3), lambda t: W.window_returns(t, [1])):
        a, b = (sorted(map(repr, op(spark.createDataFrame(x, TRADE).repartition(3)).collect())) for x in (rows, shuffled))
        assert a == b


@pytest.mark.parametrize(("n", "p", "want"), [(12, 90, 10), (4, 50, 2), (1, 90, 1), (12, 50, 6)])
def test_percentile_is_the_lower_rank(spark, n, p, want):
    df = spark.range(1, n + 1).selectExpr("1 as g", "id")
    assert A.percentiles(df, ["g"], "id", [p]).first()[f"p{p}"] == want


def test_concentration(spark):
    held = spark.createDataFrame([(1, w, 5.0) for w in range(4)] + [(2, 1, 9.0), (3, 1, 0.0)], "mint long, wallet long, balance double")
    got = {r.mint: r for r in A.concentration(held).collect()}
    assert abs(got[1].gini) < 1e-12 and got[1].hhi == 0.25 and got[2].hhi == 1 and 3 not in got


def test_curve_progress(spark):
    df = spark.createDataFrame([(1_000_000_000.0,), (603_450_000.0,), (206_900_000.0,), (0.0,)], "b double")
    assert [r[0] for r in df.select(M.curve_progress(F.col("b"))).collect()] == [0, 50, 100, 100]


def test_slot_gaps(spark):
    df = spark.createDataFrame([("a", 100, 99), ("a", 104, 103), ("a", 105, 104), ("a", 106, 110)], "source string, slot long, parent long")
    got = [(r.start_slot, r.end_slot, r.severity) for r in Q.slot_gaps(df, "source", "slot", ["slot"], 0, "parent").collect()]
    assert got == [(101, 103, "high"), (106, 105, "medium")]


def test_sequence_verdict_sticks(spark):
    df = spark.createDataFrame([("s", i, n, True) for i, n in enumerate([1, 2, 4, 3, 4, 5])] + [("t", 0, 2, True), ("t", 1, 1, False), ("t", 2, 1, True)], "stream string, o long, n long, ok boolean")
    got = sorted((r.stream, r.o, r.passed) for r in Q.sequence_verdicts(df, "stream", "n", "o", "ok").collect())
    assert [p for s, _, p in got if s == "s"] == [True, True, False, True, True, True] and [p for s, _, p in got if s == "t"] == [False, False, True]


def test_accounts_change_hands(spark):
    df = spark.createDataFrame([(1, "x", 10, 5.0, 1, 1), (1, "x", 11, 5.0, 2, 2), (1, "y", 11, 2.0, 1, 3)], "mint long, account string, owner long, balance double, us long, seq long")
    assert [(r.owner, r.balance, r.accounts) for r in L.owner_balances(df).collect()] == [(11, 7.0, 2)]


def test_closed_accounts_go_to_zero(spark):
    pre = spark.createDataFrame([(1, "a", 5)], "mint long, account string, amount long")
    post = spark.createDataFrame([(1, "b", 3)], "mint long, account string, amount long")
    got = sorted((r.account, r.old, r.new, r.delta) for r in Q.balance_changes(pre, post, ["mint", "account"]).collect())
    assert got == [("a", 5, 0, -5), ("b", 0, 3, 3)]


def test_cohorts_end_at_the_window(spark):
    df = spark.createDataFrame([(1, 0), (2, 30 * W.SECOND), (3, 61 * W.SECOND)], "mint long, launch_us long")
    assert sorted(map(tuple, CO.stretches(df, [30])[1].collect())) == [(1, 30, 0, 2), (2, 30, 0, 2), (3, 30, 2, 3)]


def test_cohort_counts(spark, monkeypatch):
    monkeypatch.setattr(CO, "CHUNK", 3)
    rng = random.Random(5)
    rows = [(i, rng.randrange(40) if i % 3 else 17, float(rng.randrange(6) if i % 4 else 2)) for i in range(300)]  # a crowded second, a common score
    df = spark.createDataFrame([(m, u * W.SECOND, s, (u + 2) * W.SECOND) for m, u, s in rows], "mint long, launch_us long, score double, until long")
    near = {m: [(n, t) for n, v, t in rows if abs(u - v) <= 4] for m, u, s in rows}
    want = {m: (len(near[m]), 1 + sum(t > s or t == s and n < m for n, t in near[m]), round(sum(t <= s for _, t in near[m]) / len(near[m]), 9)) for m, u, s in rows}
    assert {r[0]: (r[1], r[2], round(r[3], 9)) for r in CO.cohort_ranks(df, df, 4).collect()} == want
    places, found = CO.stretches(df, [4, 1], "until")
    got = CO.totals(df, places, found, {"n": (F.lit(1), "sum"), "s": (F.col("score"), "sum"), "top": (F.col("score"), "max")}).collect()
    have = {(m, b): [t for _, v, t in rows if abs(u - v) <= b and v <= u + 2] for m, u, s in rows for b in (4, 1)}
    assert {(r.mint, r.band): (r.n, r.s, r.top) for r in got} == {k: (len(v), sum(v), max(v)) for k, v in have.items()}
    blocks = CO.blocks_of(found).groupBy("mint", "band").count().agg(F.max("count")).first()[0]
    assert blocks <= 2 * len(rows).bit_length()


def test_cohorts_of_nothing(spark):
    df = spark.createDataFrame([], "mint long, launch_us long, score double")
    assert CO.cohort_ranks(df, df, 5).collect() == []


def test_reconciliation(spark):
    t = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "key string, us long")
    c = spark.createDataFrame([("a", 4_000_000), ("b", 6_000_000), ("d", 1)], "key string, us long")
    assert {r.key: r.outcome for r in J.reconcile(t, c, 5_000_000).collect()} == {"a": "matched", "b": "missing_later", "c": "false_positive", "d": "canonical_only"}


def test_cluster_is_a_neighbourhood(spark):
    g = spark.createDataFrame([(1, 2), (2, 3)], "funder long, wallet long").selectExpr("*", "1.0 as amount", "1L as last_us", "1L as transfers")
    got = {r.wallet: (r.cluster, r.members) for r in G.clusters(g).collect()}
    assert {w: m for w, (_, m) in got.items()} == {"1": 2, "2": 3, "3": 2} and all(len(c) == 20 and c.startswith("cluster-") for c, _ in got.values())


def test_split_has_an_embargo(spark):
    df = spark.createDataFrame([(i, i * 1000) for i in range(30)], "mint long, first_us long")
    got = [r.split for r in P.walk_forward(df).collect()]
    assert (got.count("train"), got.count("validation"), got.count("test")) == (18, 1, 1)


def test_texts(spark):
    df = spark.createDataFrame([("ipfs://Host.x/a b", " Yes ", "2024-01-02T03:04:05Z", "['x']", "a| b||a", "12.7")], "u string, b string, t string, l string, r string, n string")
    r = df.select(T.uri_scheme(F.col("u")), T.uri_host(F.col("u")), T.truthy(F.col("b")), T.timestamp_of(F.col("t")).cast("string"), T.timestamp_of(F.col("l")), T.reason_list(F.col("r")), T.int_or_zero(F.col("n")), T.first_gate(T.reason_list(F.col("r")), ["b", "a"])).first()
    assert tuple(r) == ("ipfs", "Host.x", True, "2024-01-02 03:04:05", None, ["a", "b"], 12, "b")


def test_event_log_round_trip(spark, tmp_path):
    log = tmp_path / "log" / "run_id=r1" / "scenario_id=s1"
    log.mkdir(parents=True)
    rows = [{"event_id": "e1", "kind": "buy", "slot": 5, "payload": json.dumps({"mint": "m", "quote": 1.5})}, {"event_id": "e2", "kind": "sell", "payload": "{}"}]
    (log / "a.json").write_text("\n".join([json.dumps(r) for r in rows] + ["{broken"]))
    good, bad = files.quarantine(files.read_events(spark, str(tmp_path / "log"), run="r1").cache())
    assert good.count() == 2 and bad.count() == 1
    assert [(r.mint, float(r.quote)) for r in files.typed(good, "buy").collect()] == [("m", 1.5)]
    files.write_chunks(spark.range(10).selectExpr("id", "'r1' as run_id"), str(tmp_path / "out"), 4, ["run_id"])
    assert sum(r.rows for r in files.manifest(spark, str(tmp_path / "out")).collect()) == 10
    (tmp_path / "t.csv").write_text("a,b\n1,\n,x\n")
    got = files.read_csv(spark, str(tmp_path / "t.csv"), "a long, b string").collect()
    assert [tuple(r) for r in got] == [(1, None), (None, "x")]


def test_streamed_ledger_is_the_batch_ledger(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1, rng.randint(1, 3), rng.choice(["buy", "sell"]), float(rng.randint(1, 9)), float(rng.randint(1, 9)), 1.0, i, i) for i in range(40)]
    df = spark.createDataFrame(rows, TRADE)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        S.run_once(S.ledger(stream), str(tmp_path / "cp"), str(tmp_path / "out"))
    except Exception as e:  # the state store's native library isn't in every image
        if "rocksdb" not in str(e).lower() and "protobuf" not in str(e).lower():
            raise
        pytest.skip(f"stateful processors can't run here: {str(e)[:80]}")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {r.wallet: r for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()}
    for r in L.positions(df).collect():
        assert (last[r.wallet].held, round(last[r.wallet].cost, 9), round(last[r.wallet].realised, 9)) == (r.held, round(r.cost, 9), round(r.realised, 9))


def test_streamed_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (1, 4), (1, 6), (2, 1)], "k long, v long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    S.run_once(S.newest_versions(stream, "k", "v"), str(tmp_path / "cp"), str(tmp_path / "out"))
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 5), (1, 6), (2, 1)]


def test_pending_sells_of_a_slot_add_up(spark):
    rows = [(1, 1, 3.0, None), (2, 1, 2.0, None), (3, 1, 5.0, 2), (4, 1, 1.0, None), (5, 1, 40.0, None), (6, 1, 0.0, None), (7, 2, 9.0, None)]
    df = spark.createDataFrame([(i, 1, s, i, v, o) for i, s, v, o in rows], "id long, mint long, slot long, us long, impact double, original long")
    got = {r.id: (r.impact_pct, r.slot_before) for r in D.slot_impacts(df).collect()}
    # a sell weighs with what was pending when it came: 3, 2 + 3, the copy 5 + 8, 1 + 8, 40 + 17, 0 + 74
    assert got == {1: (3.0, 0), 2: (5.0, 1), 3: (13.0, 2), 4: (9.0, 2), 5: (57.0, 3), 6: (74.0, 4), 7: (9.0, 0)}


def test_long_slots_end_at_a_hundred(spark):
    df = spark.range(2500).selectExpr("id", "1L as mint", "1L as slot", "id as us", "if(id = 1, 1e-3, 0.0) as impact", "cast(null as long) as original")
    got = {r.id: r.impact_pct for r in D.slot_impacts(df).where("id in (0, 1, 2, 12, 30, 950, 2000)").collect()}
    assert got[0] == 0 and got[1] == got[2] == 1e-3 and abs(got[12] - 1.024) < 1e-9 and got[30] == got[950] == got[2000] == 100


def test_resolutions(spark):
    found = spark.createDataFrame([(1, 1, 7, 0, 10.0, True, 2.0, None), (2, 1, 8, 0, 10.0, True, 2.0, None), (3, 1, 9, 0, 10.0, True, 2.0, 1)], "id long, mint long, seller long, us long, price_before double, triggered boolean, size_tokens double, original long")
    events = spark.createDataFrame([(1, 7, 4_000_000, "balance", 1.0), (1, 7, 4_000_000, "executed", 8.0), (1, 8, 5_000_001, "executed", 1.0)], "mint long, seller long, us long, kind string, price_after double")
    prices = spark.createDataFrame([(1, 0, 10.0), (1, 4_999_999, 13.0), (1, 5_000_001, 99.0)], "mint long, us long, price double")
    got = {r.id: (r.outcome, r.false_positive, r.saved, r.latency_ms) for r in D.resolve(found, events, prices).collect()}
    assert got == {1: ("confirmed_executed", False, 4.0, 4000), 2: ("not_seen_within_ttl", True, -6.0, 5000)}


def test_sketches_are_within_their_bounds(spark):
    """100,000 updates of two classes in 20 parts: a key with a third of the rows, values with a long tail."""
    df = spark.range(100_000).selectExpr("if(id % 3 = 0, 'a', 'b') as class", "id % 20 as part", "if(id % 9 < 3, 7L, xxhash64(id) % 5000) as key", "cast(pmod(xxhash64(id, 1), 1000) * pmod(xxhash64(id, 2), 1000) as double) as value").cache()
    parts = U.sketches(df, ["class", "part"], "key", "value")
    got = {r["class"]: r for r in U.from_sketches(parts, ["class"], top=3).collect()}
    exact = {r["class"]: r for r in U.volume(df, "key", "value", top=3).collect()}
    for c, r in got.items():
        n = exact[c].updates
        assert r.updates == n
        for p in U.PERCENTILES:
            below = df.where((F.col("class") == c) & (F.col("value") <= r[f"p{p}"])).count()
            assert abs(below / n - p / 100) <= 0.02
        # the one heavy key is first, its count off by less than 1 / (0.75 items) of the rows
        key, count = r.top_keys.split("|")[0].split(":")
        assert key == "7" == exact[c].top_keys.split(":")[0] and abs(int(count) - int(exact[c].top_keys.split("|")[0].split(":")[1])) <= n / 300
    df.unpersist()


def test_long_keys_are_streams(spark):
    """A wallet with 200,000 trades, a hub of 100,000 members and a stream of 100,000 frames, each a row or batch at a time."""
    t = spark.range(200_000).selectExpr("1L as mint", "7L as wallet", "if(id % 3 = 2, 'sell', 'buy') as side", "2.0 as quote", "if(id % 3 = 2, 2.0, 1.0) as tokens", "2.0 as price", "id as us", "id as seq").repartition(8)
    r = L.positions(t).first()
    assert (r.held, r.bought, r.sold) == (2.0, 133_334.0, 133_332.0) and abs(r.cost - 4.0) < 1e-6 and abs(r.realised + 133_332.0) < 1e-6
    g = spark.range(1, 100_000).selectExpr("0L as funder", "id as wallet", "1.0 as amount", "1L as last_us", "1L as transfers")
    hub = G.clusters(g).where("wallet = '0'").first()
    digest = hashlib.sha256("|".join(sorted(map(str, range(100_000)))).encode()).hexdigest()
    assert (hub.members, hub.cluster) == (100_000, f"cluster-{digest}"[:20])
    f = spark.range(1, 100_001).selectExpr("1L as s", "id as o", "id as seq", "id <> 60000 as ok")
    v = Q.sequence_verdicts(f, "s", "seq", "o", "ok")
    assert (v.where("passed").count(), v.where("not passed").agg(F.min("o")).first()[0]) == (59_999, 60_000)


def test_streamed_positions_share_groups(spark, tmp_path):
    """Many positions in one group, ids missing among them, carried on from batch to batch."""
    rows = [(m, w, "buy" if i < 2 else "sell", 6.0, 2.0, 3.0, i, i) for i in range(4) for m, w in ((1, 7), (1, 8), (None, 7), (2**60 + 1, None))]
    at = str(tmp_path / "in")
    for half in (rows[:8], rows[8:]):
        spark.createDataFrame(half, TRADE).write.mode("append").parquet(at)
        S.run_once(S.positions(spark.readStream.schema(TRADE).parquet(at), 1), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = {(r.mint, r.wallet, r.seq): (r.held, r.cost, r.realised) for r in spark.read.schema(S.LEDGER).parquet(str(tmp_path / "out")).collect()}
    by_hand = {0: (2, 6, 0), 1: (4, 12, 0), 2: (2, 6, 0), 3: (0, 0, 0)}
    assert got == {(m, w, i): by_hand[i] for m, w, _, _, _, _, _, i in rows}
