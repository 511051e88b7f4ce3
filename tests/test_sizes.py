"""What a step writes, holds or starts must not grow faster than its input."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mintscope import queries as Q
from mintscope.operators import cohorts as C
from mintscope.operators import joins as J
from mintscope.operators import ledger as L
from mintscope.operators import windows as W
from mintscope.operators.windows import TTL
from mintscope.plans import families as P
from mintscope.queries import defence
from mintscope.sources import shared
from mintscope.streaming import operators as S

Q.load()
SF = "/root/testdata/sf0.001"


def _tokens(spark):
    """300 launches 3 s apart, 60 more within one second, some observed early, one never launched."""
    m = F.col("mint")
    t = spark.range(361).select(F.col("id").alias("mint")).select("mint", F.when(m < 300, m * 3_000_000).when(m < 360, 450_000_000 + m % 7).alias("launch_us"))
    return t.select("*", (F.coalesce("launch_us", F.lit(0)) + m % 40 * 1_000_000 - 2_000_000).alias("observed_us"), F.lit("ActiveDeep").alias("lifecycle"), (m % 8).alias("unique_buyers"), *[(m * k % 11 / 2).alias(n) for k, n in enumerate(("buy_volume", "net_flow", "growth", "price_return", "growth_1m", "return_1m", "buy_volume_5s", "buy_volume_15s"), 3)])


def test_small_cohorts_need_no_blocks(spark, monkeypatch):
    """Failed before: cohorts of a few launches were counted by blocks too."""
    t = _tokens(spark).where("mint < 300")
    monkeypatch.setattr(C, "blocks_of", lambda *_: pytest.fail("blocks"))
    assert P.cohort_columns(t).count() == 300


@pytest.mark.parametrize("near", [1, 16])
def test_cohorts_by_pairs_as_by_blocks(spark, monkeypatch, near):
    t = _tokens(spark)
    monkeypatch.setattr(C, "NEAR", 1000)
    want = sorted(map(str, P.cohort_columns(t).collect()))
    monkeypatch.setattr(C, "NEAR", near)
    assert sorted(map(str, P.cohort_columns(t).collect())) == want


def _joins(df):
    """Joins that the tasks of a query's last steps run one upon the other."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.mark.parametrize("name", ["f14_survival_columns", "f22_availability"])
def test_survival_is_written_between_steps(spark, name):
    """Failed before: fourteen joins by mint, and their sorts, in one task."""
    assert _joins(Q.QUERIES[name](spark, SF)) <= 2


class _Store:
    """A state store of one group that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_lifecycle_calls_the_store_once_a_batch():
    """Failed before: each wallet of an event was a call of the store, and each mint a group of its own."""
    store, machine = _Store(), S.Lifecycle(S.active_state, TTL)
    machine.init(store)
    batch = lambda lo: pd.DataFrame([(m, lo + m * 10 + w, lo + m * 100 + w, w, "buy", 1.0, None) for m in range(50) for w in range(10)], columns=["mint", "us", "seq", "wallet", "side", "tokens", "mark"])
    first = pd.concat(machine.handleInputRows((0,), iter([batch(0)]), None))
    assert len(first) == 150 and list(first.kind.unique()) == ["transition"] and store.calls == 2
    later = pd.concat(machine.handleInputRows((0,), iter([batch(10 * 7_200_000_000)]), None))
    assert list(later.kind) == ["expiry"] * 50 and store.calls <= 7 and len(store.timers) == 1
    ended = pd.concat(machine.handleExpiredTimer((0,), type("T", (), {"getCurrentWatermarkInMs": lambda _: 10**12})(), type("E", (), {"getExpiryTimeInMs": lambda _: max(store.timers)})()))
    assert sorted(ended.mint) == list(range(50)) and set(ended.kind) == {"expiry"}


def test_fingerprints_are_one_count(spark):
    """Failed before: twelve joins by mint, and their sorts, in one task."""
    assert _joins(Q.QUERIES["f16_fingerprint_columns"](spark, SF)) <= 1


def test_asof_deals_more_rows_over_more_tasks(spark, monkeypatch):
    """Failed before: the number of tasks was the session's, however many rows there were."""
    monkeypatch.setattr(shared, "ROWS", 1000)
    x = Q.QUERIES["j_asof_last_order"](spark, SF)
    assert x.rdd.getNumPartitions() == 6 and x.count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate").distinct().count()


def _shuffles(df):
    """How often a query's rows are dealt out anew."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count(" Exchange ")


@pytest.mark.parametrize("name, most", [("rug_measures", 6), ("developer_measures", 3), ("holder_lifecycle_measures", 10)])
def test_line_trades_are_shuffled_once(spark, name, most):
    """Failed before: lines were dealt out whole, then by order, and once more for each use."""
    assert _shuffles(Q.QUERIES[name](spark, SF)) <= most


def test_first_buyers_are_found_once(spark, monkeypatch):
    """Failed before: the bundle looked for them once more for their funders."""
    calls, own = [], W.first_buyers
    found = lambda *a: calls.append(a) or own(*a)
    for module in (W, J):
        monkeypatch.setattr(module, "first_buyers", found)
    Q.QUERIES["f9_bundle"](spark, SF)
    assert len(calls) == 1


def _counted(monkeypatch, module, name):
    calls, own = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a: calls.append(a) or own(*a))
    return calls


@pytest.mark.parametrize("name, joins", [("t6_tentative_sells", 2), ("t7_sell_resolutions", 5)])
def test_sells_are_made_of_trades_written_once(spark, monkeypatch, name, joins):
    """Failed before: trades were read from events for each use, and the sells made anew for each look at them."""
    calls = _counted(monkeypatch, defence, "launch_trades")
    x = Q.QUERIES[name](spark, SF)
    assert len(calls) == 1 and _joins(x) <= joins


def test_defence_makes_its_index_once(spark, monkeypatch):
    """Failed before: ledger and index were folded once for the sells and once more for the columns."""
    calls = _counted(monkeypatch, L, "positions")
    Q.QUERIES["f21_defence_columns"](spark, SF)
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["r7_assessment", "r14_entry_decisions"])
def test_score_rows_run_compiled(spark, name):
    """Failed before: the rows' expressions made methods that the JVM only interprets."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    Q.QUERIES[name](spark, SF)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_launches_are_dealt_out_by_their_number(spark, monkeypatch):
    """Failed before: launches were made of events anew for each use, by the session's number of tasks however many there were."""
    monkeypatch.setattr(shared, "ROWS", 20)
    t = defence.launch_context(spark, SF)[0]
    assert t.rdd.getNumPartitions() == -(-t.count() // 20) and "get_json_object" not in t._jdf.queryExecution().optimizedPlan().toString()


def test_bundle_reads_lines_once(spark):
    """Failed before: the largest holders came of lines that were read, made distinct and dealt out once more."""
    x = Q.QUERIES["f9_bundle"](spark, SF)
    assert "l_orderkey" not in x._jdf.queryExecution().optimizedPlan().toString() and _shuffles(x) <= 6


def test_first_buyers_know_who_is_on_top(spark):
    """Failed before: what they hold took a second look at all trades. A wallet unknown takes a place, but is no one's."""
    rows = [(1, 7, "buy", 5.0, 10), (1, 8, "buy", 9.0, 20), (1, 7, "sell", 5.0, 30), (1, 9, "sell", 1.0, 5), (1, None, "buy", 20.0, 40), (2, 7, "buy", 1.0, 1), (2, 7, "buy", 1.0, 2)]
    t = spark.createDataFrame([(*r, r[-1], 1.0) for r in rows], "mint long, wallet long, side string, tokens double, us long, seq long, quote double")
    got = lambda top: [tuple(r) for r in W.first_buyers(t, 8, top).select("mint", "wallet", "place", "us", "on_top").orderBy("mint", "place").collect()]
    assert got(1) == [(1, 7, 1, 10, False), (1, 8, 2, 20, False), (1, None, 3, 40, False), (2, 7, 1, 1, True)]
    assert got(2) == [(1, 7, 1, 10, False), (1, 8, 2, 20, True), (1, None, 3, 40, False), (2, 7, 1, 1, True)]
    assert [tuple(r) for r in W.first_buyers(t, 8).orderBy("mint", "place").collect()] == [(1, 7, 1, 10, 1.0), (1, 8, 2, 20, 1.0), (1, None, 3, 40, 1.0), (2, 7, 1, 1, 1.0)]
