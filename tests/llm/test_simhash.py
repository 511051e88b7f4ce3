import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mintscope.llm import simhash

DOCS = "/root/testdata/sf0.01/documents.parquet"


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(prints):
    """node -> smallest node reachable, by comparing all with all."""
    nodes = list(prints)
    values = np.array([prints[n] for n in nodes], dtype=np.uint64)
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, n in enumerate(nodes):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2):
            a, b = sorted((find(n), find(nodes[i + 1 + j])))
            top[b] = a
    return {n: find(n) for n in nodes}


def test_all_documents_against_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: plain(r.text) for r in docs.collect()}
    group = brute(prints)
    assert got == {d: (f"{p:016x}", group[d]) for d, p in prints.items()}
    assert len(set(group.values())) < len(group)


@pytest.mark.parametrize("crowd", [1, 4, 48])
def test_crowded_variants_lose_no_link(spark, crowd):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(60)}
    prints = dict(enumerate(sorted(values)))
    df = spark.createDataFrame([(n, v - (1 << 64) if v >> 63 else v) for n, v in prints.items()], "node long, simhash long")
    from mintscope.llm.components import components

    got = {r.node: r.component for r in components(simhash.links(df, crowd)).collect()}
    want = brute(prints)
    assert {n: got.get(n, n) for n in prints} == want


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t", "z"), (4, "one two", "x"), (5, "ONE  two", "x"), (None, "one two", "x"), (6, "a " * 50000, "x"), (6, "a " * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("simhash", F.lit(1))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()]
    by = {d: (f, c) for d, f, c in got if d}
    assert by[1] == by[2] == by[3] == ("0" * 16, 1)
    assert by[4] == by[5] and by[4][1] == 4
    assert len([g for g in got if g[0] == 6]) == 2
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 6]
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_variants_are_not_broadcast(spark, monkeypatch):
    """Failed before: the planner sized 64 variants a fingerprint like the fingerprints, and sent them through the driver."""
    plans, own = {}, simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, name: (plans.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()), own(df, name))[1])
    simhash.near_duplicates(spark.read.parquet(DOCS)).count()
    assert "Join" in plans["variants"] and "BroadcastHashJoin" not in plans["variants"]
