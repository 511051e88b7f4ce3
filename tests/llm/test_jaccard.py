import random

import corpus_pipeline
import pytest

from mintscope.llm import jaccard

SF = "/root/testdata/sf0.01"


def parts(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs):
    """node -> smallest node reachable, by comparing all with all."""
    sets = {d: parts(t) for d, t in docs.items()}
    top = {d: d for d in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    nodes = sorted(docs)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: find(d) for d in docs}


def test_stage_against_brute_force_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    group = brute(texts)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    # 56 differs from 2 in its words and stayed before
    assert group[56] == 2 and {r.doc_id for r in kept.collect()} == {d for d in texts if group[d] == d}


@pytest.mark.parametrize("edits", [2, 6, 12])
def test_crowds_of_near_copies(spark, edits):
    rng = random.Random(edits)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(3)]
    texts = {}
    for d in range(150):
        copy = list(rng.choice(base))
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts[d] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.groups(df).collect()} == brute(texts)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t", "z"), (4, "one two", "x"), (5, "ONE  two", "x"), (None, "one two", "x"), (6, "a " * 50000, "x"), (6, "a " * 50000, "x"), (7, "one three", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = jaccard.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 6, 7]
    assert jaccard.drop_near_duplicates(df.where("false")).count() == 0


def test_fingerprints_alone_link_near_copies(spark, monkeypatch):
    """Without any MinHash band in common, what SimHash finds is linked, and verified: pairs that are not similar stay apart."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    texts = {0: " ".join(base), 1: " ".join([*base[:-1], "other"]), 2: " ".join(rng.sample(base, len(base))), 3: " ".join(base[:2000])}
    prints = {d: jaccard.signature(t)[2].item() % 2**64 for d, t in texts.items()}
    assert (prints[0] ^ prints[1]).bit_count() <= 2
    own = jaccard.signature
    monkeypatch.setattr(jaccard, "signature", lambda text, width=5: own(text, width)[:3])
    got = {r.doc_id: r.component_id for r in jaccard.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute(texts) == {0: 0, 1: 0, 2: 2, 3: 3}


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Failed before: the planner sized 40 bands a text, and a set's shingles one by one, like the texts, and sent them through the driver."""
    plans, own = {}, jaccard.cut
    kept = lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(jaccard, "cut", lambda df, name: (kept(df, name), own(df, name))[1])
    jaccard.groups(spark.createDataFrame([(i, f"a b c d e f g h {i // 3}") for i in range(30)], "doc_id long, text string")).count()
    assert "Join" in plans["bands"] and "BroadcastHashJoin" not in plans["bands"]
    sets = spark.range(30).selectExpr("id as node", "sequence(id, id + 20) as s")
    x = jaccard._apart(spark.range(30).selectExpr("id as node", "id as c"), sets, 0.8)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [t#" in plan and "BroadcastHashJoin [t#" not in plan and x.count() > 0
