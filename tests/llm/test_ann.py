import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mintscope.llm import ann
from mintscope.llm.queries import op9_nearest_neighbours


def brute(rows, ask, k=10):
    rows = sorted(rows)
    x = np.array([v for _, v in rows], dtype=np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for n, (i, v) in enumerate(rows):
        if ask(i):
            d = np.sqrt(np.square(x - x[n]).sum(axis=1))
            out[i] = [(int(ids[j]), d[j]) for j in sorted(range(len(ids)), key=lambda j: (d[j], ids[j])) if ids[j] != i][:k]
    return out


def test_curve_is_a_walk():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    key = ann.hilbert(cells, 3)
    assert sorted(key) == list(range(side**3))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    got = {}
    for r in sorted(op9_nearest_neighbours(spark, d).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = dict(rows)
    for q, own in got.items():
        assert all(math.isclose(s, np.linalg.norm(np.array(exact[q], float) - np.array(exact[i], float)), abs_tol=1e-12) for i, s in own)


def test_recall_where_windows_are_small_parts_of_the_table(spark):
    """60,000 clustered vectors of 24 dimensions: what a query sees is far from all of them on any curve."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 24))[rng.integers(0, 300, 60_000)] * 2 + rng.normal(size=(60_000, 24)) * rng.uniform(0.1, 1, 24)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(60_000), "embedding": x.tolist()}))
    got = {}
    for r in ann.search(df, lambda i: i % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 600
    hits = 0
    for q in got:
        d = np.square(x - x[q]).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert hits >= 0.9 * 6000


def test_recall_without_structure(spark):
    """200,000 vectors of 64 dimensions drawn like the provided ones: a mean and spread for each label, all axes alike."""
    rng = np.random.default_rng(9)
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    v = np.array([r.embedding for r in given], dtype=np.float64)
    label = np.array([r.label for r in given])
    x = np.concatenate([v[label == a].mean(axis=0) + rng.normal(size=(-(-200_000 // len(set(label))), v.shape[1])) * v[label == a].std(axis=0) for a in sorted(set(label))])[:200_000].astype(np.float32)
    rng.shuffle(x)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))}))
    got = {}
    for r in ann.search(df, lambda i: i % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.arange(0, len(x), 100)
    norms = np.square(x).sum(axis=1)
    hits = 0
    for q in np.array_split(asked, 20):
        d = norms[None, :] - 2 * x[q] @ x.T
        d[np.arange(len(q)), q] = np.inf
        hits += sum(len(got[int(i)] & set(best.tolist())) for i, best in zip(q, np.argpartition(d, 10, axis=1)[:, :10], strict=True))
    assert len(got) == len(asked) and hits >= 0.9 * 10 * len(asked)


@pytest.mark.parametrize("size", [2_000, 8_000])
def test_a_query_sees_a_fixed_number_of_rows(spark, size):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pa.table({"node": np.arange(size), "vec": rng.normal(size=(size, 4)).tolist()}))
    turns = ann.axes(df, size, 500, 3, 4, 1)
    places = ann.ordered(df, turns, size, 5).collect()
    for c in range(3):
        assert sorted(r.place for r in places if r.curve == c) == list(range(size))


def test_a_key_with_several_vectors_counts_with_the_smallest(spark):
    rows = [(100, [1.0, 1.0]), (100, [5.0, 5.0]), (1, [1.0, 2.0]), (2, [5.0, 6.0]), (2, [4.0, 6.0]), (100, [1.0, 1.0])]
    got = sorted(tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0).collect())
    assert [(q, n, v) for q, n, v, _ in got] == [(100, 1, 1), (100, 2, 2)] and got[1][3] == math.sqrt(34)


def test_edge_rows(spark):
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(0, 400, 2)] + [(i, [float(i), 1.0, 0.0]) for i in range(1, 60, 2)]
    odd = [(500, None), (600, []), (700, [0.0, 0.0, 0.0]), (800, [1.0, None, 2.0]), (900, [1.0, float("nan"), 2.0]), (1000, [float("inf"), 0.0, 1.0]), (1100, [1.0, 2.0]), (None, same), (100, same)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = {}
    for r in sorted(ann.search(df, lambda i: i % 100 == 0).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    short = [(1100, [1.0, 2.0, 0.0])]  # [1.0, 2.0], as if a zero followed
    assert got == brute(rows + short, lambda i: i % 100 == 0)
    assert ann.search(df.where("vec_id = 100"), lambda i: i % 100 == 0).count() == 0
    assert ann.search(df.where("false"), lambda i: i % 100 == 0).count() == 0
    few = ann.search(df.where("vec_id in (100, 3, 5)"), lambda i: i % 100 == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == [(1, 3), (2, 5)]
