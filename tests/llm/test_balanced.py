import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mintscope.llm import balanced
from mintscope.llm.queries import op11_balanced_packing, vocabulary

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 12))
def test_every_number_is_in_one_set(sizes, k):
    sets = balanced.differencing(sizes, k)
    assert sorted(i for s in sets for i in s) == list(range(len(sizes))) and len(sets) <= k


def naive(sizes, k):
    """Sums by differencing as it is told, with tuples of k sums."""
    tuples = [(s, *[0] * (k - 1)) for s in sizes]
    while len(tuples) > 1:
        tuples.sort(key=lambda t: t[-1] - t[0])
        a, b = tuples.pop(0), tuples.pop(0)
        tuples.append(tuple(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)))
    return sorted(tuples[0])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=30, unique=True), st.integers(1, 6))
def test_sums_are_those_of_differencing(sizes, k):
    sums = sorted(sum(sizes[i] for i in s) for s in balanced.differencing(sizes, k))
    want = naive(sizes, k)
    # equal differences may be merged in another order
    assert sum(sums) == sum(want) and (len(sums) < k or sums[-1] - sums[0] <= max(sizes))


def test_known_example():
    # 8, 7, 6, 5, 4 in two sets: differencing ends with a difference of 2
    assert sorted(sum((8, 7, 6, 5, 4)[i] for i in s) for s in balanced.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=150), st.booleans())
def test_windows(sizes, last):
    sets, rest = balanced.windows([(i, 0, n) for i, n in enumerate(sizes)], 64, last)
    assert all(sum(n for *_, n in s) <= 64 for s in sets)
    seen = sorted([*[p for s in sets for p in s], *rest])
    ends = {}
    for i, a, n in seen:
        assert a == ends.get(i, 0) and n > 0
        ends[i] = a + n
    assert ends == dict(enumerate(sizes))
    assert not (last and rest)


def check(docs, rows, window=2048):
    """(windows, tokens, padding) of rows that keep the contract."""
    full = Tokenizer.from_file(vocabulary())
    ids = [np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for _, t in docs]
    of = {d: i for (d, _), i in zip(docs, ids, strict=True)}
    places, pieces = {}, {}
    for r in rows:
        own = of[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(own.tobytes()) == r.ids_crc32 and len(own) == r.length > 0 and r.doc_tokens == len(of[r.doc_id])
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    copies = {d: sum(1 for x, _ in docs if x == d) for d in of}
    for d, own in pieces.items():
        seen = np.zeros(len(of[d]), dtype=int)
        for start, n in own:
            seen[start : start + n] += 1
        assert (seen == copies[d]).all()
    assert pieces.keys() == of.keys()
    padding = 0
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return len(places), sum(map(len, ids)), padding


def test_whole_table(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        got = op11_balanced_packing(spark, f"/root/testdata/{sf}")
        assert got.columns == COLUMNS
        n, tokens, padding = check([(r.doc_id, r.text) for r in docs.collect()], got.collect())
        assert padding <= 0.006 * tokens
        lengths = [r[0] for r in got.groupBy("sequence_id").sum("length").select("sum(length)").collect()]
        assert np.mean([2048 - x <= 16 for x in lengths]) > 0.8  # near-equal


def test_hard_lengths():
    for sizes in ([1100 + i % 300 for i in range(2000)], [1025] * 2000, [2047] * 300, [1] * 5000, [700] * 1500, [1500, 600] * 600):
        sets, _ = balanced.windows([(i, 0, n) for i, n in enumerate(sizes)], 2048, True)
        sums = [sum(n for *_, n in s) for s in sets]
        assert max(sums) <= 2048 and sum(sums) == sum(sizes)
        assert sum(2048 - x for x in sums if x & (x - 1)) <= 0.01 * sum(sizes)


def test_edge_rows(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "word " * 30000, 4), (4, "a", 5), (4, "a", 5), (None, "b", 6), (2**60 + 1, "<|endoftext|> x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long")
    for parts in (1, 7):
        check([r[:2] for r in rows], balanced.pack(df.repartition(parts), vocabulary()).collect())
    assert balanced.pack(df.where("false"), vocabulary()).count() == 0
    named = balanced.pack(df.select("length", "text").withColumnRenamed("length", "k"), vocabulary(), key="k", window=64, end_id=0)
    assert named.columns[0] == "k" and named.where("length > 64").count() == 0
