import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mintscope.llm import packing
from mintscope.llm.queries import op5_best_fit_packing, vocabulary


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_the_tokenizers(text):
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert list(packing._tokenizer(vocabulary())(text)) == full.encode(text, add_special_tokens=False).ids


def test_special_string():
    full = Tokenizer.from_file(vocabulary())
    assert list(packing._tokenizer(vocabulary())("a <|endoftext|> b")) == full.encode("a <|endoftext|> b", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=40))
def test_plan_uses_up_the_histogram(histogram):
    made = packing.plan(histogram, 64)
    got = {}
    for lengths, n in made:
        assert n > 0 and sum(lengths) <= 64
        for a in lengths:
            got[a] = got.get(a, 0) + n
    assert got == histogram
    # no packing has fewer windows than there are pieces over half a window, or than the tokens fill
    least = max(sum(n for a, n in histogram.items() if 2 * a > 64), -(-sum(a * n for a, n in histogram.items()) // 64))
    assert sum(n for _, n in made) <= 1.5 * least + 2


def test_few_windows():
    rng = np.random.default_rng(1)
    lengths = np.minimum(1024, np.maximum(2, rng.lognormal(5.5, 1, 50_000).astype(int)))
    histogram = {int(a): int(n) for a, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    assert sum(n for _, n in packing.plan(histogram)) <= 1.002 * lengths.sum() / 1024 + 1


def check(docs, rows):
    full = Tokenizer.from_file(vocabulary())
    ids = {d: np.array([*full.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for d, t in docs}
    windows = {}
    pieces = {}
    for r in rows:
        if r.doc_id not in ids:
            windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
            continue
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(own.tobytes()) == r.ids_crc32 and len(own) == r.length <= 1024
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for d, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert [s for _, s, _ in own] == [0, *np.cumsum([n for _, _, n in own])[:-1]] and sum(n for *_, n in own) == len(ids[d])
        assert all(n == 1024 for *_, n in own[1:])
    assert pieces.keys() == ids.keys()
    for own in windows.values():
        own.sort()
        at = 0
        for offset, n in own:
            assert offset == at
            at += n
        assert at <= 1024
    return len(windows), sum(map(len, ids.values()))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n, tokens = check([(r.doc_id, r.text) for r in docs.collect()], op5_best_fit_packing(spark, "/root/testdata/sf0.01").collect())
    assert n <= 1.005 * tokens / 1024 + 1


def test_edge_rows(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "word " * 30000, 4), (4, "a", 5), (4, "a", 5), (None, "b", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long")
    got = packing.pack(df, vocabulary()).collect()
    check([(1, None), (2, ""), (3, "word " * 30000)], got)
    assert len([r for r in got if r.doc_id == 4]) == 2 and len([r for r in got if r.doc_id is None]) == 1
    assert packing.pack(df.where("false"), vocabulary()).count() == 0
