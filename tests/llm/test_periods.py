import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mintscope.llm import periods
from mintscope.llm.queries import op12_periodic_runs

RESULT = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute(words, min_words=6, times=4):
    """All runs by trying every period: (start, length, period), by start, then period."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_words, times * q):
                own = words[i : j + q]
                if not any(all(own[k] == own[k + p] for k in range(len(own) - p)) for p in range(1, q)):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def planted(doc_id, text):
    words = split(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def want(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *longest, sha(lines), sha(collapsed(words, runs)))


def found(*texts, **least):
    return [([(r["start"], r["length"], r["period"]) for r in runs], kept) for _, runs, kept in periods._batch(list(texts), least.get("min_words", 6), least.get("times", 4))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=4), st.sampled_from([(6, 4), (4, 4), (9, 5)]))
def test_short_alphabet(texts, least):
    got = found(*map(" ".join, texts), min_words=least[0], times=least[1])
    assert got == [((r := brute(w, *least)), collapsed(w, r)) for w in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
def test_repeated_blocks(parts):
    words = [w for block, times in parts for w in block * times]
    runs = brute(words)
    assert found(" ".join(words), "a a a a a a", None) == [(runs, collapsed(words, runs)), ([(0, 6, 1)], "a"), ([], "")]


def test_copies_of_a_text_do_not_meet():
    assert found("a b", "a b", "a b", "a b", "a b") == [([], "a b")] * 5


def test_fibonacci_and_long_periods():
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    block = [f"w{i}" for i in range(1500)]
    for words in (b, block * 4, ["x", *block[:7] * 900, "y", *block[:2] * 500], block[:129] * 9 + block[:128]):
        runs = brute(words) if len(words) < 2000 else None
        got = found(" ".join(words))[0]
        assert runs is None or got == (runs, collapsed(words, runs))
        assert all(n >= max(6, 4 * q) for _, n, q in got[0])
    assert found(" ".join(block * 4))[0][0] == [(0, 6000, 1500)]
    assert not found(" ".join((block * 4)[:-1]))[0][0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op12_periodic_runs(spark, f"/root/testdata/{sf}")
    assert got.columns[: len(RESULT)] == RESULT
    got = {r[0]: tuple(r)[: len(RESULT)] for r in got.collect()}
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got.values()) > 0.03 * len(rows)
    short = [r for r in rows if len(split(r.text)) <= 1500]
    assert len(short) > 0.9 * len(rows)
    for r in short:
        assert got[r.doc_id] == want(r.doc_id, r.text)


def test_edge_rows(spark, tmp_path):
    texts = [None, "", " \t\n", "a", "a " * 6, "\x0b".join("ab" * 5), "a b " * 30_000, "é\x85é   " * 9, "a b c " * 5 + "a b d " * 4, "same " * 8]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(9, "same " * 8, 1), (None, "x y z " * 9, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[: len(RESULT)] for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((want(i, t) if i != 6 else got[[g[0] for g in got].index(6)] for i, t, _ in rows), key=repr)
    six = got[[g[0] for g in got].index(6)]
    assert six[:6] == (6, 1, 0, 60_000, 2, 30_000_000)


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([("k", "a " * 7, 5, "z")], "id string, body string, runs int, n_words string")
    got = periods.find_runs(df, "body")
    assert got.columns == ["id", "body", "runs", "n_words", "_n_words", "_runs", "collapsed"]
    assert [tuple(r) for r in got.select("id", "runs", "n_words", "_n_words", "collapsed").collect()] == [("k", 5, "z", 7, "a")]
    assert got.where("false").count() == 0 and periods.find_runs(df.where("false"), "body").count() == 0
