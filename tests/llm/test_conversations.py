import hashlib
import heapq
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mintscope.llm import conversations as c
from mintscope.llm.queries import damaged, op13_conversation_repair

BLANKS = " \t\n\r\x0b\x0c"


def brute(turns):
    """Cheapest repair of [(role, text, fault)] by a shortest-path search over whole edit sequences: (cost, audit, repaired)."""
    n = len(turns)
    best = {}
    heap = [(0, "", 0, 0, ())]
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best[i, state] = (cost, audit)
        if i == n and state in (0, 3):
            return cost, audit, list(out)
        wanted = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
        after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        heapq.heappush(heap, (cost + 5, audit + "I", i, after, (*out, (wanted, ""))))
        if i < n:
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if fault != c.LOST:
                extra = 5 * (fault == c.CUT_OFF)
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, after, (*out, (wanted, text))))
                if role[:1] == "s" and state == 0:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, 1, (*out, (role, text))))
                elif role[:1] == wanted[0]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, after, (*out, (role, text))))


def every(turns):
    """(cost, audit) by trying every edit sequence with up to four insertions."""
    found = []

    def go(i, state, cost, audit, inserted):
        if i == len(turns) and state in (0, 3):
            found.append((cost, audit))
        if inserted < 4:
            go(i, {0: 2, 1: 2, 2: 3, 3: 2}[state], cost + 5, audit + "I", inserted + 1)
        if i < len(turns):
            role, _, fault = turns[i]
            go(i + 1, state, cost + 2, audit + "D", inserted)
            if fault != c.LOST:
                extra = 5 * (fault == c.CUT_OFF)
                go(i + 1, {0: 2, 1: 2, 2: 3, 3: 2}[state], cost + 1 + extra, audit + "R", inserted)
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
                if to is not None:
                    go(i + 1, to, cost + extra, audit + "K", inserted)

    go(0, 0, 0, "", 0)
    return min(found)


TURN = st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.just("x"), st.sampled_from([0, 0, 0, 1, 2]))


def code(turns):
    return "".join(c.symbol(r[0] if r[0] in "sua" else "o", f) for r, _, f in turns)


@settings(max_examples=150, deadline=None)
@given(st.lists(TURN, max_size=5))
def test_cost_and_audit_of_all_sequences(turns):
    assert c.repair(code(turns)) == every(turns)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TURN, st.integers(1, 9)), max_size=12))
def test_runs(runs):
    turns = [t for t, n in runs for _ in range(n)]
    assert c.repair(code(turns)) == brute(turns)[:2]


def test_long_runs():
    cost, audit = c.repair(c.symbol("u", c.SOUND) * 100_001)
    assert cost == 50_001 + 1 and len(audit) == 100_001


def reference(rows):
    """What the contract says of rows (conv_id, turn, role, text)."""
    s = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        h = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        if h == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        known, marked = [], []
        for _, role, text in own:
            bare = text.strip(BLANKS)
            fault = c.LOST if not bare or (role, text) in known else c.CUT_OFF if bare[-1] not in ".!?" else c.SOUND
            marked.append((role, text, fault, "b" if not bare else "d" if fault == c.LOST else ""))
            known.append((role, text))
        cost, audit, repaired = brute([m[:3] for m in marked])
        numbers = [t for t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = zip(own, own[1:], strict=False)
        wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        count = lambda x: sum(m[3] == x for m in marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, count("b"), count("d"), sum(m[2] == c.CUT_OFF for m in marked), wrong, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = op13_conversation_repair(spark, f"/root/testdata/{sf}")
    assert got.columns == ["conv_id", *COLUMNS]
    got = got.collect()
    want = reference([tuple(r) for r in rows])
    assert len(got) == len(want) and {r.conv_id: tuple(r[1:]) for r in got} == want


def test_edge_rows(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 else "assistant", f"t {t}.") for t in range(400)]  # fills several blocks
    rows += [(2, 5, "user", "same.")] * 300 + [(2, None, None, None), (2, None, "user", "null turn?")]
    rows += [(None, 0, "user", "a null key."), (None, 1, "assistant", "word " * 50_000 + ".")]
    rows += [(3, 1, "User", "capital."), (3, 1, "tool", "tie."), (3, 1, "tool", "another tie"), (3, 2, "", "no role."), (3, 3, "umpire", "keeps its name!\n\t ")]
    rows += [(4, None, None, None)] + [(5, i, "assistant", "over and over.") for i in range(50)] + [(6, 2**62 + i, "user", "x\x85") for i in (1, 3)] + [(2**60 + 1, 1, "system", "é.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = op13_conversation_repair(spark, str(tmp_path)).collect()
    want = reference(rows)
    assert len(got) == len(want) and {r.conv_id: tuple(r[1:]) for r in got} == want


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi.", 7, 8), ("a", 2, "assistant", "Ho.", 7, 8)], "conv_id string, turn int, role string, text string, k int, symbols int")
    judged, rows = c.repair_conversations(df)
    assert [tuple(r) for r in judged.select("conv_id", "cost", "audit").collect()] == [("a", 0, "KK")]
    assert [tuple(r) for r in rows.select("conv_id", "place", "role", "text").collect()] == [("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho.")]
    judged, rows = c.repair_conversations(df.where("false"))
    assert not judged.count() and not rows.count()
    assert not damaged(df.where("false")).count()
