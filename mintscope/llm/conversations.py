"""Repair of damaged conversations by a run-length dynamic programme over their turns.

A turn is one symbol: the initial of its role and its fault. A conversation is its symbols in order, and a repair keeps,
re-roles, deletes or inserts turns until the roles read system? (user assistant)+, or nothing is left. Equal consecutive
symbols are a run; a run's costs are its symbol's min-plus transition raised to the run's length by cached binary powers.
The choices, the least audit of the cheapest, are then unrolled from the same powers, half by half.

Spark orders the turns over all tasks, judges their faults and brings symbols together, one character a turn; texts stay in
the block of rows that they were sorted to, where the block's part of the audit is replayed on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut

# Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Initials that count; any other is "o" and can't be kept.
INITIALS = "suao"
#: What a turn suffers from: nothing, an end cut off, or a fault (blank, repeated) that no edit but deletion mends.
SOUND, CUT_OFF, LOST = range(3)
# States: nothing yet, after system, after user, after assistant; where each initial leads, and what comes next by insertion.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = "uuau"
ENDS = (0, 3)
FAR = 1 << 60
#: Characters of a piece of a long conversation's text on its way to be hashed.
PIECE = 1 << 20
SPACE = r"[\x20\x09-\x0D]"

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def symbol(initial: str, fault: int) -> str:
    return chr(ord("a") + 3 * INITIALS.index(initial) + fault)


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


def _inserts() -> Matrix:
    """The cheapest insertions from each state to each."""
    out = [[FAR] * 4 for _ in range(4)]
    for q in range(4):
        out[q][q] = 0
        at, cost = q, 0
        for _ in range(3):
            at, cost = NEXT[at][WANTED[at]], cost + INSERT
            out[q][at] = min(out[q][at], cost)
    return tuple(map(tuple, out))


INSERTS = _inserts()


@lru_cache(maxsize=None)
def edits(of: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state: (letter, cost, state after) of the edits that take in one turn of this symbol, in the letters' order."""
    n = ord(of) - ord("a")
    initial, fault = INITIALS[n // 3], n % 3
    extra = TRUNCATED if fault == CUT_OFF else 0
    out = []
    for q in range(4):
        own = [("D", DELETE, q)]
        if fault != LOST:
            if initial in NEXT[q]:
                own.append(("K", extra, NEXT[q][initial]))
            own.append(("R", REROLE + extra, NEXT[q][WANTED[q]]))
        out.append(tuple(own))
    return tuple(out)


@lru_cache(maxsize=None)
def power(of: str, j: int) -> Matrix:
    """Costs of 2^j turns of one symbol with what is inserted before each, from state to state; 12 symbols, so the cache is small."""
    if j:
        return _product(power(of, j - 1), power(of, j - 1))
    one = [[FAR] * 4 for _ in range(4)]
    for q, own in enumerate(edits(of)):
        for _, cost, to in own:
            one[q][to] = min(one[q][to], cost)
    return _product(INSERTS, tuple(map(tuple, one)))


def _bits(n: int) -> list[int]:
    return [j for j in range(n.bit_length()) if n >> j & 1]


def _unroll(of: str, j: int, state: int, after: Vector, out: list[str]) -> int:
    """Puts the edits of 2^j turns to `out`, given the costs `after` them; returns the state reached."""
    if j:
        state = _unroll(of, j - 1, state, _apply(power(of, j - 1), after), out)
        return _unroll(of, j - 1, state, after, out)
    here = _apply(power(of, 0), after)
    while True:  # the letters in order: D, I, K, R
        own = edits(of)[state]
        done = [(a, to) for a, cost, to in own if cost + after[to] == here[state]]
        to = NEXT[state][WANTED[state]]
        if (not done or done[0][0] > "I") and INSERT + here[to] == here[state]:
            out.append("I")
            state = to
            continue
        out.append(done[0][0])
        return done[0][1]


def _repair(symbols: str) -> tuple[int, str]:
    runs = [(of, sum(1 for _ in same)) for of, same in groupby(symbols)]
    costs = [tuple(min(INSERTS[q][e] for e in ENDS) for q in range(4))]
    for of, n in reversed(runs):
        v = costs[-1]
        for j in _bits(n):
            v = _apply(power(of, j), v)
        costs.append(v)
    costs.reverse()
    out: list[str] = []
    state = 0
    for (of, n), v in zip(runs, costs[1:], strict=True):
        after: list[tuple[int, Vector]] = []
        for j in _bits(n):  # the last parts of the run first
            after.append((j, v))
            v = _apply(power(of, j), v)
        for j, behind in reversed(after):
            state = _unroll(of, j, state, behind, out)
    left = costs[-1][state]
    while left:
        out.append("I")
        left, state = left - INSERT, NEXT[state][WANTED[state]]
    return costs[0][0], "".join(out)


_known = lru_cache(maxsize=100_000)(_repair)


def repair(symbols: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a conversation's symbols; of equally cheap ones the least audit."""
    return _known(symbols) if len(symbols) <= 64 else _repair(symbols)


def illegal(symbols: str) -> int:
    """Adjacent turns, before any repair, whose initials aren't su, ua or au."""
    roles = "".join(INITIALS[(ord(c) - ord("a")) // 3] for c in symbols)
    return sum(p not in ("su", "ua", "au") for p in map("".join, zip(roles, roles[1:], strict=False)))


def turns(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(k, turn, role, text, h, block, at): the table's turns in order, written to the shared folder.

    Null roles and texts are one space; h, the text's SHA-256, tells texts apart. Order: key, turn (nulls first), role,
    h. The rows are sorted over all tasks, equal ones by where they were read, so that a conversation, or a row that repeats, may
    fill many tasks: `block` is the task, `at` the place among all rows.
    """
    filled = df.select(
        F.col(key).cast("string").alias("k"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text")
    )
    told = filled.withColumn("h", F.unhex(F.sha2("text", 256))).withColumn("read", F.monotonically_increasing_id())
    order = ["k", "turn", "role", "h", "read"]
    ordered = told.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ordered.select("k", "turn", "role", "text", "h", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("at")), "turns")


def symbols(rows: DataFrame) -> DataFrame:
    """(k, blocks, blank, duplicate, truncated) of what `turns` gives; blocks: an array of (block, symbols), one character a turn.

    Texts stay where they are. What a block has of a conversation becomes a string there, and only these strings meet.
    """
    last = F.regexp_extract("text", rf"(?s)([^\x20\x09-\x0D]){SPACE}*\z", 1)
    light = rows.select("k", "role", "h", "block", "at", last.alias("last"))
    first = light.where("last <> ''").groupBy(F.col("k").alias("fk"), F.col("role").alias("fr"), F.col("h").alias("fh")).agg(F.min("at").alias("first"))
    met = light.join(first, F.col("k").eqNullSafe(F.col("fk")) & (F.col("role") == F.col("fr")) & (F.col("h") == F.col("fh")), "left")
    fault = F.when((F.col("last") == "") | (F.col("at") > F.col("first")), LOST).when(F.col("last").isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    judged = met.select("k", "block", "at", "last", fault.alias("fault"), F.chr((ord("a") + 3 * initial + fault).cast("int")).alias("s"))
    counts = [F.count_if(c).alias(n) for n, c in (("blank", F.col("last") == ""), ("duplicate", (F.col("last") != "") & (F.col("fault") == LOST)), ("truncated", F.col("fault") == CUT_OFF))]
    string = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), "").alias("symbols")
    blocks = judged.groupBy("k", "block").agg(string, *counts)
    return blocks.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("block", "symbols"))).alias("blocks"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])


def parts(blocks: list[dict], audit: str) -> list[dict]:
    """What of the audit belongs to each block, and the state that it begins in."""
    if len(blocks) == 1:
        return [{"block": blocks[0]["block"], "state": 0, "edits": audit}]
    out, at, state = [], 0, 0
    for b in blocks:
        begin, entry = at, state
        for of in b["symbols"]:
            while audit[at] == "I":
                at, state = at + 1, NEXT[state][WANTED[state]]
            if audit[at] == "K":
                state = NEXT[state][INITIALS[(ord(of) - ord("a")) // 3]]
            elif audit[at] == "R":
                state = NEXT[state][WANTED[state]]
            at += 1
        out.append({"block": b["block"], "state": entry, "edits": audit[begin:at]})
    out[-1]["edits"] += audit[at:]
    return out


def audits(found: DataFrame) -> DataFrame:
    """(k, blank, duplicate, truncated, illegal, cost, audit, parts) of what `symbols` gives."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for blocks in pdf["blocks"]:
                own = [b if isinstance(b, dict) else b.asDict() for b in blocks]
                whole = "".join(b["symbols"] for b in own)
                cost, audit = repair(whole)
                out.append((illegal(whole), cost, audit, parts(own, audit)))
            yield pdf.drop(columns="blocks").assign(**{c: [r[i] for r in out] for i, c in enumerate(("illegal", "cost", "audit", "parts"))})

    return found.mapInPandas(judge, "k string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<block: int, state: int, edits: string>>")


def repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(k, block, place, role, text, first, whole): the turns that the audits leave, re-roled and inserted ones among them.

    In order of block and place; first: the conversation's first; whole: its block has all of it. A block's edits and then its
    rows stream through one task, sorted by Spark; the task holds one batch and the edits of one block.
    """
    head = judged.select("k", (F.size("parts") == 1).alias("whole"), F.explode("parts").alias("p"))
    heads = head.select("k", "p.block", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("p.edits").alias("text"), F.col("p.state").alias("state"), "whole")
    body = rows.select("k", "block", "at", "role", "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("boolean").alias("whole"))
    stream = heads.union(body).repartition("k", "block").sortWithinPartitions("k", "block", "at")
    names = {"u": "user", "a": "assistant"}

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        audit, at, state, place, whole = "", 0, 0, 0, False
        out: list[tuple] = []

        def put(k, block, initial, role, text):
            nonlocal state, place
            out.append((k, block, place, role, text, state == 0, whole))
            state, place = NEXT[state][initial], place + 1

        for pdf in batches:
            for k, block, no, role, text, entry, one in zip(*(pdf[c] for c in ("k", "block", "at", "role", "text", "state", "whole")), strict=True):
                if no < 0:
                    audit, at, state, place, whole = text, 0, int(entry), 0, bool(one)
                else:
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        put(k, block, role[:1], role, text)
                    elif edit == "R":
                        put(k, block, WANTED[state], names[WANTED[state]], text)
                while at < len(audit) and audit[at] == "I":
                    put(k, block, WANTED[state], names[WANTED[state]], "")
                    at += 1
            yield pd.DataFrame(out, columns=["k", "block", "place", "role", "text", "first", "whole"])
            out = []

    return stream.mapInPandas(replay, "k string, block int, place long, role string, text string, first boolean, whole boolean")


def digests(out: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, sha256) of each conversation's `role:text` joined by line ends, over the repaired rows as they stream.

    What is in one block is hashed there. A conversation of many blocks comes as a few long pieces of text, which meet once more.
    """
    import hashlib

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        done: list[tuple] = []
        own, size, piece = None, 0, 0

        def flush():
            nonlocal size, piece
            if held:
                text = "".join(held)
                done.append((own[0], None, None, None, hashlib.sha256(text.encode()).hexdigest()) if own[2] and not piece else (own[0], own[1], piece, text, None))
            held.clear()
            size, piece = 0, piece + 1

        for pdf in batches:
            for k, block, whole, first, role, text in zip(*(pdf[c] for c in ("k", "block", "whole", "first", "role", "text")), strict=True):
                if own != (k, block, whole):
                    flush()
                    own, piece = (k, block, whole), 0
                elif size > PIECE:
                    flush()
                held.append(f"{role}:{text}" if first else f"\n{role}:{text}")
                size += len(held[-1])
            yield pd.DataFrame(done, columns=["k", "block", "piece", "text", "sha256"]).astype({"block": "Int32", "piece": "Int32"})
            done = []
        flush()
        yield pd.DataFrame(done, columns=["k", "block", "piece", "text", "sha256"]).astype({"block": "Int32", "piece": "Int32"})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, digest = (None,), None
        done: list[tuple[str, str]] = []
        for pdf in batches:
            for k, text in zip(pdf["k"], pdf["text"], strict=True):
                if own != (k, True):
                    if digest:
                        done.append((own[0], digest.hexdigest()))
                    own, digest = (k, True), hashlib.sha256()
                digest.update(text.encode())
            yield pd.DataFrame(done, columns=["k", "sha256"])
            done = []
        if digest:
            yield pd.DataFrame([(own[0], digest.hexdigest())], columns=["k", "sha256"])

    rows = out.select(F.col(key).cast("string").alias("k"), "block", "whole", "first", "role", "text")
    short = cut(rows.mapInPandas(shorten, "k string, block int, piece int, text string, sha256 string"), "digests")
    rest = short.where("sha256 is null").select("k", "block", "piece", "text").repartition("k").sortWithinPartitions("k", "block", "piece")
    both = short.where("sha256 is not null").select("k", "sha256").union(rest.mapInPandas(join, "k string, sha256 string"))
    return both.select(F.col("k").cast(out.schema[key].dataType).alias(key), "sha256")


def repair_conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(judged, rows): per conversation its faults, the cost and audit of its repair; and the repaired turns.

    judged: key, blank, duplicate, truncated, illegal, cost, audit, parts (the audit by blocks of rows). rows: key, block,
    place, role, text, first, whole; in order of block and place.
    Null roles and texts count as one space, null turns come first, a null key is a key like others. Turns of one
    number are ordered by role and the text's SHA-256. Rows that repeat are duplicates of the first. Blank, empty and very
    long texts are texts like others. An empty table has no conversations. Other columns are not read, whatever their names.
    An audit has one letter a turn, so a conversation may have as many turns as a string has bytes (2^31).
    """
    bounded_batches(df.sparkSession)
    own = turns(df, key, turn, role, text)
    judged = cut(audits(symbols(own)), "audits")
    back = F.col("k").cast(df.schema[key].dataType).alias(key)
    return judged.select(back, *judged.columns[1:]), repaired(own, judged).select(back, "block", "place", "role", "text", "first", "whole")
