"""Packing into near-equal windows by Karmarkar-Karp multiway differencing.

A task turns its texts into ids and gathers them into pools of POOL windows' tokens. Pieces that fill a window are one; the
others of a pool are parted into near-equal windows by differencing. Most texts stay whole; a FINE part of a pool is cut
into small pieces, which even out the rest. Where a window's capacity is still exceeded, the pool gives tokens back, so
that its texts need more windows; where that would cost more than SLACK tokens a window, the longest pieces are halved
first. What a pool leaves over goes to the next, and the task's last rest to windows whose lengths are powers of two,
which need no padding.

No key decides where a text is packed, and none is shuffled: a task holds a pool of ids and a batch of texts.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator
from itertools import cycle

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .packing import _tokenizer

WINDOW = 2048
#: Windows of a pool; tokens that are left free in each at first, and that may be left free before pieces are halved.
POOL, FREE, SLACK = 512, 4, 16
#: Part of a pool that is cut finely, and into what parts of a window, in turn.
FINE, PARTS = 0.08, (16, 32, 64, 128, 256)
#: Pieces aren't halved below this part of a window.
SMALLEST = 32

Piece = tuple[int, int, int]  # number of the text in the pool, start, length


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k sets at most of the numbers 0..len(sizes)-1 with near-equal sums of their sizes, by largest differencing.

    A partial partition is its non-empty sets in order of their sums; the two whose sums differ most are merged, the largest
    set of one with the smallest of the other. What is held stays linear in the sizes, as empty sets aren't written down.
    """
    heap = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k  # sets that have to share a window: the smallest of both
        if len(b) == 1:
            s, t, node = b[0]
            if over > 0:
                low, _, other = a.pop(0)
                s, node = s + low, (node, other)
            insort(a, (s, t, node))
        elif over <= 0:
            a = sorted(a + b)
        else:
            met = [(x[0] + y[0], x[1], (x[2], y[2])) for x, y in zip(a[:over], reversed(b[:over]), strict=True)]
            a = sorted(a[over:] + b[over:] + met)
        least = a[0][0] if len(a) == k else 0
        heapq.heappush(heap, (least - a[-1][0], tie, a))
        tie += 1
    out = []
    for _, _, node in heap[0][2] if heap else []:
        own, stack = [], [node]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                own.append(x)
        out.append(own)
    return out


def take(held: list[Piece], tokens: int) -> tuple[list[Piece], list[Piece]]:
    """The first `tokens` tokens of the pieces, and the rest; one piece is cut where they part."""
    for at, (i, a, n) in enumerate(held):
        if n > tokens:
            return held[:at] + ([(i, a, tokens)] if tokens else []), [(i, a + tokens, n - tokens), *held[at + 1 :]]
        tokens -= n
    return held, []


def even(piece: Piece, largest: int) -> list[Piece]:
    """The piece in the fewest near-equal pieces of up to `largest` tokens."""
    i, a, n = piece
    m = -(-n // largest)
    return [(i, a + n * j // m, n * (j + 1) // m - n * j // m) for j in range(m)]


def fine(pieces: list[Piece], window: int) -> list[Piece]:
    """The pieces cut into PARTS of a window, in turn."""
    sizes = cycle([max(1, window // p) for p in PARTS])
    out = []
    for i, a, n in pieces:
        while n:
            m = min(n, next(sizes))
            out.append((i, a, m))
            a, n = a + m, n - m
    return out


def part(held: list[Piece], k: int, window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """(k windows, the rest) of pieces that hold k windows' tokens at least."""
    largest, free = window, min(FREE, window - 1)
    while k:
        pool, rest = take(held, k * (window - free))
        small, whole = take(pool, int(FINE * k * window))
        pieces = [q for p in whole for q in even(p, largest)] + fine(small, window)
        sets = differencing([n for *_, n in pieces], k)
        over = max(sum(pieces[i][2] for i in s) for s in sets) - window
        if over <= 0:
            return [[pieces[i] for i in s] for s in sets], rest
        if free + over <= SLACK or largest * SMALLEST <= window:
            free = min(free + over, window - 1)
        else:
            largest //= 2
    return [], held


def windows(held: list[Piece], window: int, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """(windows, rest) of a pool; after the last pool there is no rest."""
    out, rest = part(held, sum(n for *_, n in held) // window, window)
    if last:
        left = sum(n for *_, n in rest)
        while left:
            full = min(window, 1 << (left.bit_length() - 1))
            own, rest = take(rest, full)
            out.append(own)
            left -= full
    return out, rest


def pack(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): all texts as pieces in near-equal windows of up to `window` tokens.

    A null text counts as empty (one id, end_id); a null key stays null; repeated rows are packed as often as they
    come; a text of any length is cut; an empty table gives an empty result. Other columns are not read, whatever their names.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        ids_of = _tokenizer(vocabulary)
        number = TaskContext.get().partitionId() << 40
        texts: list[tuple] = []  # key, ids
        held: list[Piece] = []
        size, of_keys = 0, None

        def rows(sets: list[list[Piece]]):
            nonlocal number
            out = []
            for own in sets:
                at = 0
                for i, a, n in sorted(own):
                    k, ids = texts[i]
                    out.append((k, a, n, zlib.crc32(ids[a : a + n].tobytes()), len(ids), number, at))
                    at += n
                number += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], of_keys), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            of_keys = batch.schema.field("k").type
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                ids = np.array([*(ids_of(t) if t else ()), end_id], dtype="<u4")
                texts.append((k, ids))
                i, n = len(texts) - 1, len(ids) % window
                full = [[(i, a, window)] for a in range(n, len(ids), window)]
                if full:
                    yield rows(full)
                if n:
                    held.append((i, 0, n))
                    size += n
                if size >= POOL * window:
                    sets, held = windows(held, window, False)
                    yield rows(sets)
                    texts = [texts[i] for i, *_ in held]
                    held = [(j, a, n) for j, (_, a, n) in enumerate(held)]
                    size = sum(n for *_, n in held)
        if held:
            yield rows(windows(held, window, True)[0])

    read = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    packed = read.mapInArrow(run, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return cut(packed, "windows").withColumnRenamed("k", key)
