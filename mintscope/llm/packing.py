"""Best-fit packing of token pieces by length patterns.

Spark counts the pieces of each length. On that histogram (as long as the window at most, whatever the input) few-document
patterns that fill a window are enumerated, their repeat counts fitted to the histogram by non-negative least
squares and rounded down, and what is left is packed best-fit, longest first, many equal windows at a time. The plan
says, for the k-th piece of each length, which window and place it gets; a join deals the pieces out.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, fresh

WINDOW = 1024
#: Runs of a plan (24 bytes each) up to which they are broadcast.
RUNS = 1_000_000


@lru_cache(maxsize=1)
def _tokenizer(vocabulary: str):
    """A function from text to ids for a byte-level BPE file, and its special strings.

    The vocabulary's rank file beside it, where there is one, encodes ordinary text to the same ids in a seventh of the time.
    """
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary)
    slow = lambda text: full.encode(text, add_special_tokens=False).ids
    ranks = os.path.splitext(vocabulary)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    return lambda text: slow(text) if any(s in text for s in special) else quick(text)


def pieces(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """(key, piece, start, length, ids_crc32): every text as token ids and end_id, cut into pieces of `window` where longer.

    A null text counts as empty (one piece of one id); a null key stays null. The first piece of a long text takes
    what is left over, so that all others are full.
    """

    bounded_batches(df.sparkSession)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = _tokenizer(vocabulary)
        for pdf in parts:
            out = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                ids = np.array([*(ids_of(t) if t else ()), end_id], dtype="<u4")
                n = len(ids)
                at = [0] if n <= window else [0, *range(n % window or window, n, window)]
                out += [(k, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(at, [*at[1:], n], strict=True))]
            yield pd.DataFrame(out, columns=["k", "piece", "start", "length", "ids_crc32"]).astype({"k": "Int64"})

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInPandas(encode, "k long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("k", key)


def patterns(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """All sets of up to three present lengths, longest first, that fill the window exactly: window^2 / 12 at most, 87,000 of 1024."""
    there = set(lengths)
    out: list[tuple[int, ...]] = [(window,)] if window in there else []
    out += [(a, window - a) for a in there if window - a in there and a >= window - a]
    for a in sorted(there, reverse=True):
        for b in range(min(a, window - a - 1), 0, -1):
            if b in there and (c := window - a - b) <= b and c in there:
                out.append((a, b, c))
    return out


def fit_counts(found: list[tuple[int, ...]], counts: np.ndarray, steps: int = 600) -> np.ndarray:
    """Non-negative least squares min |A x - counts|, A[l, p] the times that pattern p has length l, by accelerated projected gradient."""
    cols = np.concatenate([np.full(len(p), i) for i, p in enumerate(found)])
    rows = np.concatenate([np.array(p) for p in found])
    n, m = len(counts), len(found)
    weight = 1 / np.sqrt(np.maximum(counts, 1.0))  # relative to what is there
    sums = lambda x: np.bincount(rows, weights=x[cols], minlength=n)
    back = lambda r: np.bincount(cols, weights=r[rows], minlength=m)
    v = np.ones(m)
    for _ in range(20):
        v = back(weight**2 * sums(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(m)
    t = 1.0
    for _ in range(steps):
        z = np.maximum(0, y - back(weight**2 * (sums(y) - counts)) / (1.05 * top))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = z + (t - 1) / u * (z - x), z, u
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one window, number of such windows), which use up the histogram."""
    counts = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    made: list[tuple[tuple[int, ...], int]] = []
    if found := patterns([int(i) for i in np.flatnonzero(counts)], window):
        for p, x in sorted(zip(found, fit_counts(found, counts.astype(float)), strict=True), key=lambda v: -v[1]):
            times = int(min([round(x), *(counts[a] // p.count(a) for a in set(p))]))
            if times > 0:
                made.append((p, times))
                np.subtract.at(counts, list(p), times)
    return made + best_fit(counts, window)


def best_fit(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over whole classes of equal windows: a piece goes where the least room stays."""
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(window + 1)]
    for length in range(window, 0, -1):
        left = int(counts[length])
        for space in range(length, window + 1):
            while left and room[space]:
                # the windows that are opened here are not looked at again for the same length unless it fits once more
                has, n = room[space].popitem()
                fits = space // length
                full, rest = divmod(left, fits)
                use = min(n, full)
                if use:
                    to = room[space - fits * length]
                    to[own] = to.get(own := has + (length,) * fits, 0) + use
                    left, n = left - use * fits, n - use
                if n and left and left < fits:
                    to = room[space - left * length]
                    to[own] = to.get(own := has + (length,) * left, 0) + 1
                    left, n = 0, n - 1
                if n:
                    room[space][has] = n
        if left:
            fits = window // length
            full, rest = divmod(left, fits)
            for k, n in ((fits, full), (rest, 1)):
                if k and n:
                    to = room[window - k * length]
                    to[own] = to.get(own := (length,) * k, 0) + n
    return [(p, n) for r in room for p, n in r.items()]


def placement(made: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Runs of the plan: pieces number lo..lo+n-1 of a length go to windows first.. at offset."""
    rows, used, window = [], {}, 0
    for lengths, n in made:
        at = 0
        for a in lengths:
            rows.append((a, used.get(a, 0), n, window, at))
            used[a] = used.get(a, 0) + n
            at += a
        window += n
    return pd.DataFrame(rows, columns=["length", "lo", "n", "first", "offset"]).astype("int64")


def place(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with `length` and `ids_crc32`; no window is longer than `window`."""
    spark = parts.sparkSession
    block, at, rank, before = fresh(parts, "block", "at", "rank", "before")
    # pieces are numbered within the task that wrote them; one row for each length and task carries on what came before
    written = cut(parts.withColumns({block: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "pieces")
    sizes = written.groupBy("length", block).agg(F.count(F.lit(1)).alias("n"))
    total = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # as long as the window at most
    runs = placement(plan(total, window))
    bases = sizes.select("length", block, F.expr(f"coalesce(sum(n) over (partition by length order by {block} rows between unbounded preceding and 1 preceding), 0)").alias(before))
    numbered = written.withColumn(rank, F.expr(f"row_number() over (partition by length, {block} order by {at}) - 1"))
    numbered = numbered.join(bases, ["length", block]).withColumn(rank, F.col(rank) + F.col(before))
    # each length's runs as one sorted array: the run of a rank is the last that begins at or before it
    grouped = runs.sort_values(["length", "lo"]).groupby("length")
    table = spark.createDataFrame(
        [(int(k), g["lo"].tolist(), g["first"].tolist(), g["offset"].tolist()) for k, g in grouped],
        f"length long, lo{rank} array<long>, first{rank} array<long>, offset{rank} array<long>",
    )
    # a plan has as many runs as there are patterns, whatever the input; beyond what is small the join is left to Spark
    rows = numbered.join(F.broadcast(table) if len(runs) <= RUNS else table, "length")
    k = F.expr(f"size(filter(lo{rank}, x -> x <= {rank}))")
    return rows.withColumn(f"k{rank}", k).select(
        *parts.columns,
        F.expr(f"first{rank}[k{rank} - 1] + {rank} - lo{rank}[k{rank} - 1]").alias("sequence_id"),
        F.expr(f"offset{rank}[k{rank} - 1]").alias("offset"),
    )


def pack(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): all texts in few windows of `window` tokens.

    Repeated rows are packed as often as they come; an empty table gives an empty result. Other columns are not read.
    """
    return place(pieces(df, vocabulary, key, text, window, end_id), window)
