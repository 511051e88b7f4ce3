"""Periodic runs of words by a dictionary of basic factors.

For each power of two L every word position is named by the L words that begin there, from the names of the two halves.
Where a name comes again within 2 L words and again as far on, its places are an arithmetic progression and their distance a
proposed period. A proposal is extended both ways over equal words; proposals that extend to the same stretch are one run.

A run of period q and at least 4 q words holds, for the L with q <= L < 2 q, a place whose name comes again q and 2 q
words on and not before, so every run is proposed. A stretch that a proposal extends to has no smaller period, since the
name would have come again sooner.

Texts are spread by Spark; a task takes a batch of whole texts, whose words are named together with their text, so that no
factor crosses from one text to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh

#: Least words of a run, and least times that its period fits in.
MIN_WORDS, MIN_TIMES = 6, 4
#: Words of a batch that are named together.
TOGETHER = 500_000
RUNS = "array<struct<start: long, length: long, period: long>>"


def names(ids: np.ndarray) -> np.ndarray:
    """Equal values as equal numbers from 0, in no more than len(ids) numbers."""
    return np.unique(ids, return_inverse=True)[1].astype(np.int64)


def proposals(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) for each power of two up to `longest`, for words whose numbers differ between texts.

    Only places whose name comes again are carried on: a factor that is there once is there once however it goes on.
    """
    n = len(words)
    at = np.arange(n)  # the places that are still looked at, in order
    name = names(words)
    length = 1
    while len(at):
        order = np.argsort(name, kind="stable")  # places of one name in order
        again = np.flatnonzero(name[order[1:]] == name[order[:-1]])
        gap = np.zeros(n, dtype=np.int64)  # how far on the name of a place comes again
        gap[at[order[again]]] = at[order[again + 1]] - at[order[again]]
        near = at[gap[at] > 0]
        near = near[gap[near] <= 2 * length]
        near = near[gap[near + gap[near]] == gap[near]]
        if len(near):
            yield near, gap[near]
        if length >= longest:
            return
        repeated = np.zeros(len(at), dtype=bool)
        repeated[order[again]] = repeated[order[again + 1]] = True
        number = np.full(n + length, -1, dtype=np.int64)
        number[at[repeated]] = name[repeated]
        at = at[repeated]
        at = at[number[at + length] >= 0]
        name = names(number[at] * (n + 1) + number[at + length])
        length *= 2


def find(words: np.ndarray, text: np.ndarray, begin: np.ndarray, min_words: int = MIN_WORDS, times: int = MIN_TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in that order, of the texts that begin at `begin` (with the end of all).

    `words`: numbers that differ between texts; `text`: the text of each word.
    """
    sizes = np.diff(begin)
    longest = 1
    while longest < int(sizes.max(initial=0)) // times:
        longest *= 2
    found: list[np.ndarray] = []
    for places, periods in proposals(words, longest):
        # one of the neighbouring places that propose the same period stands for all of them
        lead = np.ones(len(places), dtype=bool)
        lead[1:] = (np.diff(places) != 1) | (np.diff(periods) != 0)
        found.append(np.stack([text[places[lead]], periods[lead], places[lead]], axis=1))
    if not found:
        return np.empty((0, 4), dtype=np.int64)
    proposed = np.unique(np.concatenate(found), axis=0)
    out: list[tuple[int, int, int, int]] = []
    cuts = np.flatnonzero(np.any(np.diff(proposed[:, :2], axis=0) != 0, axis=1)) + 1
    for group in np.split(proposed, cuts):
        t, q = int(group[0, 0]), int(group[0, 1])
        if sizes[t] < max(min_words, times * q):
            continue
        own = words[begin[t] : begin[t + 1]]
        unequal = np.concatenate([[-1], np.flatnonzero(own[q:] != own[:-q]), [len(own) - q]])
        stretch = np.unique(np.searchsorted(unequal, group[:, 2] - begin[t], side="right"))
        for i in stretch[stretch < len(unequal)]:
            start, length = int(unequal[i - 1]) + 1, int(unequal[i] - unequal[i - 1]) - 1 + q
            if length >= max(min_words, times * q):
                out.append((t, start, length, q))
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


def _batch(texts: list[str | None], min_words: int, times: int) -> Iterator[tuple[int, list[dict], str]]:
    split = [(t or "").encode().split() for t in texts]  # splits at 09 to 0D and 20, as bytes
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(len(split)), sizes)
    number, kinds = pd.factorize(np.array([w for own in split for w in own], dtype=object))
    runs = find(text * (len(kinds) + 1) + number, text, begin, min_words, times)
    first = np.searchsorted(runs[:, 0], np.arange(len(split) + 1))
    for i, own in enumerate(split):
        mine = runs[first[i] : first[i + 1], 1:].tolist()
        keep = np.ones(len(own), dtype=bool)
        for start, length, q in mine:
            keep[start + q : start + length] = False
        kept = b" ".join(own if keep.all() else [own[k] for k in np.flatnonzero(keep)])
        yield len(own), [{"start": a, "length": n, "period": q} for a, n, q in mine], kept.decode()


def find_runs(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS, times: int = MIN_TIMES) -> DataFrame:
    """The rows of df with n_words, runs (start, length, period; by start, then period) and collapsed.

    Words are what stands between the bytes 09 to 0D and 20. A run is a stretch of at least `min_words` words and `times` times its smallest
    period that no neighbouring word extends. Collapsed is the text's words, one space between, without those that
    lie in any run behind that run's first period. Null and empty texts have no words, no runs and an empty
    collapsed text; repeated rows come as often as they are there; texts of any length are judged whole, one batch
    of texts in a task's memory. df's other columns are kept; one that is named n_words, runs or collapsed keeps its
    name and the new one gets underscores before its own. `times` is 4 or more: below that a run needn't be proposed.
    """
    if times < 4:
        raise ValueError("a run must be four periods long at least")
    bounded_batches(df.sparkSession)
    given = fresh(df, "given")[0]
    new = fresh(df, "n_words", "runs", "collapsed")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], f"`{new[0]}` long, `{new[1]}` {RUNS}, `{new[2]}` string"])
    out = [f.name for f in df.schema.fields]

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            texts = batch.column(given).to_pylist()
            done, held, size = [], [], 0
            for t in texts:
                held.append(t)
                size += len(t) if t else 0
                if size > 8 * TOGETHER:
                    done += _batch(held, min_words, times)
                    held, size = [], 0
            done += _batch(held, min_words, times)
            runs = pa.array([d[1] for d in done], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
            more = [pa.array([d[0] for d in done], pa.int64()), runs, pa.array([d[2] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], *more], names=[*out, *new])

    return df.withColumn(given, F.col(text).cast("string")).mapInArrow(run, schema)
