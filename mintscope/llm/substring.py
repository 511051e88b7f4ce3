"""Removal of repeated substrings by longest-previous-factor in suffix order.

A byte goes if a string of MIN bytes over it also starts in a document with a smaller key. A suffix array of the corpus
would do: sorted suffixes, for each the nearest neighbours before and after it that come from smaller documents, and the
longer of the two common prefixes (the longest previous factor) tells whether an earlier match of MIN bytes exists. Spark
builds it in parts that can be sorted apart:

1. Of the K-byte strings in each MIN-byte window the one of smallest hash is the window's anchor. Equal windows have
   equal anchors, so it is enough to compare suffixes that begin in windows of one anchor. An anchor's context, the
   bytes of all its windows, is hashed.
2. Anchors are dealt out by hash, packed. Where two contexts are equal (anchor and context agree in 48 bits each), the
   later document's is covered whole; within a task of step 1 that is seen before anything is sent. What is left are
   different contexts that share an anchor. A window has SIDE bytes or more after its anchor, or more than that before
   it; so of these a context stays only if it also shares SIDE bytes after its anchor, or that many before it, with
   another document's (told by a hash of 23 bits beside the anchor's).
3. The text of what stays is fetched from the documents and dealt out by the anchor and the bytes after it, or the bytes
   before it and the anchor. So an anchor that is frequent in changing surroundings is spread over many groups. In a
   group, windows that occur once are put aside; the others' suffixes are sorted, and the previous and the next suffix
   from a smaller document give each its longest previous factor (up to MIN), which tells what is covered.
4. The covered spans meet their documents.

The number of groups of steps 2 and 3 grows with the bytes of the input, so that a task's share stays the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut

MIN, K = 50, 16
#: Bytes beside an anchor that its windows are dealt out by: half of what a window holds beside it.
SIDE = (MIN - K) // 2
#: Bytes of input for each bucket that anchors, and then contexts, are dealt to.
BUCKET = 32 << 20
#: Bytes that are hashed at a time, and anchors that are packed at a time.
CHUNK, PACK = 1 << 20, 500_000
#: Contexts that are hashed at a time, and suffixes that are sorted at a time.
ROWS, SUFFIXES = 20_000, 250_000

_B, _R, _M = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, np.uint64(0xFF51AFD7ED558CCD)


def _kgrams(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k bytes, by doubling."""
    part, size, mul = buf.astype(np.uint64) + np.uint64(1), 1, _B
    out, done = None, 0
    while k:
        if k & 1:
            if out is None:
                out = part
            else:
                n = len(buf) - done - size + 1
                out = out[:n] * np.uint64(mul) + part[done : done + n]
            done += size
        k >>= 1
        if k:
            n = len(part) - size
            part = part[:n] * np.uint64(mul) + part[size : size + n]
            mul, size = mul * mul % (1 << 64), size * 2
    out = (out ^ (out >> np.uint64(33))) * _M
    return out ^ (out >> np.uint64(29))


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def _anchors(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose K bytes have the smallest hash in a window of MIN bytes, and those hashes."""
    h = _kgrams(buf, K)
    w = MIN - K + 1
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _sliding(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    places = np.flatnonzero(h == _sliding(np.concatenate([pad, low, pad]), w, np.maximum))
    return places, h[places]


class _Prefix:
    """Hashes of any stretch of a buffer, alike wherever it stands."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_R))]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(_R, -1, 1 << 64)))]))

    def of(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return (self.sums[z] - self.sums[a]) * self.down[a]


def _pieces(keys, texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about CHUNK bytes: the bytes, and for each piece its document, offset there, bounds in the buffer, and core.

    A text longer than CHUNK comes in pieces that overlap by more than a context on each side; anchors count in the core.
    """
    held, rows = [], []
    size = 0
    for d, t in zip(keys, texts, strict=True):
        b = t.encode("utf-8", "surrogatepass")
        if len(b) < MIN:
            continue
        for a in range(0, len(b), CHUNK):
            x, z = max(0, a - 2 * MIN), min(len(b), a + CHUNK + 2 * MIN)
            held.append(b[x:z])
            rows.append((d, x, size, size + z - x, size + a - x, size + min(len(b), a + CHUNK) - x))
            size += z - x
            if size >= CHUNK:
                yield np.frombuffer(b"".join(held), np.uint8), *(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
                held, rows, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), *(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))


_FIELDS = (("anchor", "<u8", 6), ("context", "<u8", 6), ("doc", "<i8", 8), ("start", "<u4", 4), ("size", "<u1", 1), ("off", "<u1", 1), ("after", "<u4", 3), ("before", "<u4", 3))


def _squeeze(cols: dict[str, np.ndarray]) -> bytes:
    """Columns of an anchor table as compressed bytes; hashes by their six low bytes, documents by differences."""
    raw = []
    for name, kind, width in _FIELDS:
        v = np.diff(cols[name], prepend=0) if name == "doc" else cols[name]
        raw.append(v.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)[:, :width].T.tobytes())
    return len(cols["doc"]).to_bytes(4, "little") + zstandard.compress(b"".join(raw), 1)


def _unsqueeze(blob: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw, at, out = zstandard.decompress(blob[4:]), 0, {}
    for name, kind, width in _FIELDS:
        v = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        v[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        out[name] = v.view(kind).ravel()
    out["doc"] = np.cumsum(out["doc"])
    return out


def _gather(blobs) -> dict[str, np.ndarray]:
    parts = [_unsqueeze(bytes(b)) for b in blobs]
    return {name: np.concatenate([p[name] for p in parts]) for name, *_ in _FIELDS}


def _by_context(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by anchor, context, document; in it where anchors and where contexts begin."""
    order = np.lexsort((t["doc"], t["context"], t["anchor"]))
    a, c = t["anchor"][order], t["context"][order]
    first_a = np.concatenate([[True], a[1:] != a[:-1]])
    return order, first_a, first_a | np.concatenate([[True], c[1:] != c[:-1]])


def _later(order, first_c, doc) -> np.ndarray:
    """In that order: whether a smaller document has the same context."""
    return doc[order] > doc[order][np.flatnonzero(first_c)][np.cumsum(first_c) - 1]


def _pack_anchors(buckets: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for pdf in parts:
            for buf, doc, offset, low, high, core_a, core_z in _pieces(pdf["d"], pdf["x"]):
                p, h = _anchors(buf)
                i = np.searchsorted(high, p, side="right")
                ok = (p + K <= high[i]) & (p >= core_a[i]) & (p < core_z[i])
                p, h, i = p[ok], h[ok], i[ok]
                a, z = np.maximum(p - (MIN - K), low[i]), np.minimum(p + MIN, high[i])
                ok = z - a >= MIN
                p, h, i, a, z = p[ok], h[ok], i[ok], a[ok], z[ok]
                prefix = _Prefix(buf)
                context = prefix.of(a, z) + (p - a).astype(np.uint64) * _M
                context = context ^ (context >> np.uint64(31))
                # what stands beside the anchor, 0 where no window reaches that far
                last, first = np.minimum(p + K + SIDE, z), np.maximum(p - (MIN - K - SIDE) - 1, a)
                after = np.where(last - p == K + SIDE, ((prefix.of(p + K, last) * _M) >> np.uint64(40)) | np.uint64(1), 0)
                before = np.where(p - first > MIN - K - SIDE, ((prefix.of(first, p) * _M) >> np.uint64(40)) | np.uint64(1), 0)
                held.append({"anchor": h, "context": context, "doc": doc[i], "start": a - low[i] + offset[i], "size": z - a, "off": p - a, "after": after, "before": before})
                if sum(len(x["doc"]) for x in held) >= PACK:
                    yield _flush(held, buckets)
                    held = []
        if held:
            yield _flush(held, buckets)

    return run


def _flush(held: list[dict], buckets: int) -> pd.DataFrame:
    t = {name: np.concatenate([x[name] for x in held]) for name, *_ in _FIELDS}
    order, _, first_c = _by_context(t)
    known = np.zeros(len(order), bool)
    known[order] = _later(order, first_c, t["doc"])
    to = ((t["anchor"] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    to[known] = t["doc"][known] % buckets  # these need no comparing, so they don't crowd their anchor's bucket
    t["after"], t["before"] = np.where(known, 0, t["after"]), np.where(known, 0, t["before"])
    out = []
    for flag in (False, True):
        rows = np.flatnonzero(known == flag)
        rows = rows[np.lexsort((t["start"][rows], t["doc"][rows], to[rows]))]
        ends = np.searchsorted(to[rows], np.arange(buckets + 1))
        for b in range(buckets):
            if ends[b] < ends[b + 1]:
                own = rows[ends[b] : ends[b + 1]]
                out.append((b, flag, _squeeze({name: v[own] for name, v in t.items()})))
    return pd.DataFrame(out, columns=["bucket", "known", "blob"])


def _met(anchor: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another document has the same anchor and the same bytes on this side of it."""
    order = np.lexsort((doc, side, anchor))
    a, s, d = anchor[order], side[order], doc[order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])]))
    ends = np.append(heads[1:], len(d)) - 1
    out = np.zeros(len(d), bool)
    out[order] = np.repeat(d[ends] > d[heads], ends - heads + 1)
    return out & (side > 0)


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's anchors: contexts that are covered (sides 0), and those whose text must be compared: 1 after the anchor, 2 before, 3 both.

    span is start, anchor's place and length.
    """
    doc, span, sides = [], [], []

    def give(t: dict[str, np.ndarray], rows, which) -> None:
        doc.append(t["doc"][rows])
        span.append((t["start"][rows].astype(np.int64) << 16) | (t["off"][rows].astype(np.int64) << 8) | t["size"][rows])
        sides.append(np.broadcast_to(which, len(doc[-1])))

    for flag, own in pdf.groupby("known"):
        t = _gather(own["blob"])
        if flag:
            give(t, slice(None), 0)
            continue
        order, _, first_c = _by_context(t)
        later = _later(order, first_c, t["doc"])
        give(t, order[later], 0)
        rows = order[~later]
        which = _met(t["anchor"][rows], t["after"][rows], t["doc"][rows]) + 2 * _met(t["anchor"][rows], t["before"][rows], t["doc"][rows])
        give(t, rows[which > 0], which[which > 0])
    return pd.DataFrame({"d": np.concatenate(doc), "span": np.concatenate(span), "sides": np.concatenate(sides).astype(np.int32)})


def _sides(b: bytes, start: int, off: int, size: int, sides: int = 3) -> Iterator[tuple[int, bytes, bytes]]:
    """(start, bytes, what they are dealt out by) of the windows of a context that reach SIDE bytes after its anchor (1), and of the others (2)."""
    p, end = start + off, start + size
    low = max(start, p - (MIN - K - SIDE))
    if sides & 1 and end - low >= MIN:
        yield low, b[low:end], b[p : p + K + SIDE]
    high = min(end, p + K + SIDE - 1)
    if sides & 2 and high - start >= MIN:
        yield start, b[start:high], b[p - (MIN - K - SIDE + 1) : p + K]


def _fetch(buckets: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            docs, starts, texts, keys = [], [], [], []
            for d, x, spans in zip(pdf["d"], pdf["x"], pdf["spans"], strict=True):
                b = x.encode("utf-8", "surrogatepass")
                for span in spans.tolist():
                    for start, text, key in _sides(b, span >> 24, span >> 16 & 255, span >> 8 & 255, span & 255):
                        docs.append(d)
                        starts.append(start)
                        texts.append(text)
                        keys.append(xxhash.xxh64_intdigest(key))
            if not texts:
                continue
            key = np.array(keys, dtype=np.uint64)
            to = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            head = np.array([docs, starts, list(map(len, texts))], dtype="<i8")
            order = np.argsort(to, kind="stable")
            out = []
            for own in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                out.append((int(to[own[0]]), len(own), zstandard.compress(head[:, own].tobytes() + b"".join([texts[i] for i in own.tolist()]), 1)))
            yield pd.DataFrame(out, columns=["bucket", "n", "blob"])

    return run


def _to_smaller(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place the common prefix with the nearest place before it that has a smaller document; 0 where there is none.

    lcp[i] is the common prefix of places i and i + 1. Steps of falling powers of two, over minima of so many places.
    """
    n = len(doc)
    low, shared = [doc], [lcp]
    while 2 << len(low) <= n:
        w = 1 << (len(low) - 1)
        low.append(np.minimum(low[-1][:-w], low[-1][w:]))
        shared.append(np.minimum(shared[-1][:-w], shared[-1][w:]))
    at, least = np.arange(n), np.full(n, MIN, dtype=lcp.dtype)
    for k in range(len(low) - 1, -1, -1):
        for _ in range(3 if k == len(low) - 1 else 1):  # n is less than four of the longest steps
            to = at - (1 << k)
            ok = np.flatnonzero(to >= 0)
            ok = ok[low[k][to[ok]] >= doc[ok]]
            least[ok] = np.minimum(least[ok], shared[k][to[ok]])
            at[ok] = to[ok]
    return np.where(at > 0, np.minimum(least, lcp[np.maximum(at - 1, 0)]) if n > 1 else 0, 0)


def longest_previous_factor(windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For windows (rows of MIN bytes) the longest prefix that a window of a smaller document begins with too.

    Windows are sorted, which is their suffix order; of the windows of smaller documents the nearest before and the
    nearest after a window in that order have the longest common prefixes with it, and the longer one is the answer.
    """
    n = len(windows)
    if n < 2:
        return np.zeros(n, np.int64)
    wide = np.zeros((n, -(-MIN // 8) * 8), np.uint8)
    wide[:, :MIN] = windows
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((doc, *words.T[::-1]))
    words, d = words[order], doc[order]
    differs = words[1:] ^ words[:-1]
    word = (differs != 0).argmax(axis=1)
    x = differs[np.arange(n - 1), word]
    zeros = (x[:, None] < np.uint64(1) << np.arange(56, 0, -8, dtype=np.uint64)).sum(axis=1)
    lcp = np.where(x == 0, MIN, word * 8 + zeros).astype(np.int16)
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(_to_smaller(d, lcp), _to_smaller(d[::-1], lcp[::-1])[::-1])
    return out


def _hashes(buf: np.ndarray, first: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Hashes of the windows of contexts that begin at `first` and have `per` windows each, of some contexts at a time."""
    out, done = np.empty(per.sum(), np.uint64), 0
    for i in range(0, len(per), ROWS):
        f, n = first[i : i + ROWS], per[i : i + ROWS]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - (f - f[0]), n)
        out[done : done + len(at)] = _Prefix(buf[f[0] : f[-1] + n[-1] + MIN - 1]).of(at, at + MIN)
        done += len(at)
    return out


def _covered_windows(windows, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a window of a smaller document is the same, for rows in order of (h, doc) whose windows `windows` gives (rows -> bytes).

    SUFFIXES rows are sorted at a time. Equal hashes may go on from one such part to the next: the next then begins with
    the first row of each window that these had so far.
    """
    hit, carried = np.zeros(len(doc), bool), np.zeros(0, np.int64)
    for i in range(0, len(doc), SUFFIXES):
        rows = np.concatenate([carried, np.arange(i, min(i + SUFFIXES, len(doc)))])
        own = windows(rows)
        hit[rows] |= longest_previous_factor(own, doc[rows]) == MIN
        on = np.flatnonzero((h[rows] == h[rows[-1]]) & ~hit[rows])
        carried = rows[on[np.unique(own[on], axis=0, return_index=True)[1]]]  # the first of each has the smallest document
    return hit


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Covered spans of a bucket's contexts. Beside the texts a window takes 9 bytes here; what is sorted is bounded."""
    heads, texts = [], []
    for n, blob in zip(pdf["n"], pdf["blob"], strict=True):
        raw = zstandard.decompress(bytes(blob))
        heads.append(np.frombuffer(raw, "<i8", 3 * n).reshape(3, n))
        texts.append(raw[24 * n :])
    doc, start, size = np.concatenate(heads, axis=1)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    del heads, texts
    first = np.cumsum(size) - size
    per = size - MIN + 1
    ends = np.cumsum(per)
    begins = ends - per
    h = _hashes(buf, first, per)
    hit = np.zeros(len(h), bool)
    views = np.lib.stride_tricks.sliding_window_view(buf, MIN)
    for rows in _groups(h):  # equal windows have equal hashes
        of = np.searchsorted(ends, rows, side="right")
        order = np.lexsort((doc[of], h[rows]))
        rows, of = rows[order], of[order]
        same = h[rows][1:] == h[rows][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        rows, of = rows[twice], of[twice]  # the others have no match at all
        at = rows - begins[of] + first[of]
        hit[rows] = _covered_windows(lambda x: views[at[x]], doc[of], h[rows])  # noqa: B023
    opens, closes = np.zeros(len(h), bool), np.zeros(len(h), bool)
    opens[begins] = closes[ends - 1] = True
    opens[1:] |= ~hit[:-1]
    closes[:-1] |= ~hit[1:]
    a, z = np.flatnonzero(hit & opens), np.flatnonzero(hit & closes)
    c = np.searchsorted(ends, a, side="right")
    made = pd.DataFrame({"d": doc[c], "span": (start[c] + a - begins[c]) << 8 | (z - a + MIN)})
    return made.drop_duplicates()


def _groups(h: np.ndarray, size: int = 1_000_000) -> Iterator[np.ndarray]:
    parts = max(1, len(h) // size)
    which = (h >> np.uint64(7)) % np.uint64(parts)
    for i in range(parts):
        rows = np.flatnonzero(which == i)
        if len(rows):
            yield rows


SUMMARY = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _apply(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for t, s in zip(texts, spans, strict=True):
        b = (t or "").encode("utf-8", "surrogatepass")
        if s is None or not len(s):
            out.append((len(b), 0, 0, hashlib.sha256(b).hexdigest(), b))
            continue
        s = np.unique(np.asarray(s))
        a, z = s >> 8, np.minimum((s >> 8) + (s & 255), len(b))
        reach = np.maximum.accumulate(z)
        heads = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
        lows, highs = a[heads].tolist(), reach[np.concatenate([heads[1:] - 1, [len(a) - 1]])].tolist()
        kept = b"".join(b[x:y] for x, y in zip([0, *highs], [*lows, len(b)], strict=True))
        out.append((len(b), len(b) - len(kept), len(lows), hashlib.sha256(kept).hexdigest(), kept))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SUMMARY.split(", ")])


def covered(docs: DataFrame) -> DataFrame:
    """Covered spans (d, span) of docs (d long, x string, both not null); span is start * 256 + length."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length("x")).alias("n")).first()["n"] or 0
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET))
    packed = docs.mapInPandas(_pack_anchors(buckets), "bucket int, known boolean, blob binary")
    settled = cut(packed.groupBy("bucket").applyInPandas(_settle, "d long, span long, sides int"), "anchors")
    asked = settled.where("sides > 0").groupBy("d").agg(F.collect_list(F.shiftleft("span", 8).bitwiseOR(F.col("sides").cast("long"))).alias("spans"))
    fetched = docs.join(asked, "d").select("d", "x", "spans")
    compared = fetched.mapInPandas(_fetch(buckets), "bucket int, n int, blob binary").groupBy("bucket").applyInPandas(_compare, "d long, span long")
    whole = F.shiftleft(F.shiftright("span", 16), 8).bitwiseOR(F.col("span").bitwiseAND(F.lit(255)))
    return settled.where("sides = 0").select("d", whole.alias("span")).union(compared)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept): each text's bytes without those that smaller documents have.

    Bytes are those of the UTF-8 text (null: empty); matches lie within a document, and are judged on the input. A row
    with a null key loses nothing and takes nothing from others. Rows that repeat a key are no earlier than each other;
    where their texts differ, each loses what is found for any of them, in its own bounds. Other columns are not read.
    """
    rows = df.select(F.col(key).cast("long").alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))
    named = rows.where("d is not null")
    spans = covered(named).groupBy("d").agg(F.collect_list("span").alias("spans"))
    whole = F.pandas_udf(_apply, SUMMARY)
    done = named.join(spans, "d", "left").select("d", whole("x", "spans").alias("r"))
    alone = rows.where("d is null").select("d", whole("x", F.array().cast("array<long>")).alias("r"))
    return done.union(alone).select(F.col("d").alias(key), "r.*")
