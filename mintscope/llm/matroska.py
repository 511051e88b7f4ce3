"""Matroska columns: EBML elements, clusters, lacing and cues parsed into packet tables.

`parse` reads one file's bytes; `packets`, `tracks` and `cues` give tables with one row per packet, track or cue point;
`mux` stores bytes as 8-bit PCM samples in a Matroska file, which the packets' byte ranges give back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

# Element ids of the Matroska specification (RFC 9559).
EBML, SEGMENT, CLUSTER, TIMESTAMP = 0x1A45DFA3, 0x18538067, 0x1F43B675, 0xE7
INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

FRAME = 192  # bytes, and samples, of a frame that mux writes: 24 ms at 8 kHz
LACED = 16  # frames in a block
CLUSTERED = 64  # blocks in a cluster

PACKET = "track long, time_ns long, offset long, size long, keyframe boolean, lacing string, cluster_offset long, block_offset long, frame int"


@dataclass
class File:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    error: str | None = None


def _vint(b: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """A variable-length integer at `at`: its value, its length, whether it is the reserved "unknown size"."""
    first = b[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(b):
        raise ValueError(f"bad variable-length integer at {at}")
    raw = int.from_bytes(b[at : at + n], "big")
    value = raw & ((1 << 7 * n) - 1)
    return (raw if keep else value), n, value == (1 << 7 * n) - 1


def _children(b: bytes, at: int, end: int, closing: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, data start, data end). An element of unknown size ends with its parent, or before an id in `closing`."""
    while at < end:
        ident, n, _ = _vint(b, at, keep=True)
        if ident in closing:
            return
        size, m, unknown = _vint(b, at + n)
        data = at + n + m
        if unknown and ident == CLUSTER:
            stop = data
            for _, _, _, stop in _children(b, data, end, _TOP):  # noqa: B007
                pass
        else:
            stop = end if unknown else data + size
        if stop > end:
            raise ValueError(f"element {ident:x} at {at} runs past its parent")
        yield ident, at, data, stop
        at = stop


_TOP = frozenset({CLUSTER, INFO, TRACKS, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367})


def _frames(b: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block's data."""
    if not lacing:
        return [(at, end - at)]
    n = b[at] + 1
    at += 1
    if lacing == 2:  # equal sizes
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError(f"fixed lacing doesn't divide the block at {at}")
        return [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:  # sums of bytes up to one below 255
            size = 0
            while b[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + b[at], at + 1
        else:  # the first size, then signed differences
            value, m, _ = _vint(b, at)
            size, at = value if not i else sizes[-1] + value - ((1 << 7 * m - 1) - 1), at + m
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError(f"lacing runs past the block at {at}")
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes, strict=True))


_NAMES = ("none", "xiph", "fixed", "ebml")


def parse(b: bytes | None, payload: bool = True) -> File:
    """Tracks, packets and cue points of one file. What can't be read ends the file there, and `error` says why."""
    out = File()
    number = lambda a, z: int.from_bytes(b[a:z], "big")
    try:
        for top, _, data, end in _children(b or b"", 0, len(b or b"")):
            if top != SEGMENT:
                continue
            for ident, start, a, z in _children(b, data, end):
                if ident == INFO:
                    for k, _, p, q in _children(b, a, z):
                        if k == TIMESTAMP_SCALE:
                            out.scale = number(p, q)
                elif ident == TRACKS:
                    for k, _, p, q in _children(b, a, z):
                        if k == TRACK_ENTRY:
                            _track(b, p, q, out)
                elif ident == CUES:
                    for k, _, p, q in _children(b, a, z):
                        if k == CUE_POINT:
                            _cue(b, p, q, data, out)
                elif ident == CLUSTER:
                    out.clusters += 1
                    if payload:
                        _cluster(b, start, a, z, out)
    except (ValueError, IndexError) as e:
        out.error = str(e) or "truncated"
    return out


def _track(b: bytes, p: int, q: int, out: File) -> None:
    t = {"track": 0, "type": 0, "codec": None, "rate": None, "channels": None, "bits": None, "frame_ns": 0}
    for k, _, a, z in _children(b, p, q):
        if k == TRACK_NUMBER:
            t["track"] = int.from_bytes(b[a:z], "big")
        elif k == TRACK_TYPE:
            t["type"] = int.from_bytes(b[a:z], "big")
        elif k == DEFAULT_DURATION:
            t["frame_ns"] = int.from_bytes(b[a:z], "big")
        elif k == CODEC_ID:
            t["codec"] = bytes(b[a:z]).rstrip(b"\0").decode("ascii", "replace")
        elif k == AUDIO:
            for c, _, x, y in _children(b, a, z):
                if c == SAMPLING:
                    t["rate"] = float(np.frombuffer(bytes(b[x:y]), ">f8" if y - x == 8 else ">f4")[0])
                elif c in (CHANNELS, BIT_DEPTH):
                    t["channels" if c == CHANNELS else "bits"] = int.from_bytes(b[x:y], "big")
    out.tracks[t["track"]] = t


def _cue(b: bytes, p: int, q: int, segment: int, out: File) -> None:
    time, spots = 0, []
    for k, _, a, z in _children(b, p, q):
        if k == CUE_TIME:
            time = int.from_bytes(b[a:z], "big")
        elif k == CUE_POSITIONS:
            own = {c: int.from_bytes(b[x:y], "big") for c, _, x, y in _children(b, a, z)}
            spots.append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER, 0) + segment))
    out.cues += [(time * out.scale, track, at) for track, at in spots]


def _cluster(b: bytes, start: int, a: int, z: int, out: File) -> None:
    base = 0
    for ident, _, p, q in _children(b, a, z):
        if ident == TIMESTAMP:
            base = int.from_bytes(b[p:q], "big")
        elif ident == SIMPLE_BLOCK:
            _block(b, p, q, base, start, None, out)
        elif ident == BLOCK_GROUP:
            parts = {k: (x, y) for k, _, x, y in _children(b, p, q)}
            if BLOCK in parts:
                _block(b, *parts[BLOCK], base, start, REFERENCE_BLOCK not in parts, out)


def _block(b: bytes, p: int, q: int, base: int, cluster: int, key: bool | None, out: File) -> None:
    track, n, _ = _vint(b, p)
    time = int.from_bytes(b[p + n : p + n + 2], "big", signed=True) + base
    flags = b[p + n + 2]
    lacing = flags >> 1 & 3
    key = bool(flags & 0x80) if key is None else key
    step = out.tracks.get(track, {}).get("frame_ns", 0)
    at = time * out.scale
    name = _NAMES[lacing]
    out.packets += [(track, at + i * step, o, s, key, name, cluster, p, i) for i, (o, s) in enumerate(_frames(b, p + n + 3, q, lacing))]


def _size(n: int, width: int = 8) -> bytes:
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, data: bytes) -> bytes:
    width = next(w for w in range(1, 9) if len(data) < (1 << 7 * w) - 1)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(data), width) + data


def _uint(ident: int, v: int) -> bytes:
    return _element(ident, v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big"))


_HEAD = _element(EBML, b"".join([_uint(0x4286, 1), _uint(0x42F7, 1), _uint(0x42F2, 4), _uint(0x42F3, 8), _element(0x4282, b"matroska"), _uint(0x4287, 4), _uint(0x4285, 2)]))
_INFO = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"packet table") + _element(WRITING_APP, b"packet table"))
_AUDIO = _element(AUDIO, _element(SAMPLING, np.array(8000, ">f8").tobytes()) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
_TRACK = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, 24_000_000) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _AUDIO
_FRONT = _INFO + _element(TRACKS, _element(TRACK_ENTRY, _TRACK))


def mux(payload: bytes) -> bytes:
    """A Matroska file whose one track holds payload, a multiple of 192 bytes, as 8-bit samples in laced blocks."""
    body, cues, at = [_FRONT], [], len(_FRONT)
    for c in range(0, len(payload), FRAME * LACED * CLUSTERED):
        ms = c // 8
        parts = [_uint(TIMESTAMP, ms)]
        for o in range(c, min(len(payload), c + FRAME * LACED * CLUSTERED), FRAME * LACED):
            data = payload[o : o + FRAME * LACED]
            n = len(data) // FRAME
            head = b"\x81" + ((o - c) // 8).to_bytes(2, "big")
            parts.append(_element(SIMPLE_BLOCK, head + (b"\x80" if n == 1 else b"\x84" + bytes([n - 1])) + data))
        cluster = _element(CLUSTER, b"".join(parts))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, ms) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEAD + _element(SEGMENT, b"".join([*body, _element(CUES, b"".join(cues))]))


@F.pandas_udf(T.BinaryType())
def muxed(payload: pd.Series) -> pd.Series:
    return payload.map(lambda p: None if p is None else mux(bytes(p)))


def _rows(df: DataFrame, key: str, media: str, schema: str, of) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for k, m in zip(pdf["k"], pdf["m"], strict=True):
                if m is not None and (rows := of(parse(bytes(m)))):
                    out = pd.DataFrame(rows, columns=names)
                    out.insert(0, "k", pd.Series([k] * len(out), dtype=pdf["k"].dtype))
                    yield out

    source = df.select(F.col(key).alias("k"), F.col(media).alias("m"))
    kind = df.schema[key].dataType.simpleString()
    return source.mapInPandas(run, f"k {kind}, {schema}").withColumnRenamed("k", key)


def packets(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per packet: track, time_ns, byte range (offset, size), keyframe, lacing, cluster_offset, block_offset, frame.

    A null or empty file has no rows; a damaged one has those before the damage.
    """
    return _rows(df, key, media, PACKET, lambda f: f.packets)


def tracks(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per track."""
    schema = "track long, type long, codec string, rate double, channels long, bits long, frame_ns long"
    return _rows(df, key, media, schema, lambda f: [tuple(t.values()) for t in f.tracks.values()])


def cues(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per cue: time_ns, track, cluster_offset."""
    return _rows(df, key, media, "time_ns long, track long, cluster_offset long", lambda f: f.cues)


_COUNTS, _TEXTS = ("payload_bytes", "tail_crc32", "media_bytes", "packets"), ("payload_sha256", "media_sha256", "feature", "error")
DIGEST = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS] + [T.StructField(c, T.StringType()) for c in _TEXTS])


@F.pandas_udf(DIGEST)
def digest(media: pd.Series) -> pd.DataFrame:
    """What the packets of a file hold: size and hashes of the bytes they range over, and features of the samples."""
    out = []
    for m in media:
        if m is None:
            out.append((None,) * 8)
            continue
        m = bytes(m)
        f = parse(m)
        view = memoryview(m)
        payload = b"".join([view[o : o + s] for _, _, o, s, *_ in f.packets])
        x = np.frombuffer(payload, np.uint8)
        at = {c for _, _, c in f.cues}
        cued = sum(c in at for c in {p[6] for p in f.packets})
        t = next(iter(f.tracks.values()), {})
        rms = mean = crossings = 0.0
        if len(x):
            mean = float(x.mean(dtype=np.float64))
            rms = float(np.sqrt(np.mean(np.square(x.astype(np.float32) - np.float32(mean)), dtype=np.float64)))
            above = x > mean
            crossings = float(np.count_nonzero(above[1:] != above[:-1])) / len(x)
        end = max((p[1] for p in f.packets), default=0) + t.get("frame_ns", 0)
        feature = f"{t.get('codec')} {t.get('rate') or 0:.0f}Hz {t.get('channels')}ch {t.get('bits')}bit packets={len(f.packets)} clusters={f.clusters} cued={cued} ms={end // 1_000_000} mean={mean:.3f} rms={rms:.3f} crossings={crossings:.5f}"
        out.append((len(payload), zlib.crc32(payload[-16:]), len(m), len(f.packets), hashlib.sha256(payload).hexdigest(), hashlib.sha256(m).hexdigest(), feature, f.error))
    return pd.DataFrame(out, columns=[*_COUNTS, *_TEXTS]).astype(dict.fromkeys(_COUNTS, "Int64"))


def payload_of(text) -> F.Column:
    """A text column as UTF-8, blanks appended up to a positive multiple of 192 bytes; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.octet_length(t)
    short = F.greatest(F.lit(1), F.ceil(n / F.lit(FRAME))) * FRAME - n
    return F.concat(t, F.repeat(F.lit(" "), short.cast("int"))).cast("binary")


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every text as a Matroska file. Repeated rows and null keys give rows of their own."""
    bounded_batches(df.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(key), F.octet_length(t).cast("long").alias("n_bytes"), muxed(payload_of(F.col(text))).alias("media"))
