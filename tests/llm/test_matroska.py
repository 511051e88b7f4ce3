import hashlib
import random
import zlib

from pyspark.sql import functions as F

from mintscope.llm import matroska as mk
from mintscope.llm.queries import op1_media_columns


def test_round_trip_and_cues():
    rng = random.Random(1)
    for n in (1, 2, 16, 17, 1024, 1500, 5000):
        payload = rng.randbytes(192 * n)
        b = mk.mux(payload)
        f = mk.parse(b)
        assert f.error is None and b"".join(b[p[2] : p[2] + p[3]] for p in f.packets) == payload
        assert len(f.packets) == n and [p[1] for p in f.packets] == [i * 24_000_000 for i in range(n)]
        assert {c[2] for c in f.cues} == {p[6] for p in f.packets} and f.tracks[1]["codec"] == "A_PCM/INT/LIT"
        assert all(b[c[2] : c[2] + 4] == mk.CLUSTER.to_bytes(4, "big") for c in f.cues)


def block(lacing, frames, group=False, time=5):
    n = bytes([len(frames) - 1])
    if lacing == 0:
        laced = b""
    elif lacing == 1:
        laced = n + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == 2:
        laced = n
    else:
        laced = n + mk._size(len(frames[0]), 2)
        for a, z in zip(frames, frames[1:-1]):
            laced += mk._size(len(z) - len(a) + (1 << 13) - 1, 2)
    data = b"\x81" + time.to_bytes(2, "big", signed=True) + bytes([lacing << 1 | (0 if group else 0x80)]) + laced + b"".join(frames)
    return mk._element(mk.BLOCK_GROUP, mk._element(mk.BLOCK, data) + mk._uint(mk.REFERENCE_BLOCK, 1)) if group else mk._element(mk.SIMPLE_BLOCK, data)


def test_every_lacing_and_unknown_sizes():
    rng = random.Random(2)
    want, blocks = [], []
    for lacing in (0, 1, 2, 3):
        for group in (False, True):
            sizes = [7] if lacing == 0 else [40] * 4 if lacing == 2 else [300, 255, 0, 1000, 12]
            frames = [rng.randbytes(s) for s in sizes]
            blocks.append(block(lacing, frames, group, -3))
            want += [(f, not group, mk._NAMES[lacing]) for f in frames]
    cluster = mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + mk._uint(mk.TIMESTAMP, 10) + b"".join(blocks)
    b = mk._HEAD + mk.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + mk._FRONT + cluster + cluster
    f = mk.parse(b)
    assert f.error is None and f.clusters == 2
    assert [(b[p[2] : p[2] + p[3]], p[4], p[5]) for p in f.packets] == want * 2
    assert f.packets[0][1] == 7_000_000
    for cut in range(0, len(b), 97):
        mk.parse(b[:cut])


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_media_columns(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        media = mk.mux(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 96), (4, "x" * 500_000), (4, "x" * 500_000), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1))
    media = mk.text_media(df)
    got = {r.doc_id: r.n for r in mk.packets(media, "doc_id", "media").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2 * 2605, None: 1}
    assert mk.tracks(media, "doc_id", "media").count() == 6 and mk.cues(media, "doc_id", "media").where("doc_id = 3").count() == 1
    broken = spark.createDataFrame([(1, None), (2, b""), (3, b"junk"), (4, mk.mux(b" " * 384)[:-5])], "doc_id long, media binary")
    assert mk.packets(broken, "doc_id", "media").count() == 0
    assert [r.d.error is None for r in broken.select(mk.digest("media").alias("d"), "doc_id").orderBy("doc_id").collect()] == [True, True, False, False]
    assert mk.packets(media.where("false"), "doc_id", "media").count() == 0
