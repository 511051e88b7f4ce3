import math
import zlib

from pyspark.sql import functions as F

from mintscope.llm import langid
from mintscope.llm.queries import op10_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    out = [r.lang == r.lang_pred for r in got if r.held_out]
    assert sum(out) > 0.98 * len(out)


def test_no_label_reaches_a_prediction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(langid.identify(docs).collect()) == sorted(langid.identify(other).collect())


def test_edge_rows(spark):
    en, fr = "the cat and the house of the thing with the ", "le chat et la maison de la chose avec les "
    rows = [(i, (en if i % 2 else fr) * 3 + str(i), "en" if i % 2 else "fr", "x") for i in range(40)]
    rows += [(100, None, "en", "x"), (101, "", "en", "x"), (102, "123 ??", "en", "x"), (103, en * 20000, None, "x"), (104, "½ ² 12", "en", "x"), (105, "Ⅷ ① _", "fr", "x"), (106, "ª", None, "x"), (None, fr, "fr", None), (1, rows[1][1], "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = langid.identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102, 104, 105)) and by[106].lang_pred != "und"
    assert by[103].lang_pred == "en" and by[None].lang_pred == "fr" and by[None].held_out is False
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 5
    assert langid.identify(df.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(df.where("lang = 'en'")).collect()} == {"en", "und"}


def plain_vote(shares, duels):
    wins, margins, sure = {}, {}, {}
    for a, b, w in duels:
        m = sum(v * w[i] for i, v in shares.items()) + w[-1]
        for name, v in ((a, m), (b, -m)):
            wins[name] = wins.get(name, 0) + (v > 0)
            margins[name] = margins.get(name, 0) + v
            sure.setdefault(name, []).append(1 / (1 + math.exp(-max(-60, min(60, 4 * v)))))
    best = sorted(wins, key=lambda n: (-wins[n], -margins[n], n))[0]
    return best, sum(sure[best]) / len(sure[best])


def test_predictions_against_brute_force(spark):
    """Trigrams counted one by one, and every duel of a text fought in plain Python with the fitted weights."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    tried = 0
    for r in docs.collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id] == ("und", 0)
            continue
        raw = f" {r.text.lower()} ".encode()
        counts = {}
        for i in range(len(raw) - 2):
            h = int.from_bytes(raw[i : i + 3], "big") * 2654435761 % 2**32 >> 20
            counts[h] = counts.get(h, 0) + 1
        length = math.sqrt(sum(counts.values()))
        shares = {h: math.sqrt(n) / length for h, n in counts.items()}
        family, p = plain_vote(shares, [d for d in model[""] if d[1]])
        own = [d for d in model[family] if d[1]]
        lang, q = plain_vote(shares, own) if own else (model[family][0][0], 1.0)
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - p * q) < 1e-6
        tried += 1
    assert tried > 150
