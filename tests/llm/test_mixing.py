import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mintscope.llm import mixing
from mintscope.llm.queries import SHARES, op6_mixing_weights

SF = "/root/testdata/sf0.01"


def solve(p, t, targets, steps=20000):
    """The same least squares by plain projected gradient along the posteriors."""
    r = np.ones(len(t))
    top = np.linalg.eigvalsh((p * t[:, None]).T @ p / t.sum()).max()
    for _ in range(steps):
        r = np.maximum(0, r - p @ ((p.T @ (r * t) - targets) / t.sum()) / top)
    return r


def test_whole_table_against_brute_force(spark):
    rows = op6_mixing_weights(spark, SF).collect()
    assert len(rows) == 1000
    p = np.array([[r.p_good, r.p_poor, r.p_toxic] for r in rows])
    t = np.array([r.tokens for r in rows])
    rate = np.array([r.rate for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    targets = p.T @ t * [SHARES[c] for c in ("good", "poor", "toxic")]
    loss = lambda r: np.square((p.T @ (r * t) - targets) / t.sum()).sum()
    assert loss(rate) <= loss(solve(p, t, targets)) + 1e-4
    marks = {r.doc_id: r.domain for r in mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    own = {d: [r.rate for r in rows if marks.get(r.doc_id) == d] for d in ("good", "poor", "toxic")}
    assert np.mean(own["good"]) > 0.97 > 0.6 > np.mean(own["poor"]) and np.mean(own["toxic"]) < 0.4


@pytest.mark.parametrize("target", [(1.0, 1.0), (2.0, 0.5), (0.0, 3.0)])
def test_targets_are_met_where_they_can_be(spark, target):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.2, 0.2], 500)
    t = rng.integers(1, 1000, 500).astype(float)
    df = spark.createDataFrame([(i, float(a), [float(x) for x in v]) for i, (a, v) in enumerate(zip(t, p))], "doc_id long, tokens double, posterior array<double>")
    want = p.T @ t * target
    got = {r.doc_id: r.rate for r in mixing.rates(df, list(want)).collect()}
    r = np.array([got[i] for i in range(500)])
    loss = lambda r: np.square((p.T @ (r * t) - want) / t.sum()).sum()
    assert (r >= 0).all() and loss(r) <= loss(solve(p, t, want)) + 1e-4


def test_edge_rows(spark):
    docs = [(i, "fine words here and more fine words" if i % 2 else "### bad *** bad ###", "s") for i in range(60)] + [(100, None, "s"), (101, "", None), (102, "fine words " * 40_000, "s"), (None, "fine words", "s"), (1, "fine words here and more fine words", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, h string").withColumn("rate", F.lit(0))
    labels = spark.createDataFrame([(i, "good" if i % 2 else "poor") for i in range(40)] + [(None, "good"), (3, None), (5, "good")], "doc_id long, domain string")
    got, names = mixing.mix(df, labels, {"poor": 0.0})
    rows = got.collect()
    assert names == ["good", "poor"] and len(rows) == len(docs) and all(r.rate >= 0 for r in rows)
    kept = mixing.resample(df, labels, {"poor": 0.0})
    left = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and sum(d is not None and d < 60 and d % 2 == 0 for d in left) <= 2 and {d for d in range(60) if d % 2} <= set(left)
    assert left.count(1) >= 2 and mixing.resample(df.where("false"), labels, {}).count() == 0
    assert sorted(mixing.resample(df, labels.where("false"), {"poor": 0.0}).select("doc_id", "text").collect(), key=str) == sorted(df.select("doc_id", "text").collect(), key=str)


def test_labelled_toxic_documents_leave_the_mix(spark):
    sf = "/root/testdata/sf0.1"
    marks = mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    mean = {r.domain: r.rate for r in op6_mixing_weights(spark, sf).join(marks, "doc_id").groupBy("domain").agg(F.avg("rate").alias("rate")).collect()}
    assert mean["toxic"] < 0.05 and mean["poor"] < 0.35 and mean["good"] > 0.97


def plain_marks(text):
    """A text's marks, read off the definition."""
    text = text or ""
    words = re.split(r"[ \t\n\x0b\f\r!-/:-@\[-`{-~0-9]+", text.lower())
    marks = set(words) | set(re.findall(r"[!#$%&*+/<=>?@\[\\\]^_`{|}~]+", text))
    if sum(c in CAPITALS for c in text) * 10 > len(text) * 3:
        marks.add("<capitals>")
    if len(words) >= 10 and len(set(words)) * 4 < len(words):
        marks.add("<repeats>")
    return marks - {""}


CAPITALS = {chr(c) for c in [*range(65, 91), *range(0xC0, 0xDF)]}


def test_posteriors_against_brute_force(spark):
    """Naive Bayes over the telling marks, counted and multiplied out in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: r.domain for r in mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.domain}
    marks = {r.doc_id: plain_marks(r.text) for r in docs}
    known = [d for d in marks if d in labels]
    names = sorted({labels[d] for d in known})
    size = {c: sum(labels[d] == c for d in known) for c in names}
    total = len(known)
    table = {}
    for m in {m for d in known for m in marks[d]}:
        here = {c: sum(m in marks[d] for d in known if labels[d] == c) for c in names}
        n = sum(here.values())
        for c in names:
            share = size[c] / total
            off = (here[c] - n * share) / (n * share * (1 - share) + 0.25) ** 0.5
            lift = (here[c] + 0.5) / (size[c] + 1) * (total - size[c] + 1) / (n - here[c] + 0.5)
            if off >= mixing.TELL and lift >= mixing.LIFT:
                table[m] = [(here[x] + 0.5) / (size[x] + 1) for x in names]
    assert len(table) > 5
    got = {r.doc_id: [r[f"p_{c}"] for c in names] for r in op6_mixing_weights(spark, SF).collect()}
    for d, own in marks.items():
        logs = np.array([np.log(size[c] / total) + sum(np.log(v[i] if m in own else 1 - v[i]) for m, v in table.items()) for i, c in enumerate(names)])
        p = np.exp(logs - logs.max())
        assert np.allclose(got[d], p / p.sum(), atol=1e-9)
