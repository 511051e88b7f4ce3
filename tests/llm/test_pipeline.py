import re

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from .test_jaccard import brute as similar_brute
from .test_linededup import brute as lines_brute
from .test_packing import check

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = dict(corpus_pipeline.STAGES)
    first = {r.doc_id: r.text for r in docs.collect()}
    a = corpus_pipeline.cut(step["language_id"](spark, docs, SF), "a")
    one = {r.doc_id: r.text for r in a.collect()}
    assert a.columns == docs.columns and one == {d: t for d, t in first.items() if t and any(c.isalpha() for c in t)}
    b = corpus_pipeline.cut(step["line_dedup"](spark, a, SF), "b")
    two = {r.doc_id: r.text for r in b.collect()}
    clean = lines_brute(list(one.items()))
    assert b.columns == docs.columns and two == {d: t for d, t in clean.items() if t == one[d] or re.search(r"[^\W_]", t)}
    c = corpus_pipeline.cut(step["simhash_near_dedup"](spark, b, SF), "c")
    three = {r.doc_id: r.text for r in c.collect()}
    group = similar_brute(two)
    assert c.columns == docs.columns and three == {d: t for d, t in two.items() if group[d] == d}
    e = corpus_pipeline.cut(step["mix_to_weights"](spark, c, SF), "d")
    rows = [(r.doc_id, r.text) for r in e.collect()]
    assert e.columns == docs.columns and all(three[d] == t for d, t in rows)
    marks = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d in three if marks.get(d) == (1, 0)]
    assert sum(d in dict(rows) for d in good) >= 0.97 * len(good)
    last = step["best_fit_packing"](spark, e, SF).collect()
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in last) == sum(len(full.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    once = {d for d, _ in rows if [x for x, _ in rows].count(d) == 1}
    check([(d, t) for d, t in rows if d in once], last)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
