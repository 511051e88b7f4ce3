import hashlib
import random
import re
from math import log

from pyspark.sql import functions as F

from mintscope.llm import secrets
from mintscope.llm.queries import op8_secret_scans, planted_findings_of, repeated_findings_of

SF = "/root/testdata/sf0.01"


def test_planted_tokens_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {(r.doc_id, hashlib.sha256(x.encode()).hexdigest()) for r in docs for x in re.findall(r'token = "([0-9a-f]{40})"', r.text)}
    rows = op8_secret_scans(spark, SF).collect()
    got = {(r.doc_id, r.finding_sha256) for r in rows if r.is_secret}
    assert want and want <= got and len(got - want) <= 0.1 * len(want) and len(rows) > len(got)


def test_the_forest_tells_apart_what_a_name_and_an_assignment_do_not(spark):
    """Trained on planted findings in two thirds of the documents, tried on the others' own: names stand before harmless
    strings and secrets without a name, so that no rule of one feature is right."""
    rng = random.Random(8)
    value = lambda n, chars="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choice(chars) for _ in range(n))
    real = [lambda: ("token = ", value(40, "0123456789abcdef"), ""), lambda: ("api_key=", value(24), ""), lambda: ("uses AKIA", value(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), " there"), lambda: ("secret = '", value(24), "'"), lambda: ("see ", value(40, "0123456789abcdef"), "")]
    fake = [lambda: ("key = ", value(5, "123456789"), ""), lambda: ("commit ", value(40, "0123456789abcdef"), " of"), lambda: ("password: ", value(5, "123456789"), ""), lambda: ("mail name", value(3, "0123456789"), "@site.org now"), lambda: ("token = example", value(1, "0123456789"), "")]
    plain = "the file and the house of the site have a name that the page and the main call there see it now "
    rows, want, rule = [], {}, {}
    for i in range(900):
        before, made, after = (real if i % 2 else fake)[i // 2 % 5]()
        rows.append((i, plain * 2 + before + made + after + " " + plain))
        want[i] = bool(i % 2)
        rule[i] = before.startswith(("token", "api_key", "secret", "key", "password"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = df.where("doc_id % 3 <> 0").select("doc_id")
    got = {}
    for r in secrets.scan(df, lambda c: repeated_findings_of(c, marks), examples=planted_findings_of(df, marks)).collect():
        got[r.doc_id] = got.get(r.doc_id, False) or r.is_secret
    tried = range(0, 900, 3)
    right = sum(got.get(i, False) == want[i] for i in tried)
    assert right >= 0.93 * len(tried) and sum(rule[i] == want[i] for i in tried) < 0.7 * len(tried)
    assert sum(got.get(i, False) != rule[i] for i in tried) >= 0.3 * len(tried)


def test_scores_are_the_mean_of_the_trees(spark):
    """Each tree is walked by hand from its nodes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    words = secrets.word_counts(docs)
    table = secrets.transitions(words)
    examples = planted_findings_of(docs, labels).select(F.struct("finding", "label").alias("about"), "text")
    rows = secrets.with_features(secrets.candidates(examples, "about"), words, table, "about").withColumn("label", F.col("about.label")).cache()
    model = secrets.train(rows)
    given = rows.limit(200)
    got = {(tuple(r[c] for c in secrets.FEATURES)): r.score for r in secrets.score(given, model, secrets.FEATURES).collect()}

    def walk(node, x):
        while node.numDescendants() > 0:
            split = node.split()
            low = x[split.featureIndex()] <= split.threshold()
            node = node.leftChild() if low else node.rightChild()
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats)

    trees = [t._java_obj.rootNode() for t in model.trees]
    assert got and len(trees) == secrets.TREES
    for x, score in list(got.items())[:60]:
        assert abs(sum(walk(t, x) for t in trees) / len(trees) - score) < 1e-9
    rows.unpersist()


def plain_candidates(text):
    out = []
    words = re.split(r"\s+", text)
    mixed = r"[0-9]|[a-zà-öø-ÿß][A-ZÀ-ÖØ-Þ]"
    for i, w in enumerate(words):
        before, before2 = words[i - 1] if i else "", words[i - 2] if i > 1 else ""
        own = re.match(secrets._OWN_NAME, w)
        about = re.sub("[^A-Za-z0-9_ ]", "", f"{before2} {before} {own[1] if own else ''}".lower()).split(" ")
        told = set(about) & set(secrets.NAMES) and (before in ("=", ":", "=>", ":=") or own or re.search("[=:]$", before))
        if not re.search(mixed, w) and not told:
            continue
        for f in dict.fromkeys(re.findall(secrets._RUN, w)):
            if (re.search(mixed, f) or told and re.search(r"\w", f)) and not re.fullmatch(r"[^\W\d]*[\w.-]*[=:]+", f):
                out.append((i, f, before, before2, words[i + 1] if i + 1 < len(words) else ""))
    return out


def test_candidates_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r["at"], r.finding, r.before, r.before2, r.after) for r in secrets.candidates(spark.createDataFrame(rows)).collect())
    assert got == sorted((r.doc_id, *c) for r in rows for c in plain_candidates(r.text))


def test_short_and_foreign_candidates(spark):
    rows = ['password = "a1b2c3d"', "pwd: 1234567", 'token="pässwört1234"', 'key = "p@ss(w0rd)x9"', "password: hunter now", '{"key":"Value12"},', "(AbC1) x", "nothing here: the end", "secret=geheim"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted((r.doc_id, r.finding) for r in secrets.candidates(df).collect())
    assert got == [(0, "a1b2c3d"), (1, "1234567"), (2, "pässwört1234"), (3, "p@ss(w0rd)x9"), (4, "hunter"), (5, "Value12"), (6, "AbC1"), (8, "geheim")]


def test_features(spark):
    df = spark.createDataFrame([(1, 'hello hello hello hello hello token = "Hello12345678901234"', )], "doc_id long, text string")
    words = secrets.word_counts(df)
    table = secrets.transitions(words)
    r = secrets.with_features(secrets.candidates(df), words, table).first()
    assert (r.length, r.assigned, r.quoted, r.named, r.path, r.address) == (19, 1, 1, 1, 0, 0)
    assert abs(r.coverage - 5 / 19) < 1e-9 and abs(r.digits - 14 / 19) < 1e-9
    plain = "*" + re.sub("[0-9]", "0", r.finding.lower())
    assert abs(r.transition - sum(table[a + b] for a, b in zip(plain, plain[1:])) / 19) < 1e-9
    assert abs(table["he"] - log((6 + 0.5) / (6 + 0.5 * len(secrets._CLASSES)))) < 1e-9


def test_edge_rows(spark):
    rng = random.Random(4)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'some words token = "{secret()}" and more', "z") for i in range(20)] + [(i, f"see path/to/some/file{i}/index.html or 12345678901234567", "z") for i in range(20, 40)]
    rows += [(100, None, "z"), (101, "", None), (102, "see path/to " + "word/" * 4_000 + "1", "z"), (None, f'key = "{secret()}"', "z"), (1, rows[1][1], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, raw string").withColumn("score", F.lit(1))
    labels = secrets.candidates(df).where("doc_id < 40 and doc_id % 2 = 0").select("doc_id", "at", "finding", (F.col("doc_id") < 20).cast("int").alias("label"))
    got = secrets.scan(df, labels).collect()
    assert {r.doc_id for r in got if r.is_secret} == {*range(20), None}
    assert len([r for r in got if r.doc_id == 1]) == 2 and len([r for r in got if r.doc_id == 102]) == 1
    assert secrets.scan(df.where("false"), labels).count() == 0
    assert all(r.is_secret for r in secrets.scan(df, labels.where("false")).collect())
