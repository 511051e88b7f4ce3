"""Secret scans with a random forest against false positives, in DataFrame functions only.

Candidates are what quotes and white space leave whole. Their features: length, how usual their character transitions are in
the corpus's own words, how much of them is covered by dictionary words (of the same corpus), whether they look like a
path or address, and the words around them. A random forest trained on labelled findings scores them; the labels may be of
findings in the texts themselves or in examples beside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: How often a word must come in the corpus to count as a dictionary word.
DICTIONARY = 5
#: Bound on the labelled findings that the forest is trained on.
LABELLED = 20_000
TREES, DEPTH = 20, 6
FEATURES = ["length", "digits", "upper", "hexadecimal", "distinct", "transition", "coverage", "path", "address", "assigned", "quoted", "named", "after", "harmless"]

# Words that announce a secret.
NAMES = ["api_key", "apikey", "auth", "authorization", "bearer", "credential", "key", "passwd", "password", "private_key", "pwd", "secret", "token"]
# Words that announce a digest, an identifier or an example.
HARMLESS = ["checksum", "commit", "digest", "dummy", "etag", "example", "fake", "fingerprint", "hash", "id", "isbn", "md5", "phone", "placeholder", "sample", "sha1", "sha256", "uuid", "version"]
#: A candidate: what quotes leave of a word, without a name that is set to it there (`key=value`, `"key":"value"`) and without brackets and commas around it.
_RUN = r"""(?:[A-Za-z_][A-Za-z0-9_.-]*["'`]?[=:]+["'`]?)?[(<\[{]*([^"'`]*[^"'`,;)>\]}])"""
#: The name that a candidate is set to in its own word; empty where there is none.
_OWN_NAME = r"""^["'`(<\[{]*([A-Za-z_][A-Za-z0-9_.-]*)["'`]?[=:]"""
#: What makes a word worth a look: a digit or a change of case.
_MIXED = r"\p{Nd}|\p{Ll}\p{Lu}"
_CLASSES = "abcdefghijklmnopqrstuvwxyz0*"


def _words(text) -> F.Column:
    return F.split(text, r"\s+")


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, finding, before, before2, after, raw): one row per candidate; at is the number of the word that holds it.

    A word's candidates are what its quotes leave, of any length and in any script: what has a digit or a change of case, and
    whatever is set to one of NAMES. A name that is set to it in the same word isn't part of it, nor are brackets
    around it and a comma or semicolon after it. The two words before and the one after come along. Nulls and empty
    texts have none; texts are read whole, other columns not at all.
    """
    rows = df.select(F.col(key), _words(F.col(text).cast("string")).alias("w"))
    word = lambda i: F.when((i >= 0) & (i < F.size("w")), F.element_at("w", F.least(F.greatest(i, F.lit(0)) + 1, F.size("w")))).otherwise(F.lit(""))
    told = lambda i: word(i - 1).rlike(r"[=:]$") | word(i).rlike(r"[=:]")
    some = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: word(i).rlike(_MIXED) | told(i))
    spots = F.transform(some, lambda i: F.struct(i.cast("int").alias("at"), word(i).alias("raw"), word(i - 1).alias("before"), word(i - 2).alias("before2"), word(i + 1).alias("after")))
    spots = rows.where("w is not null").select(key, F.explode(spots).alias("s")).select(key, "s.*")
    spots = spots.where(F.col("raw").rlike(_MIXED) | (announced(NAMES) & assigned()))
    runs = F.regexp_extract_all("raw", F.lit(_RUN), 1)
    found = spots.select(key, "at", F.explode(F.array_distinct(runs)).alias("finding"), "before", "before2", F.col("after").alias("after"), "raw")
    return found.where(F.col("finding").rlike(_MIXED) | (announced(NAMES) & assigned() & F.col("finding").rlike(r"[\p{L}\p{N}]"))).where(~F.col("finding").rlike(r"^[\p{L}_.-]*[=:]+$"))


def _around(*columns) -> F.Column:
    """The lower-cased plain words of these columns."""
    return F.split(F.regexp_replace(F.lower(F.concat_ws(" ", *columns)), r"[^A-Za-z0-9_ ]", ""), " ")


def announced(by: list[str]) -> F.Column:
    """Whether one of the two words before a candidate, or the name it is set to in its own word, is one of these."""
    return F.exists(_around("before2", "before", F.regexp_extract("raw", _OWN_NAME, 1)), lambda w: w.isin(*by))


def assigned() -> F.Column:
    return F.col("before").isin("=", ":", "=>", ":=") | F.col("raw").rlike(_OWN_NAME) | F.col("before").rlike("[=:]$")


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts: lower-cased runs of three or more letters."""
    runs = F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(r"([a-z]{3,})"), 1)
    return df.select(F.explode(runs).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def transitions(words: DataFrame) -> dict[str, float]:
    """Log probability of each pair of neighbouring characters in the words, weighted by how often they come; the driver gets 27 x 26 sums at most."""
    pairs = F.transform(F.sequence(F.lit(0), F.char_length("word") - 1), lambda i: F.substring(F.concat(F.lit("*"), F.col("word")), i + 1, F.lit(2)))
    sums = {r["p"]: r["n"] for r in words.select(F.explode(pairs).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).collect()}
    from math import log

    total: dict[str, float] = {}
    for p, n in sums.items():
        total[p[0]] = total.get(p[0], 0) + n
    return {a + b: log((sums.get(a + b, 0) + 0.5) / (total.get(a, 0) + 0.5 * len(_CLASSES))) for a in _CLASSES for b in _CLASSES}


def with_features(found: DataFrame, words: DataFrame, table: dict[str, float], key: str = "doc_id") -> DataFrame:
    """Adds FEATURES to candidates, each a double."""
    f = F.col("finding")
    n = F.char_length(f).cast("double")
    share = lambda pattern: F.char_length(F.regexp_replace(f, pattern, "")) / n
    plain = F.regexp_replace(F.regexp_replace(F.lower(f), "[0-9]", "0"), "[^a-z0]", "*")
    # transitions looked up by place in a flat array: 27 times the first character's class and the second's
    code = {c: i for i, c in enumerate(_CLASSES)}
    flat = F.array(*[F.lit(table[a + b]) for a in _CLASSES for b in _CLASSES])
    codes = F.transform(F.split(F.concat(F.lit("*"), plain), ""), lambda c: F.when(c == "0", code["0"]).when(c == "*", code["*"]).otherwise(F.ascii(c) - 97))
    steps = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.element_at(flat, a * len(_CLASSES) + b + 1))
    out = found.withColumns({
        "length": n,
        "digits": share("[^0-9]"),
        "upper": share("[^A-Z]"),
        "hexadecimal": F.col("finding").rlike("^[0-9a-fA-F]+$").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(f, ""))) / n,
        "transition": F.aggregate(steps, F.lit(0.0), lambda a, v: a + v) / n,
        "path": F.col("finding").rlike(r"/|\.[a-z]{2,4}$").cast("double"),
        "address": (F.col("finding").rlike("@|^www\\.") | F.col("raw").rlike("://")).cast("double"),
        "assigned": assigned().cast("double"),
        "quoted": F.col("raw").rlike("^[\"'`]").cast("double"),
        "named": announced(NAMES).cast("double"),
        "after": F.exists(_around("after"), lambda w: w.isin(*NAMES)).cast("double"),
        "harmless": (announced(HARMLESS) | F.exists(_around("after"), lambda w: w.isin(*HARMLESS))).cast("double"),
    })
    pieces = out.select("finding").distinct().select("finding", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("finding"), F.lit(r"([a-z]{3,})"), 1))).alias("word"))
    covered = pieces.join(words.where(F.col("n") >= DICTIONARY).select("word"), "word").groupBy("finding").agg(F.sum(F.char_length("word")).alias("covered"))
    joined = out.join(covered, "finding", "left")
    return joined.withColumn("coverage", F.least(F.lit(1.0), F.coalesce(F.col("covered"), F.lit(0)) / n)).drop("covered")


def train(rows: DataFrame, labelled: int = LABELLED, seed: int = 17):
    """A forest over FEATURES from rows with a label (0 or 1); at most about `labelled` of them, by hash. None if there aren't both kinds."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = cut(rows.where("label in (0, 1)").select(*FEATURES, F.col("label").cast("double").alias("label"), F.xxhash64("finding", *FEATURES).alias("h")), "findings")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    n = sum(counts.values())
    if n > labelled:
        rows = rows.where(F.pmod("h", F.lit(1_000_003)) < labelled / n * 1_000_003)
    sample = rows.coalesce(1).sortWithinPartitions("h", *FEATURES)  # bounded above; one order, one forest
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=2)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))


def score(found: DataFrame, model, keys: list[str]) -> DataFrame:
    """(keys, score): the forest's probability that a candidate is a secret; 1 for all without a forest, so that none is lost."""
    if model is None:
        return found.select(*keys, F.lit(1.0).alias("score"))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    model.setFeaturesCol("__features")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(found)
    return model.transform(rows).select(*keys, vector_to_array("probability")[1].alias("score"))


def scan(df: DataFrame, labels: DataFrame | Callable[[DataFrame], DataFrame] | None = None, key: str = "doc_id", text: str = "text", threshold: float = 0.5, examples: DataFrame | None = None) -> DataFrame:
    """(key, at, finding, score, is_secret) for all candidates of df.

    The forest is trained on labels (key, at, finding, label) of df's own findings, or a function of the table of
    candidates that gives them, and on examples (text, finding, label): texts beside df, whose candidates that equal
    `finding` have the label. Repeated rows give repeated findings. A null key is a key like any other, but isn't
    labelled. Null and empty texts have no candidates; a long text is a row of many words. Candidates are kept whatever
    their score; is_secret tells them apart. Without labels of both kinds all are secrets.
    """
    words = cut(word_counts(df, text), "words")
    found = cut(candidates(df, key, text), "candidates")
    table = transitions(words)
    rows = cut(with_features(found, words, table, key), "features")
    keys = [key, "at", "finding"]
    known = rows.select("finding", *FEATURES, F.lit(None).cast("int").alias("label")).where("false")
    if labels is not None:
        own = labels(found) if callable(labels) else labels
        known = known.union(rows.join(own.select(*keys, F.col("label").cast("int").alias("label")).dropDuplicates(keys), keys).select("finding", *FEATURES, "label"))
    if examples is not None:
        named = examples.select(F.struct("finding", F.col("label").cast("int").alias("label")).alias("about"), F.col("text"))
        shown = with_features(candidates(named, "about", "text"), words, table, "about").where("finding = about.finding")
        known = known.union(shown.select("finding", *FEATURES, "about.label"))
    return score(rows, train(known), keys).withColumn("is_secret", F.col("score") >= threshold)
