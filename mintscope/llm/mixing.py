"""Mixing to target weights with soft membership, in DataFrame functions only.

A naive-Bayes classifier fitted on a labelled table gives each document posteriors over domains. Each document gets a
non-negative rate; projected-gradient least squares drives the expected tokens of each domain, the sum of rate x tokens
x posterior, to its target. The gradient is a few totals over all documents, which Spark sums each step.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Bound on the labelled rows that the classifier is fitted on.
LABELLED = 20_000
#: A word tells for a domain if its count there is so many standard deviations, and its share there so many times that in
#: the other domains, above what is expected. The second keeps common words out, which say little and come together.
TELL, LIFT = 4.0, 4.0
STEPS = 40


def with_marks(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the distinct marks of a text: its lower-cased words, its runs of ASCII symbols, and signs of shouting and repetition.

    Steps are columns of their own, so that each is computed once; classes are ASCII, which the matcher looks up in a table.
    """
    t, w, d, c = fresh(df, *(f"{out}_{x}" for x in "twdc"))
    df = df.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn(w, F.split(F.lower(t), r"[\s\p{Punct}\d]+")).withColumn(d, F.array_distinct(w))
    df = df.withColumn(c, F.char_length(F.regexp_replace(t, "[A-Z\u00c0-\u00de]+", "")))
    symbols = F.array_distinct(F.regexp_extract_all(t, F.lit(r"([!#$%&*+/<=>?@\[\\\]^_`{|}~]+)"), 0))
    n = F.char_length(t)
    signs = F.array_compact(F.array(F.when((n - F.col(c)) * 10 > n * 3, "<capitals>"), F.when((F.size(w) >= 10) & (F.size(d) * 4 < F.size(w)), "<repeats>")))
    return df.withColumn(out, F.concat(d, symbols, signs)).drop(t, w, d, c)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain", labelled: int = LABELLED) -> tuple[list[str], list[float], dict[str, list[float]]]:
    """(domains, log priors, word -> log odds of presence by domain) of a classifier on all words that tell for a domain.

    labels has (key, domain). At most about `labelled` labelled documents are used, by hash of the key. What reaches the
    driver is the telling words, each of which comes in several of these documents, and the domains' counts.
    """
    known = labels.where(F.col(domain).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.col(domain).cast("string")).alias("c"))
    n = known.count()
    if n > labelled:
        known = known.where(F.pmod(F.xxhash64("k"), F.lit(1_000_003)) < labelled / n * 1_000_003)
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(known, "k")
    sample = with_marks(sample, "t", "w")
    sample = cut(sample.select("c", F.filter("w", lambda x: x != "").alias("w")), "labelled")
    sizes = {r["c"]: r["count"] for r in sample.groupBy("c").count().collect()}
    names = sorted(sizes)
    if not names:
        return [], [], {}
    total = sum(sizes.values())
    seen = sample.select("c", F.explode("w").alias("word")).groupBy("word").agg(*[F.count_if(F.col("c") == c).cast("double").alias(f"n{i}") for i, c in enumerate(names)])
    everywhere = sum((F.col(f"n{i}") for i in range(1, len(names))), F.col("n0"))
    telling = F.lit(False)
    for i, c in enumerate(names):
        share, here = sizes[c] / total, F.col(f"n{i}")
        off = (here - everywhere * share) / F.sqrt(everywhere * share * (1 - share) + 0.25)
        lift = (here + 0.5) / (sizes[c] + 1.0) * (total - sizes[c] + 1.0) / (everywhere - here + 0.5)
        telling = telling | ((off >= TELL) & (lift >= LIFT))
    best = seen.where(telling).orderBy("word")
    table = {}
    for r in best.select("word", *[f"n{i}" for i in range(len(names))]).collect():
        table[r["word"]] = [(r[f"n{i}"] + 0.5) / (sizes[c] + 1.0) for i, c in enumerate(names)]
    return names, [sizes[c] / total for c in names], table


def posteriors(df: DataFrame, model, text: str = "text", out: str = "posterior") -> DataFrame:
    """Adds an array of probabilities, in the order of the model's domains: the priors for a text without known words."""
    names, priors, table = model
    if not table:
        return df.withColumn(out, F.array(*[F.lit(float(p)) for p in priors]).cast("array<double>"))
    # presence against absence: what all absent words say is in the offset
    offset = [math.log(p) + sum(math.log1p(-v[i]) for v in table.values()) for i, p in enumerate(priors)]
    weights = F.create_map(*[x for w, v in table.items() for x in (F.lit(w), F.array(*[F.lit(math.log(q / (1 - q))) for q in v]))])
    (marks,) = fresh(df, "marks")
    columns = df.columns
    df = with_marks(df, text, marks).withColumn(marks, F.filter(marks, lambda w: w.isin(list(table))))
    has = F.transform(marks, lambda w: weights[w])
    logs = F.aggregate(has, F.array(*[F.lit(o) for o in offset]), lambda a, w: F.zip_with(a, w, lambda x, y: x + y))
    df = df.withColumn(out, logs).select(*columns, out)
    df = df.withColumn(out, F.transform(out, lambda x: F.exp(x - F.array_max(out))))
    return df.withColumn(out, F.transform(out, lambda x: x / F.aggregate(out, F.lit(0.0), lambda a, v: a + v)))


def rates(docs: DataFrame, targets: list[float], steps: int = STEPS, posterior: str = "posterior", tokens: str = "tokens", out: str = "rate") -> DataFrame:
    """Adds to each document its rate; docs has tokens double and posterior array<double>, of the length of targets.

    Minimises sum over domains of (expected tokens - target)^2 / total^2 over rates >= 0 by projected gradient from rate
    1. A step moves a rate along its own posterior only, so that long and short documents of a kind get equal rates.
    A rate depends on the posterior alone, so rows are first summed up by equal posterior; every step sums one total a
    domain over those. A row replays the steps' gradients from their list, so no table of rates is kept between them.
    Null or non-positive tokens count as 0.
    """
    k = len(targets)
    t = F.greatest(F.coalesce(F.col(tokens).cast("double"), F.lit(0.0)), F.lit(0.0))
    p = F.col(posterior)
    alike = cut(docs.groupBy(p.alias("p")).agg(F.sum(t).alias("t")), "posteriors")
    total = float(alike.agg(F.sum("t").alias("n")).first()["n"] or 0)
    if not total:
        return docs.withColumn(out, F.lit(1.0))
    gradients: list[list[float]] = []

    def replay(p):
        path = F.array(*[F.array(*[F.lit(v) for v in g]) for g in gradients]).cast("array<array<double>>")
        move = lambda g: sum((p[i] * g[i] for i in range(1, k)), p[0] * g[0])
        return F.aggregate(path, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - move(g)))

    best, tried = math.inf, False
    r, weight = F.col("r"), F.when(F.col("r") > 0, F.col("t")).otherwise(F.lit(0.0))
    sums = [F.sum(r * F.col("t") * F.col("p")[i]).alias(f"e{i}") for i in range(k)] + [F.sum(weight * F.col("p")[i] * F.col("p")[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(k)]
    for _ in range(steps):
        now = alike.select(replay(F.col("p")).alias("r"), "t", "p").agg(*sums).first()
        miss = np.array([now[f"e{i}"] - targets[i] for i in range(k)]) / total
        loss = float(miss @ miss)
        if tried and loss > best:  # too far: half the step
            gradients.append([v / 2 for v in gradients.pop()])
            continue
        if np.abs(miss).max() < 1e-4 or best - loss < 1e-10:
            tried = False
            break
        # steps are taken in the metric of the second moments of the documents whose rates are above 0
        moments = np.array([[now[f"s{i}_{j}"] for j in range(k)] for i in range(k)]) / total
        metric = np.linalg.inv(moments + 0.01 * max(np.trace(moments), 1e-12) / k * np.eye(k))
        best, tried = loss, True
        gradients.append([float(v) for v in metric @ miss])
    if tried:
        gradients.pop()  # the last step was never looked at
    return docs.withColumn(out, replay(p))


def mix(df: DataFrame, labels: DataFrame, shares: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain", steps: int = STEPS, **how) -> tuple[DataFrame, list[str]]:
    """(key, text hash h, tokens, posterior, rate) for every row of df, and the domains' order.

    shares: for a domain the part of its present expected tokens that the mix is to hold (1 where not named). A token is
    taken as four UTF-8 bytes. With no labelled document all rates are 1. A null text has no tokens and the priors.
    """
    model = fit(df, labels, key, text, domain, **how)
    rows = df.select(F.col(key), F.xxhash64(F.col(text).cast("string")).alias("h"), F.coalesce(F.octet_length(F.col(text).cast("string")) / 4.0, F.lit(0.0)).alias("tokens"), F.col(text).alias("__text"))
    rows = cut(posteriors(rows, model, "__text").drop("__text"), "posteriors")
    names = model[0]
    if not names:
        return rows.withColumn("rate", F.lit(1.0)), names
    held = rows.agg(*[F.sum(F.col("tokens") * F.col("posterior")[i]).alias(f"e{i}") for i in range(len(names))]).first()
    targets = [float(held[f"e{i}"] or 0) * shares.get(c, 1.0) for i, c in enumerate(names)]
    return rates(rows, targets, steps), names


def resample(df: DataFrame, labels: DataFrame, shares: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain", **how) -> DataFrame:
    """df with each row as often as its rate says: its whole part, and once more where a hash of the key is below the rest."""
    weighed, _ = mix(df, labels, shares, key, text, domain, **how)
    k, h, n = fresh(df, "k", "h", "n")
    u = F.pmod(F.xxhash64(F.lit(11), F.col(key), "h"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    times = weighed.select(F.col(key).alias(k), F.col("h").alias(h), F.floor(F.col("rate") + F.lit(1.0) - u - F.lit(1e-9)).cast("int").alias(n)).dropDuplicates([k, h])
    own = df.withColumn(f"{h}_", F.xxhash64(F.col(text).cast("string")))
    joined = own.join(times, F.col(key).eqNullSafe(F.col(k)) & (F.col(f"{h}_") == F.col(h))).where(F.col(n) > 0)
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*df.columns)


def label_domains(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, domain) of a table of quality and toxic marks: toxic, else poor, else good."""
    return labels.select(F.col(key), F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good").alias("domain"))
