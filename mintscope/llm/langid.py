"""Hierarchical language identification: family first, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams of the whole lower-cased text, square-rooted and scaled to length 1. All
classifiers are linear SVMs (squared hinge) that vote pair by pair: between families, then between the languages of
the family that won. They are fitted in one task on a sample of labelled rows whose size is bounded by `per_lang`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Language families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
DIM = 4096
PER_LANG = 800


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's letter categories is there; fractions, numerals and marks are none."""
    return any(map(str.isalpha, text))


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(text: str) -> np.ndarray:
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.zeros(DIM)
    for i in range(0, len(raw), 1 << 20):  # bounded memory for very long texts
        b = raw[i : i + (1 << 20) + 2].astype(np.uint32)
        if len(b) > 2:
            code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
            counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    v = np.sqrt(counts)
    return v / max(np.linalg.norm(v), 1e-12)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 120) -> np.ndarray:
    """Weights (last: bias) of min |w|^2 / 2 + c * sum max(0, 1 - y (w x + b))^2, each class weighted alike."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    cw = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * c
    v = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    for _ in range(15):
        v = x.T @ (cw * (x @ v))
        top = np.linalg.norm(v)
        v /= top
    step = 1 / (1 + 2 * top)
    w = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (z - 2 * x.T @ (cw * slack * y))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / u * (new - w), new, u
    return w


def _duels(x: np.ndarray, labels: np.ndarray) -> list[tuple[str, str, np.ndarray]]:
    out = []
    for a, b in combinations(sorted(set(labels)), 2):
        rows = (labels == a) | (labels == b)
        out.append((a, b, svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0))))
    return out


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> dict[str, list[tuple[str, str, np.ndarray]]]:
    """group -> its pairwise classifiers; group "" decides between families, the others between a family's languages.

    Learns from rows with a non-null label and a text with letters. Of each language at most `per_lang` rows are
    used, those with the smallest hash of the key among a thinned set. The driver gets the weights only.
    """
    there = df.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where("l is not null and t is not null and k is not null")
    counts = {r["l"]: r["count"] for r in there.groupBy("l").count().collect()}
    if not counts:
        return {"": []}
    rate = F.create_map(*[F.lit(v) for l, n in counts.items() for v in (l, min(1.0, 1.5 * per_lang / n + 20 / n))])
    thin = there.withColumn("h", F.xxhash64("k")).where(F.pmod("h", F.lit(1_000_003)) < rate[F.col("l")] * 1_000_003)
    sample = thin.withColumn("r", F.expr("row_number() over (partition by l order by h, t)")).where(F.col("r") <= per_lang).select("l", "t", F.lit(1).alias("one"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[[has_letter(t) for t in pdf["t"]]].sort_values(["l", "t"])
        rows = []
        if len(pdf):
            x = np.array([features(t) for t in pdf["t"]])
            labels = pdf["l"].to_numpy()
            families = np.array([family_of(v) for v in labels])
            rows += [("", a, b, w) for a, b, w in _duels(x, families)]
            for f in sorted(set(families)):
                own = families == f
                rows.append((f, labels[own][0], None, np.zeros(0)))
                rows += [(f, a, b, w) for a, b, w in _duels(x[own], labels[own])]
        return pd.DataFrame(rows, columns=["group", "a", "b", "w"])

    model: dict[str, list] = {"": []}
    for r in sample.groupBy("one").applyInPandas(train, "group string, a string, b string, w array<double>").collect():
        model.setdefault(r["group"], [])
        if r["b"] is None:
            model[r["group"]].insert(0, (r["a"], None, None))
        else:
            model[r["group"]].append((r["a"], r["b"], np.array(r["w"])))
    return model


def _vote(x: np.ndarray, duels: list) -> tuple[str | None, float]:
    """The label with the most duels won, ties by summed margin, then by name; its mean confidence in (0, 1]."""
    tally: dict[str, list[float]] = {}
    alone = None
    for a, b, w in duels:
        if b is None:
            alone = a
            continue
        m = float(x @ w[:-1] + w[-1])
        for name, v in ((a, m), (b, -m)):
            old = tally.setdefault(name, [0, 0.0, 0.0, 0])
            tally[name] = [old[0] + (v > 0), old[1] + v, old[2] + 1 / (1 + np.exp(-np.clip(4 * v, -60, 60))), old[3] + 1]
    if not tally:
        return alone, 1.0
    best = min(tally, key=lambda k: (-tally[k][0], -tally[k][1], k))
    return best, tally[best][2] / tally[best][3]


def predict(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1). `und` and 0 where the text is null or has no letter, or nothing was learned."""

    bounded_batches(df.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        families = [k for k in model if k]
        for s in parts:
            out = []
            for t in s:
                if not t or not families or not has_letter(t):
                    out.append(("und", 0.0))
                    continue
                x = features(t)
                family, p = _vote(x, model[""])
                lang, q = _vote(x, model[family or families[0]])
                out.append((lang, p * q))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    guess = guess.asNondeterministic()  # else a filter on what it says makes Spark call it twice
    return df.withColumn("_guess", guess(F.col(text).cast("string"))).select(*df.columns, "_guess.lang_pred", "_guess.score")


def held_out(key: str = "doc_id"):
    """True where the row takes no part in learning: crc32 of the key as text leaves 1 when divided by 3."""
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """(key, held_out, lang_pred, score): learned from the rows that aren't held out, predicted for all.

    A row with a null key takes no part in learning and counts as not held out. Repeated rows get equal answers;
    columns of the input other than the three named are not read.
    """
    model = fit(df.where(~held_out(key)), key, text, lang, per_lang)
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return predict(rows, model, "t").select(F.col("k").alias(key), F.coalesce(held_out("k"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """The rows of df whose language can be told; texts that are null or have no letter go."""
    model = fit(df.where(~held_out(key)), key, text, lang, per_lang)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("t"))
    return predict(rows, model, "t").where("lang_pred <> 'und'").select("row.*")
