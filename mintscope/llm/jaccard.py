"""Near-duplicates by five-word shingles: all pairs whose sets of shingles have a Jaccard similarity of 0.8 or more.

Candidates are the pairs whose SimHash fingerprints of these shingles differ in at most two bits (`simhash.links`).
Similar pairs may be up to 10 bits apart, and segments short enough to find 10 bits are shared by unrelated documents:
what the fingerprints leave out comes from equal bands of a MinHash signature, of which a pair at 0.8 shares none of
the 40 of 5 with a probability of 1e-7. Every candidate is verified on the whole sets.

A crowd of near copies shares its bands. Its members are first compared to the smallest and to the one before them;
then only members of one band that are still in different components are looked at. With all shingles in order of how
many of these members have them, rarest first, two sets that are similar enough share one of their first few (the
prefix filter), at a place after which enough is left of both (the positional filter). So a member that is too far from
all others, by shingles that no one else has, meets none of them, and no pair that could be similar is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import bounded_batches, cut, grown
from .components import components

WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS = 40, 5
#: Members from which a band is dealt over SALTS tasks.
CROWD, SALTS = 10_000, 64

_ODD = np.random.default_rng(29).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of all runs of `width` words; of the whole where there are fewer, none of no words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[s:e], 42) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64))


def signature(text: str | None, width: int = WIDTH) -> np.ndarray:
    """A 128-bit hash of the words in two longs, then the SimHash fingerprint and a key for each band (none of a text without words)."""
    words = words_of(text)
    whole = np.frombuffer(xxhash.xxh128_digest(b" ".join(words)), dtype="<u8")
    h = shingles(words, width)
    if not len(h):
        return whole.astype(np.int64)
    least = np.full(len(_ODD), 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(h), 512):
        np.minimum(least, (h[i : i + 512, None] * _ODD).min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)]
    return np.concatenate([whole, np.array([simhash.majority(h.astype("<u8")), *keys], dtype=np.uint64)]).astype(np.int64)


def _near(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), the smaller first, of nodes (node, simhash) whose fingerprints differ in at most two bits; equal ones as pairs with their smallest."""
    least = cut(prints.groupBy("simhash").agg(F.min("node").alias("least")), "prints")
    same = prints.join(least, "simhash").select(F.col("least").alias("a"), F.col("node").alias("b"))
    pairs = same.union(simhash.links(least.select(F.col("least").alias("node"), "simhash")))
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def _apart(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes (node, c) with different c whose sets may be similar enough, by prefix and place; none that is, is missing."""
    own = sets.join(nodes, "node").select("node", "c", "s", F.size("s").alias("n"))
    tokens = own.select("node", F.explode("s").alias("t"))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = tokens.join(grown(often), "t").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("r"))
    first = F.col("n") - F.size("r")  # shingles of its own, the rarest, stand before
    length = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1
    x = own.select("node", "c", "n").join(grown(ranked), "node").select("node", "c", "n", F.posexplode(F.slice("r", F.lit(1), F.greatest(F.lit(0), (length - first).cast("int")))).alias("i", "r"), first.alias("u"))
    x = x.select("node", "c", "n", F.col("r.t").alias("t"), (F.col("n") - F.col("u") - F.col("i")).alias("left"))
    y = x.select(F.col("node").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), "t", F.col("left").alias("lb"))
    enough = F.least("left", "lb") >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("nb")) - 1e-9
    return x.withColumnRenamed("node", "a").join(grown(y), "t").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("cb")) & enough).select("a", "b").distinct()


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILAR) -> DataFrame:
    """(key, component_id) per row of df with a key; component_id is the smallest key reachable over links of similar texts.

    Texts of equal words (ASCII case and white space aside) are similar, those without words too. Nothing is read but
    key and text.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def signed(s: pd.Series) -> pd.Series:
        return pd.Series([signature(t, width) for t in s])

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def shingled(s: pd.Series) -> pd.Series:
        return pd.Series([shingles(words_of(t), width).astype(np.int64) for t in s])

    docs = df.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("x")).where("node is not null")
    signs = docs.select("node", signed("x").alias("g"))
    rows = cut(signs.select("node", F.struct(F.col("g")[0].alias("h"), F.col("g")[1].alias("l")).alias("w"), F.get("g", F.lit(2)).alias("simhash"), F.slice("g", F.lit(4), F.lit(BANDS)).alias("bands")), "signatures")
    distinct = cut(rows.groupBy("w").agg(F.min("node").alias("node"), F.first("simhash").alias("simhash"), F.first("bands").alias("bands")), "words")
    # a repeated key may stand for several texts: those are one node, whatever it holds
    same = rows.join(distinct.select("w", F.col("node").alias("a")), "w").where("a <> node").select("a", F.col("node").alias("b"))
    near = cut(_near(distinct.select("node", "simhash").where("simhash is not null")), "near")
    banded = distinct.select("node", F.explode("bands").alias("band")).distinct()
    # counted by pre-aggregation; a crowded band is dealt over salts, and each member is set beside the one before it in its salt
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
    met = banded.join(grown(shared), "band").withColumn("salt", F.when(F.col("n") > CROWD, F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0)))
    met = cut(met.withColumn("last", F.expr("lag(node, 1, nullif(least, node)) over (partition by band, salt order by node)")).select("band", "node", "n", "least", "last"), "bands")
    wanted = docs.join(met.select("node").union(near.select("a")).union(near.select("b")).distinct(), "node", "left_semi")
    sets = cut(wanted.withColumn("s", shingled("x")).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s")), "shingles")
    first = met.where("last is not null").select(F.col("least").alias("a"), F.col("node").alias("b"))
    first = cut(first.union(met.where("last is not null").select(F.col("last").alias("a"), F.col("node").alias("b"))).union(near).distinct(), "pairs")
    links = cut(same.union(_similar(first, sets, similarity)), "links")
    # members of a band that are not yet together
    crowd = met.where("n > 2").join(components(links).withColumnRenamed("component", "c"), "node", "left").select("band", "node", F.coalesce("c", "node").alias("c"))
    split = crowd.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band")
    crowd = cut(crowd.join(split, "band").select("node", "c").distinct(), "apart")
    rest = _apart(crowd, sets, similarity).join(first, ["a", "b"], "left_anti")
    group = components(links.union(_similar(rest, sets, similarity)))
    return rows.select("node").join(group, "node", "left").select(F.col("node").alias(key), F.coalesce("component", "node").alias("component_id"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of df whose key is its component's smallest. Rows with a null key stay."""
    lost = groups(df, key, text, **how).where(F.col(key) != F.col("component_id")).select(key).distinct()
    return df.join(lost, key, "left_anti").select(*df.columns)
