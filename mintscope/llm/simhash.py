"""SimHash near-duplicates by one-wildcard segment variants.

A 64-bit fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most two bits, one segment
differs in at most one, so the two share a variant of that segment with one bit blanked. Each distinct fingerprint
is indexed under its 64 variants and equal variants are joined and verified. A crowded variant (near copies that
agree on a whole segment) is not paired: its members are indexed again with every two of the 64 bits blanked,
where a bucket holds four fingerprints at most, all of them linked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, grown
from .components import components

#: Members of a variant that are compared pair by pair; more go by two-bit variants, which give the same links.
CROWD = 48


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-width] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], 42) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The 64 bits, each set where it is in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "simhash", width: int = 3) -> DataFrame:
    """Adds the SimHash of `text` as a (signed) long. A null text counts as empty: 0."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf(T.LongType())
    def simhash(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in s], dtype=np.uint64).astype(np.int64))

    return df.withColumn(out, simhash(F.col(text).cast("string")))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) node pairs that link all fingerprints differing in at most two bits; prints: node long, simhash long, distinct simhash.

    Of four fingerprints in a two-bit bucket only the links to the smallest node are given, which join the same components.
    """
    w = F.col("w")
    segment = F.when(w < 32, F.col("simhash").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("simhash", 32))
    keyed = prints.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(63)))).select(
        "node",
        "simhash",
        F.expr("w % 32 = 0").alias("once"),
        F.expr("shiftleft(cast(w as bigint), 32)").bitwiseOR(segment.bitwiseAND(F.expr("~shiftleft(1L, w % 32)"))).alias("key"),
    )
    # counted by pre-aggregation; a crowded variant's rows are then split by the join where they are too many for a task
    crowds = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = cut(keyed.join(grown(crowds), "key"), "variants")
    # verified before they become rows; two that agree on the whole segment meet under each of its bits, and count under the first
    bucket = sized.where(F.col("n") <= crowd).groupBy("key", "once").agg(F.array_sort(F.collect_list(F.struct("node", "simhash"))).alias("m"))
    same = "((shiftrightunsigned(key, 32) < 32 and ((x.simhash ^ y.simhash) & 4294967295L) = 0) or (shiftrightunsigned(key, 32) >= 32 and shiftrightunsigned(x.simhash ^ y.simhash, 32) = 0))"
    verified = f"filter(slice(m, i + 2, size(m)), y -> bit_count(x.simhash ^ y.simhash) <= 2 and (once or not {same}))"
    found = F.expr(f"flatten(transform(m, (x, i) -> transform({verified}, y -> named_struct('a', x.node, 'b', y.node))))")
    near = bucket.select(F.explode(found).alias("l")).select("l.a", "l.b")
    crowded = sized.where(F.col("n") > crowd).select("node", "simhash").distinct()
    two = crowded.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(62)))).withColumn("j", F.explode(F.expr("sequence(i + 1, 63)")))
    two = two.groupBy(F.expr("i * 64 + j").alias("mask"), F.expr("simhash & ~(shiftleft(1L, i) | shiftleft(1L, j))").alias("rest"))
    star = two.agg(F.array_sort(F.collect_list("node")).alias("m")).where(F.size("m") > 1)
    return near.union(star.select(F.col("m")[0].alias("a"), F.explode(F.expr("slice(m, 2, size(m))")).alias("b")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, crowd: int = CROWD) -> DataFrame:
    """(key, fingerprint, component_id) per row of df.

    fingerprint is 16 lowercase hex digits; component_id is the smallest key reachable over links of at most two
    differing bits. Null text counts as empty (fingerprint zero, linked like any other); a null key gets a
    fingerprint and, where the component has a key, its smallest. Repeated rows are answered row by row. Other
    columns of df are not read.
    """
    rows = cut(with_fingerprint(df.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")), "text", "simhash", width).drop("text"), "simhash")
    distinct = cut(rows.groupBy("simhash").agg(F.min("node").alias("node")), "prints")
    group = components(links(distinct.where("node is not null"), crowd))
    joined = cut(distinct.join(group, "node", "left").select("simhash", F.coalesce("component", "node").alias("component_id")), "classes")
    return rows.join(joined, "simhash").select(F.col("node").alias(key), F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of df whose key is its component's smallest. Rows with a null key stay."""
    lost = near_duplicates(df, key, text, **how).where(F.col(key) != F.col("component_id")).select(F.col(key))
    return df.join(lost, key, "left_anti").select(*df.columns)
