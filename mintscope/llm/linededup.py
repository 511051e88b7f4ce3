"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines are near if at most `edits` characters inserted, deleted or replaced turn one into the other, whatever their
length. All variants of a line with that many gaps, each with one character cut out or none, are hashed by what stands
between the gaps; near lines share such a key and are joined on it. Lines that share a key differ only in the gaps, so
each is near to all the others there.

Emitting all variants of each line would multiply the corpus, so variants are emitted only where a near line can exist.
For one edit, the bound that is used unless another is asked for: a single edit leaves the first or the second half of a line alone: lines whose halves occur in no
other line are out (level 1, hashes only). For the rest the same is asked with the line in sixteen blocks (level 2),
which also tells in which block the edit must be, and only deletions inside it are emitted. No near pair is lost.

For more edits, the shorter of two near lines, cut into one part more than there are edits, has a part that stands in
the longer one, at most `edits` characters from its place: only lines that share such a part are opened. A line of n
characters then has about (2 n)^edits / edits! variants.

Lines without a letter or digit (blank ones, rules, brackets) aren't judged.
"""

from __future__ import annotations

from itertools import combinations_with_replacement, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, fresh, grown

BLOCKS = 16
#: Copies of a shared half's row, so that lines that share one common half meet in many tasks.
SALTS = 32

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


def _sides(line: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Code points of a line, hashes of its first k and of its last k of them for every k."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(points)
    code = _mix(points.astype(np.uint64) + np.uint64(1))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))[:n]
    zero = np.zeros(1, dtype=np.uint64)
    return n, np.concatenate([zero, np.cumsum(code * powers)]), np.concatenate([zero, np.cumsum(code[::-1] * powers)])


def _key(before: np.ndarray, after: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    return (_mix(before) * np.uint64(3) + _mix(after + np.uint64(0x51)) + _mix(np.asarray(tag, dtype=np.uint64))).astype(np.int64)


def _blocks(n: int) -> list[tuple[int, int, int]]:
    """(tag, characters before the block, characters after it) for pairs whose shorter line has n or n - 1 characters."""
    out = []
    for b in (n, n - 1):
        for q in range(BLOCKS):
            a, z = q * b // BLOCKS, (q + 1) * b // BLOCKS
            out.append((b * BLOCKS + q, a, b - z))
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def block_keys(lines: pd.Series) -> pd.Series:
    """Keys of a line with one of sixteen blocks cut out."""
    out = []
    for line in lines:
        n, head, tail = _sides(line)
        tag, a, c = (np.array(v) for v in zip(*_blocks(n), strict=True))
        out.append(_key(head[a], tail[c], tag))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.LongType()))
def variant_keys(lines: pd.Series, shared: pd.Series) -> pd.Series:
    """Keys of all deletions and gaps inside the blocks whose keys (`shared`) another line has too."""
    out = []
    for line, keys in zip(lines, shared, strict=True):
        n, head, tail = _sides(line)
        spans = _blocks(n)
        tag, a, c = (np.array(v) for v in zip(*spans, strict=True))
        places: set[int] = set()
        for i in np.flatnonzero(np.isin(_key(head[a], tail[c], tag), np.asarray(keys))):
            places.update(range(spans[i][1], n - spans[i][2] + 1))
        p = np.array(sorted(places))
        cut_at = p[p < n]
        out.append(np.unique(np.concatenate([_key(head[cut_at], tail[n - cut_at - 1], 0), _key(head[p], tail[n - p], 0)])))
    return pd.Series(out)


def gap_keys(edits: int):
    """A function from lines to the keys of all ways to open `edits` gaps in each, with or without the character there."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(lines: pd.Series) -> pd.Series:
        import xxhash

        out = []
        for line in lines:
            known: set[bytes] = set()
            for gaps in combinations_with_replacement(range(len(line) + 1), edits):
                for cuts in product((0, 1), repeat=edits):
                    at, parts = 0, []
                    for g, c in zip(gaps, cuts, strict=True):
                        if g < at or g + c > len(line):
                            break
                        parts.append(line[at:g])
                        at = g + c
                    else:
                        known.add(xxhash.xxh3_64_digest("\0\n".join([*parts, line[at:]]).encode("utf-8", "surrogatepass")))
            out.append(np.frombuffer(b"".join(known), dtype="<i8"))
        return pd.Series(out)

    return keys


def _part_keys(line: F.Column, edits: int) -> F.Column:
    """Hashes of the parts of a line as the shorter of a pair, and of what may stand for them in it as the longer one."""
    n, out = F.char_length(line), []
    for less in range(edits + 1):
        for i in range(edits + 1):
            start, end = F.floor((n - less) * i / (edits + 1)), F.floor((n - less) * (i + 1) / (edits + 1))
            for shift in range(-edits, edits + 1):
                at = start + shift
                out.append(F.when((n >= less) & (at >= 0) & (at + end - start <= n), F.xxhash64(F.lit(i), n - less, F.substring(line, (at + 1).cast("int"), (end - start).cast("int")))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs in another row too. Counting is pre-aggregated; a common key's rows meet in SALTS tasks."""
    twice = rows.groupBy(key).count().where("count > 1").select(key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(grown(twice), [key, "salt"]).drop("salt")


def _judged(line) -> F.Column:
    return F.rlike(line, F.lit("[\\p{L}\\p{N}]"))


def _bitmaps(firsts: DataFrame) -> DataFrame:
    """(d, t, bits) for a table of places `first` (d, t, no): for each document a map from each 64 lines to their bits."""
    words = firsts.groupBy("first.d", "first.t", F.expr("first.no div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, first.no % 64)")).alias("bits"))
    return words.groupBy("d", "t").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))


def _with_lines(df: DataFrame, text: str, bits: str, out: str) -> DataFrame:
    """Adds the lines of a text as an array of (line, on), on from the bits; no step looks anything up by a line's number."""
    (lines,) = fresh(df, f"{out}_")
    df = df.withColumn(lines, F.split(F.col(text).cast("string"), "\n"))
    words = F.transform(F.sequence(F.lit(0), F.expr(f"(size({lines}) - 1) div 64")), lambda w: F.coalesce(F.col(bits)[w.cast("long")], F.lit(0).cast("long")))
    df = df.withColumn(out, F.flatten(F.transform(words, lambda b: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(b, k) == 1))))
    return df.withColumn(out, F.arrays_zip(F.col(lines).alias("line"), F.slice(out, F.lit(1), F.size(lines)).alias("on"))).drop(lines)


def kept_lines(df: DataFrame, key: str = "doc_id", text: str = "text", edits: int = 1) -> DataFrame:
    """(d, t, bits): for each document (key d, text hash t) its kept lines of those that are judged.

    A line is kept if no line before it, by (key, text hash, line number), is equal or near.
    """
    docs = df.select(F.col(key).cast("long").alias("d"), F.col(text).cast("string").alias("x")).where("x is not null")
    lines = docs.select("d", F.xxhash64("x").alias("t"), F.posexplode(F.split("x", "\n")).alias("no", "line")).where(_judged("line"))
    # level 1: distinct lines (128-bit hash, first place) with the hashes of their halves, for either length of a pair
    n = F.char_length("line")
    ids = F.struct(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line", n).alias("g"))
    halves = F.array(*[F.xxhash64(F.lit(i), n - s, F.expr(f"substring(line, 1, (char_length(line) - {s}) div 2)") if i == 0 else F.expr(f"right(line, (char_length(line) - {s}) div 2)")) for s in (0, 1) for i in (0, 1)])
    hashed = lines.select(ids.alias("id"), F.struct("d", "t", "no").alias("first"), (halves if edits == 1 else _part_keys(F.col("line"), edits) if edits else F.array().cast("array<long>")).alias("halves"))
    distinct = cut(hashed.groupBy("id").agg(F.min("first").alias("first"), F.first("halves").alias("halves")), "lines")
    halved = distinct.select("id", "first", F.explode("halves").alias("half"))
    some = _shared(halved, "half").select("id", "first").distinct()
    # level 2 needs the text of what is left: marked in its document, which is then opened once
    whole = docs.withColumn("t", F.xxhash64("x"))
    wanted = _bitmaps(some).withColumnsRenamed({"d": "wd", "t": "wt"})
    marked = _with_lines(whole.join(wanted, F.col("wt").eqNullSafe(F.col("t")) & F.col("wd").eqNullSafe(F.col("d"))), "x", "bits", "m")
    opened = F.filter(F.transform("m", lambda z, i: F.struct(i.alias("no"), z["line"].alias("line"), z["on"].alias("on"))), lambda z: z["on"])
    texts = marked.select("d", "t", F.explode(opened).alias("z")).select("d", "t", "z.no", "z.line")
    found = cut(texts.select(ids.alias("id"), F.struct("d", "t", "no").alias("first"), "line").dropDuplicates(["id"]), "halves")
    if edits != 1:
        variants = found.select("first", F.explode(gap_keys(edits)("line")).alias("variant"))
        early = variants.groupBy("variant").agg(F.min("first").alias("early"), F.count(F.lit(1)).alias("n")).where("n > 1")
        lost = variants.join(grown(early), "variant").where("early < first").select("first").distinct()
        return _bitmaps(distinct.select("first").join(lost, "first", "left_anti"))
    near = _shared(found.select("id", F.explode(block_keys("line")).alias("block")), "block").groupBy("id").agg(F.collect_list("block").alias("blocks"))
    variants = found.join(grown(near), "id").select("id", "first", F.explode(variant_keys("line", "blocks")).alias("variant"))
    earliest = variants.groupBy("variant").agg(F.min("first").alias("early"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = variants.join(grown(earliest), "variant").where("early < first").select("first", "early").distinct()
    line_of = found.select(F.col("first"), F.col("line").alias("later"))
    early_of = found.select(F.col("first").alias("early"), F.col("line").alias("earlier"))
    lost = pairs.join(line_of, "first").join(early_of, "early").where(F.levenshtein("later", "earlier", 1) >= 0).select("first").distinct()
    return _bitmaps(distinct.select("first").join(lost, "first", "left_anti"))


def clean(df: DataFrame, key: str = "doc_id", text: str = "text", edits: int = 1) -> DataFrame:
    """df with each text reduced to its kept lines, and n_lines and n_removed added.

    Lines are what newlines separate. A line with a letter or digit goes if an earlier one (by key, then line number) is
    equal or within `edits` characters of it, however short; lines are judged on the input, not on what is left. Lines
    without a letter or digit stay. A null text stays null with 0 lines; a null key sorts first; rows that repeat key
    and text get equal answers, their first copy's. Other columns pass through; where df has an added name already, the
    added column gets underscores before it.
    """
    bounded_batches(df.sparkSession)
    d, t, kept, own, flags = fresh(df, "d", "t", "kept", "own", "flags")
    left = kept_lines(df, key, text, edits).select(F.col("d").alias(d), F.col("t").alias(t), F.col("bits").alias(kept))
    rows = df.withColumn(own, F.xxhash64(F.col(text).cast("string")))
    joined = rows.join(left, F.col(own).eqNullSafe(F.col(t)) & F.col(key).cast("long").eqNullSafe(F.col(d)), "left")
    done = _with_lines(joined, text, kept, flags)
    stay = F.filter(flags, lambda z: z["on"] | ~_judged(z["line"]))
    (left_over,) = fresh(done, "stay")
    done = done.withColumn(left_over, stay)
    gone = F.col(text).isNull()
    out = [F.when(~gone, F.array_join(F.transform(left_over, lambda z: z["line"]), "\n")).alias(c) if c == text else F.col(c) for c in df.columns]
    n = F.when(gone, 0).otherwise(F.size(flags)).cast("long")
    lines, removed = fresh(df, "n_lines", "n_removed")
    return done.select(*out, n.alias(lines), (n - F.when(gone, 0).otherwise(F.size(left_over))).cast("long").alias(removed))


def drop_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", edits: int = 1) -> DataFrame:
    """df without near-duplicate lines; documents that lose their last line with a letter or digit in it go, others stay."""
    removed = fresh(df, "n_removed")[0]
    done = clean(df, key, text, edits)
    return done.where((F.col(removed) == 0) | F.col(text).rlike("[\\p{L}\\p{N}]")).select(*df.columns)
