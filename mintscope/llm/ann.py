"""Approximate nearest neighbours by shifted Hilbert curves.

Vectors are projected on several random turns of their main axes, shifted, and ordered along a Hilbert curve each time.
Spark range-partitions the keys; the sorted keys are numbered over all partitions and cut into blocks of BLOCK rows. A
query meets its own block and as many beside it, on as many curves, as the table needs: for a bounded sample of the queries the
true neighbours are found among all rows, and the cheapest window that holds the wanted part of them is taken. Tight
clusters need a block or three whatever the table's size; data without structure need windows that grow with it, up to
all of it. What the windows give is merged, and ranked by exact distance in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

CURVES, DIMS, BITS = 16, 10, 5
#: Rows of a block.
BLOCK = 1024
#: Part of the true neighbours that windows have to hold, and bound on the queries that this is measured on.
TARGET, MEASURED = 0.95, 200
#: Bound on the rows that the axes are fitted on, and on the axes that are turned.
SAMPLE, AXES = 5000, 64


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with `bits` bits a coordinate, by Skilling's transform."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            up = (x[i] & np.uint32(q)) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> np.uint32(b)) & 1)
    return key


def usable(df: DataFrame, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of the rows that can take part, and (node, vec, ids): their distinct vectors with the smallest keys that hold each.

    Null, empty, zero and non-finite vectors are out. Shorter vectors count as if zeros followed. A key that comes
    with several vectors counts with the smallest of them, so that a node is known by its smallest key. Of equal vectors
    the eleven smallest keys are enough for any ten nearest, as ties go to smaller keys.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"))
    rows = rows.where("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    zero = F.lit(0).cast(rows.schema["vec"].dataType.elementType)
    padded = F.when(F.size("vec") < longest, F.concat("vec", F.array_repeat(zero, F.lit(longest) - F.size("vec")))).otherwise(F.col("vec"))
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("vec", padded)
    first = rows.withColumn("r", F.expr("row_number() over (partition by vec order by id)")).where("r <= 11")
    return rows, first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("node"), "vec", "ids")


def axes(nodes: DataFrame, count: int, sample: int, curves: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(projection, low, span) of each curve, fitted on at most `sample` vectors, those of smallest hash."""
    share = min(1.0, 2.0 * sample / max(1, count))
    thin = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_003)) < share * 1_000_003).orderBy(F.xxhash64("node"), "node").limit(sample)
    x = np.array([r["vec"] for r in thin.select("vec").collect()], dtype=np.float64)
    centre = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - centre, full_matrices=False)
    main = vt[: min(AXES, len(vt))]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(curves):
        turn = np.linalg.qr(rng.normal(size=(len(main), len(main))))[0][:, : min(dims, len(main))]
        p = main.T @ turn
        y = x @ p
        low, high = np.quantile(y, 0.001, axis=0), np.quantile(y, 0.999, axis=0)
        span = np.maximum(high - low, 1e-12) * 2  # the points fill half of the cube, shifted by up to the other half
        out.append((p, low - rng.random(p.shape[1]) * span / 2, span))
    return out


def ordered(nodes: DataFrame, turns: list[tuple[np.ndarray, np.ndarray, np.ndarray]], count: int, bits: int) -> DataFrame:
    """(curve, node, place): each node's place in the order of each curve. Keys travel, vectors don't."""

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not len(pdf):
                continue
            x = np.array(pdf["vec"].tolist(), dtype=np.float64)
            for c, (p, low, span) in enumerate(turns):
                cells = np.clip((x @ p - low) / span * (1 << bits), 0, (1 << bits) - 1)
                yield pd.DataFrame({"curve": c, "key": hilbert(cells, bits), "node": pdf["node"]})

    def numbered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        seen: dict[int, int] = {}
        for pdf in parts:
            pdf["part"] = TaskContext.get().partitionId()
            pdf["at"] = pdf.groupby("curve").cumcount() + pdf["curve"].map(lambda c: seen.get(c, 0))
            for c, n in pdf["curve"].value_counts().items():
                seen[c] = seen.get(c, 0) + int(n)
            yield pdf[["curve", "node", "part", "at"]]

    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(len(turns) * count / 1_000_000))
    keys = nodes.select("node", "vec").mapInPandas(keyed, "curve int, key long, node long")
    keys = keys.repartitionByRange(parts, "curve", "key", "node").sortWithinPartitions("curve", "key", "node")
    rows = cut(keys.mapInPandas(numbered, "curve int, node long, part int, at long"), "curves")
    sizes = rows.groupBy("curve", "part").count()
    before = sizes.withColumn("before", F.expr("coalesce(sum(count) over (partition by curve order by part rows between unbounded preceding and 1 preceding), 0)")).drop("count")
    return rows.join(F.broadcast(before), ["curve", "part"]).select("curve", "node", (F.col("before") + F.col("at")).alias("place"))  # before: at most one row a partition and curve


def true_neighbours(nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, node): the k nearest other nodes of each row (node, vec) of `asked`, a bounded table, among all nodes."""
    some = asked.collect()
    y = np.array([r["vec"] for r in some], dtype=np.float64)
    ids = np.array([r["node"] for r in some], dtype=np.int64)
    norms = np.square(y).sum(axis=1)

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full((len(ids), k), np.inf)
        who = np.full((len(ids), k), -1, dtype=np.int64)
        for pdf in parts:
            if not len(pdf):
                continue
            x = np.array(pdf["vec"].tolist(), dtype=np.float64)
            nodes_ = pdf["node"].to_numpy()
            d = norms[:, None] - 2 * y @ x.T + np.square(x).sum(axis=1)[None, :]
            d[ids[:, None] == nodes_[None, :]] = np.inf
            both, names = np.concatenate([best, d], axis=1), np.concatenate([who, np.broadcast_to(nodes_, d.shape)], axis=1)
            keep = np.argpartition(both, k - 1, axis=1)[:, :k]
            best, who = np.take_along_axis(both, keep, axis=1), np.take_along_axis(names, keep, axis=1)
        i, j = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"query": ids[i], "node": who[i, j], "d": best[i, j]})

    found = nodes.select("node", "vec").mapInPandas(nearest, "query long, node long, d double")
    return found.withColumn("r", F.expr("row_number() over (partition by query order by d, node)")).where(F.col("r") <= k).select("query", "node")


def windows(places: DataFrame, pairs: DataFrame, block: int, count: int, target: float) -> tuple[int, int]:
    """(curves, blocks to each side): the cheapest window in which at least `target` of the pairs (query, node) meet."""
    at = places.withColumn("b", F.expr(f"place div {block}")).select("curve", "node", "b")
    own = at.withColumnRenamed("node", "query").withColumnRenamed("b", "q")
    apart = F.broadcast(pairs).join(at, "node").join(F.broadcast(pairs.select("query").distinct()).join(own, "query"), ["query", "curve"])  # pairs: k of each measured query
    rows = apart.groupBy("query", "node").agg(F.array_sort(F.collect_list(F.struct("curve", F.abs(F.col("b") - F.col("q")).alias("d")))).alias("d")).collect()
    if not rows:
        return 1, 1
    d = np.array([[x["d"] for x in r["d"]] for r in rows])
    best = None
    for c in range(1, d.shape[1] + 1):
        w = max(1, int(np.quantile(d[:, :c].min(axis=1), target, method="higher")))
        cost = c * min(2 * w + 1, count // block + 1)
        best = min(best or (cost, c, w), (cost, c, w))
    return best[1:]


def search(df: DataFrame, queries, key: str = "vec_id", vec: str = "embedding", k: int = 10, block: int = BLOCK, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, sample: int = SAMPLE, seed: int = 7, target: float = TARGET, measured: int = MEASURED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets the condition `queries` (on `key`), its k <= 10 nearest other rows found.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller key. Windows hold
    `target` of the true neighbours of the `measured` queries of smallest hash, and at least `block` rows on each side of
    a query's place. Rows that can't take part (see `usable`) are no queries either; rows with the query's key are its own.
    Other columns are not read.
    """
    spark = df.sparkSession
    rows, nodes = usable(df.select(key, vec), key, vec)
    nodes = cut(nodes, "vectors")
    count = nodes.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    turns = axes(nodes, count, sample, curves, dims, seed)
    wide = "<f4" if isinstance(df.schema[vec].dataType.elementType, T.FloatType) else "<f8"

    @F.pandas_udf(T.BinaryType())
    def packed(v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, dtype=wide).tobytes() for x in v])

    members = cut(rows.where(queries(F.col("id"))).join(nodes, "vec").select(F.col("id").alias("query_id"), F.col("node").alias("query")), "queries")
    asked = members.select(F.col("query").alias("node")).distinct().withColumn("asked", F.lit(True))
    raw = nodes.join(asked, "node", "left").select("node", packed("vec").alias("raw"), F.coalesce("asked", F.lit(False)).alias("asked"))
    places = cut(ordered(nodes, turns, count, bits), "places")
    some = asked.orderBy(F.xxhash64("node"), "node").limit(measured).join(nodes, "node").select("node", "vec")
    used, wide_by = windows(places, cut(true_neighbours(nodes, some, k), "neighbours"), block, count, target)
    placed = places.where(F.col("curve") < used).join(raw, "node").withColumn("block", F.expr(f"place div {block}"))
    near = F.explode(F.sequence(F.greatest(F.col("block") - wide_by, F.lit(0)), F.least(F.col("block") + wide_by, F.lit((count - 1) // block))))
    ask = placed.where("asked").select(F.col("curve").alias("c"), near.alias("b"), F.col("node").alias("query"), F.col("raw").alias("own"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "node": [], "score": []})
        x = np.frombuffer(b"".join(left["raw"]), wide).reshape(len(left), -1).astype(np.float64)
        y = np.frombuffer(b"".join(right["own"]), wide).reshape(len(right), -1).astype(np.float64)
        ids, out = left["node"].to_numpy(), []
        norms = np.square(x).sum(axis=1)
        keep = min(k + 1, len(x))
        for q in range(0, len(y), 256):
            part = y[q : q + 256]
            d = norms[None, :] - 2 * part @ x.T
            own = np.square(part).sum(axis=1)
            slack = 1e-9 * (1 + own + norms.max())  # the quick form's rounding; what is near the bound is looked at exactly
            i, j = np.nonzero(d <= (np.partition(d, keep - 1, axis=1)[:, keep - 1] + slack)[:, None])
            exact = np.sqrt(np.square(part[i] - x[j]).sum(axis=1))
            out.append(pd.DataFrame({"query": right["query"].to_numpy()[q + i], "node": ids[j], "score": exact}))
        return pd.concat(out)

    blocks = placed.select("curve", "block", "node", "raw")
    met = blocks.groupBy("curve", "block").cogroup(ask.groupBy("c", "b")).applyInPandas(meet, "query long, node long, score double")
    # a pair that several curves give has one score; the best of a query are found before anything but keys is sent on
    best = met.groupBy("query", "node").agg(F.min("score").alias("score")).withColumn("r", F.expr("row_number() over (partition by query order by score, node)")).where(F.col("r") <= k + 1)
    found = best.join(nodes.select("node", "ids"), "node").join(members, "query")
    pairs = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    final = pairs.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, vec_id)")).where(F.col("rank") <= k)
    return final.select("query_id", "rank", "vec_id", "score")
