"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of one batch, thinned to a spanning forest whose trees hang on their smallest node."""
    for pdf in parts:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := top.setdefault(x, x)) != x:
                top[x] = top[p] = top.setdefault(p, p)
                x = top[x]
            return x

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                top[max(x, y)] = min(x, y)
        rows = [(find(x), x) for x in list(top)]
        yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the smallest node reachable.

    Each round sends every node to the smallest of its neighbours and itself and renames the edges so; the
    graph shrinks until no edge is left, and the rounds' mappings are then joined backwards. Edges and mappings
    stay in tables; the driver learns only whether an edge is left. Nulls and self-loops are ignored.
    """
    left = cut(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(_forest, "a long, b long").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        up = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("parent")), "parents")
        rounds.append(up)
        renamed = (
            left.join(up.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        )
        left = cut(renamed.distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").cast("long").alias("node"), F.col("a").cast("long").alias("component")).where("false")
    label = rounds[-1].select("node", F.col("parent").alias("component"))
    for up in rounds[-2::-1]:
        above = label.select(F.col("node").alias("parent"), F.col("component").alias("higher"))
        label = up.join(above, "parent", "left").select("node", F.coalesce("higher", "parent").alias("component"))
    return label
