"""The registered queries over the provided tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_READY: set[str] = set()


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Added before rounding on both sides, so that sums in another order don't fall to different sides of a tie.
_NUDGE, _DIGITS = 1.3e-8, 6
_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def _rounded(f, columns: list[list[str]]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*[F.round(F.col(c) + _NUDGE, _DIGITS).alias(c) if t == "double" else F.col(c) for c, t in columns])

    return run


def _cast(sql: str, columns: list[list[str]]) -> str:
    cell = lambda c, t: f'round(CAST("{c}" AS DOUBLE) + {_NUDGE}, {_DIGITS}) AS "{c}"' if t == "double" else f'CAST("{c}" AS {_SQL_TYPES[t]}) AS "{c}"' if t in _SQL_TYPES else f'"{c}"'
    return f"SELECT {', '.join(cell(c, t) for c, t in columns)} FROM ({sql}) AS q"


def load(wrap: bool = True) -> None:
    """Fills QUERIES and ORACLES; doubles are rounded alike in both, and the SQL's columns get the query's types."""
    from . import aggregation, catalogue, chain, defence, diagnostics, families, features, gates, outcomes, relational, research, sources, streams, summaries, timeseries, updates  # noqa: F401
    from .results import RESULTS

    for n in [n for n in QUERIES if n not in _READY] if wrap else []:
        _READY.add(n)
        columns = [x.rsplit(" ", 1) for x in RESULTS[n].split(", ")]
        QUERIES[n] = _rounded(QUERIES[n], columns)
        if n in ORACLES:
            ORACLES[n] = _cast(ORACLES[n], columns)
