"""Folds over the rows of a key in order, in bounded memory: Spark sorts, a task carries one key's state from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame


def fold_sorted(df: DataFrame, keys: list[str], order: list[str | Column], inputs: list[str], outputs: str, start: Callable, step: Callable, finish: Callable | None = None) -> DataFrame:
    """Rows (keys, outputs) of a fold over each key's rows in `order`.

    state = start(); for each row's inputs step(state, *inputs) gives (state, row or None); after the last, finish(state) a
    row, if given. A key of any number of rows is a stream through one task that holds a batch and the state.
    """
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, state, known = None, None, False
        schema = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in batch.schema.names]
            types = [batch.schema.field(k).type for k in keys]
            out: list[tuple] = []
            for row in zip(*columns, strict=True):
                key = row[: len(keys)]
                if not known or key != own:
                    if known and finish:
                        out.append((*own, *finish(state)))
                    own, state, known = key, start(), True
                state, made = step(state, *row[len(keys) :])
                if made is not None:
                    out.append((*own, *made))
            schema = types
            yield _batch(pa, out, types)
        if known and finish:
            yield _batch(pa, [(*own, *finish(state))], schema)

    def _batch(pa, rows: list[tuple], types: list):
        columns = list(zip(*rows, strict=True)) or [()] * (len(types) + len(fields))
        arrays = [pa.array(c, t) for c, t in zip(columns, [*types, *[getattr(pa, ARROW[t])() for t in kind]], strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, *fields])

    fields = [x.split()[0] for x in outputs.split(", ")]
    kind = [x.split()[1] for x in outputs.split(", ")]
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *inputs)
    return ordered.mapInArrow(run, ", ".join([*kinds, outputs]))


ARROW = {"long": "int64", "int": "int32", "double": "float64", "string": "string", "boolean": "bool_"}


def running_digest(df: DataFrame, keys: list[str], text: str, name: str) -> DataFrame:
    """(keys, name, n): SHA-256 of each key's texts in order, joined by |, and how many there are; no group is held whole."""
    import hashlib

    def step(state, value):
        digest, n = state
        digest.update(f"{'|' if n else ''}{value}".encode())
        return (digest, n + 1), None

    return fold_sorted(df, keys, [text], [text], f"{name} string, n long", lambda: (hashlib.sha256(), 0), step, lambda s: (s[0].hexdigest(), s[1]))

