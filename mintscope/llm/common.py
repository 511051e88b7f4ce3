"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one under the warehouse where that is unset."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """df for a join with rows that came of an explode, which the planner sizes like those before it: sorted and merged, never sent whole through the driver."""
    return df.hint("merge")


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Python gets at most `rows` rows at a time from now on, so that a batch of whole texts stays small beside an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def docs_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of df's own."""
    own = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        n = w
        while n.lower() in own:
            n = "_" + n
        own.add(n.lower())
        out.append(n)
    return out
