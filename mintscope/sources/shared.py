"""Tables that a job needs twice, written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in a session on one machine, a folder beside the warehouse's tables."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return own.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a short lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task gets of a table that `spread` deals out.
ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of about `rows` rows, dealt out by the hash of keys: to the session's number of tasks, and to more where a task would get over ROWS, so that what it sorts or counts doesn't grow with the table."""
    n = -(-rows // ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def sum_before(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows before each in `order`, which has to be total.

    The rows are range-sorted over all tasks; a task sums its own block, and one row a block carries on what came before.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumns({"__block": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "sorted")
    sums = placed.groupBy("__block").agg(F.sum(value).alias("__sum"))
    bases = sums.select("__block", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # one row a block
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.withColumn(name, own).join(F.broadcast(bases), "__block")
    return out.withColumn(name, F.col(name) + F.col("__base")).drop("__block", "__at", "__base")
