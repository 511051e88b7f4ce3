"""Event logs and tables in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EVENT, PAYLOADS


def read_events(spark: SparkSession, path: str, run: str | None = None, scenario: str | None = None) -> DataFrame:
    """An event log in JSON lines; malformed lines come with _corrupt set and everything else null.

    Where the log is laid out by run_id and scenario_id, only the asked folders are listed.
    """
    schema = T.StructType([*EVENT.fields, T.StructField("run_id", T.StringType()), T.StructField("scenario_id", T.StringType()), T.StructField("_corrupt", T.StringType())])
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("ignoreCorruptFiles", "true").json(path)
    for c, v in (("run_id", run), ("scenario_id", scenario)):
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a tolerant scan."""
    return events.where("_corrupt is null").drop("_corrupt"), events.where("_corrupt is not null").select("_corrupt")


def typed(events: DataFrame, kind: str) -> DataFrame:
    """One kind's rows with its payload as columns."""
    payload = F.from_json("payload", PAYLOADS[kind], {"mode": "PERMISSIVE"})
    rest = [c for c in events.columns if c not in ("payload", "kind")]
    return events.where(F.col("kind") == kind).select(*rest, payload.alias("p")).select(*rest, "p.*")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header; an empty field is missing."""
    return spark.read.schema(schema).option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def append(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def write_chunks(df: DataFrame, path: str, rows: int, by: list[str]) -> None:
    """Parquet files of at most `rows` rows."""
    df.write.mode("append").option("maxRecordsPerFile", rows).partitionBy(*by).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows) of a table's files."""
    return spark.read.parquet(path).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """Runs under one schema, widened by every run's own columns."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def stream_events(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """An event log as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).json(path)
