"""Z: streaming forms, run to the end over the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import ev_trades, with_views
from ..operators.windows import TTL
from ..streaming import operators as S
from . import query
from .timeseries import _STATES, lifecycle_marks


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "user_id", "event_type", "value", k.alias("k"), F.col("ts").cast("timestamp").alias("ts"))


def _finished(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    shared = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    at = f"{shared}/{name}-{uuid.uuid4().hex}"
    S.run_once(stream, f"{at}/state", f"{at}/rows")
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


@query("SELECT user_id, (props->>'$.k')::BIGINT AS k, 1 AS kept, count(*) AS reports, true AS is_one_of_them FROM events GROUP BY 1, 2")
def z6_stream_dedup(spark, sf_dir):
    """What the stream keeps of each key (which report that is, depends on arrival), beside the key's reports."""
    out = _finished(spark, S.deduplicated(_stream(spark, sf_dir), ["user_id", "k"], "60 days"), "dedup")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    x = e.join(out.select("event_id", F.lit(True).alias("there")), "event_id", "left").groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("reports"), F.count("there").alias("own"))
    kept = out.groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(x, ["user_id", "k"], "full").select("user_id", "k", "kept", "reports", (F.col("own") == F.col("kept")).alias("is_one_of_them"))


@query("""WITH w AS (SELECT user_id, epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT * FROM w WHERE n > 4 AND start_us + 86400000000 <= (SELECT max(epoch_us(ts)) FROM events)""")
def z1_z2_stream_rate(spark, sf_dir):
    out = _finished(spark, S.per_key_rate(_stream(spark, sf_dir), "user_id", "1 day", 4, "0 seconds"), "rate")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("""WITH e AS (SELECT user_id AS mint, value, event_type, epoch_us(ts) AS us FROM events WHERE event_type IN ('purchase', 'error')), w AS (SELECT *, unnest([1, 2]) * 43200000000 + us // 43200000000 * 43200000000 AS end_us FROM e)
    SELECT mint, end_us, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS buy_volume, sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value END) AS net_flow FROM w
    WHERE end_us <= (SELECT max(us) FROM e) GROUP BY 1, 2""")
def z3_stream_sliding_flow(spark, sf_dir):
    t = _stream(spark, sf_dir).where("event_type in ('purchase', 'error')").select(F.col("user_id").alias("mint"), F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("side"), F.col("value").alias("quote"), "ts")
    out = _finished(spark, S.sliding_flow(t, "1 day", "12 hours", "0 seconds"), "flow")
    return out.select("mint", F.unix_micros("end").alias("end_us"), "buy_volume", "net_flow")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN event_type = 'purchase' THEN 43200000000 ELSE 21600000000 END AS gap FROM events),
    g AS (SELECT *, us >= max(us + gap) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut FROM e), s AS (SELECT *, sum(coalesce(cut, true)::INT) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g),
    x AS (SELECT user_id, min(us) AS start_us, max(us + gap) AS end_us, count(*) AS n FROM s GROUP BY user_id, k) SELECT * FROM x WHERE end_us <= (SELECT max(us) FROM e)""")
def z4_stream_sessions(spark, sf_dir):
    out = _finished(spark, S.sessions(_stream(spark, sf_dir), "user_id", "CASE WHEN event_type = 'purchase' THEN '12 hours' ELSE '6 hours' END", "0 seconds"), "sessions")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""WITH e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, ts FROM events), a AS (SELECT event_id, user_id * 1000 + k AS key, ts FROM e WHERE event_type = 'click'), b AS (SELECT user_id * 1000 + k AS key, ts FROM e WHERE event_type = 'view'),
    w AS (SELECT least((SELECT max(epoch_ms(ts)) FROM a), (SELECT max(epoch_ms(ts)) FROM b)) - 86400000 AS w), j AS (SELECT a.key, epoch_us(a.ts) AS t_us, epoch_us(b.ts) AS c_us FROM a LEFT JOIN b ON a.key = b.key AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 DAY)
    SELECT key, t_us, c_us, CASE WHEN c_us IS NULL THEN 'unmatched' ELSE 'matched' END AS outcome FROM j, w WHERE c_us IS NOT NULL OR t_us + 864000000000 < w * 1000""")
def z7_stream_reconcile(spark, sf_dir):
    """Matched pairs, and what is left alone once the watermark (a day behind the slower side) has passed its ten days."""
    e = _stream(spark, sf_dir).withColumn("key", F.col("user_id") * 1000 + F.col("k"))
    out = _finished(spark, S.reconciled(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "10 days", "1 day"), "reconcile")
    return out.select("key", F.unix_micros("t_ts").alias("t_us"), F.unix_micros("c_ts").alias("c_us"), "outcome")


@query(with_views("ev", sql=_STATES + """
    SELECT mint, us, seq, 'transition' AS kind, coalesce(p, 'Discovered') AS was, state, n, holders, buyers, expires_us FROM e WHERE coalesce(p, 'Discovered') <> state
    UNION ALL SELECT mint, us, seq, 'expiry', NULL, state, NULL, NULL, NULL, expires_us FROM e WHERE next_us IS NULL OR next_us > expires_us"""))
def z5_w19_w20_stream_lifecycle(spark, sf_dir):
    """Transitions and expiries from a stream that gets a third of the time at a time, goes on from its checkpoint each time, and is drained at last by an event a year later."""
    trades = ev_trades(spark, sf_dir).select("mint", "us", "seq", "wallet", "side", F.col("tokens").cast("double").alias("tokens"), F.lit(None).cast("string").alias("mark"))
    marks = lifecycle_marks(spark, sf_dir).select("mint", "us", "seq", F.lit(None).cast("long").alias("wallet"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("tokens"), "mark")
    events = trades.union(marks).withColumn("ts", F.timestamp_micros("us"))
    shared = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    at = f"{shared}/lifecycle-{uuid.uuid4().hex}"
    first, last = events.agg(F.min("us"), F.max("us")).first()
    drain = spark.range(1).select(F.lit(-1).cast("long").alias("mint"), F.lit((last or 0) + 366 * 86_400_000_000).alias("us"), F.lit(-1).cast("long").alias("seq"), F.lit(-1).cast("long").alias("wallet"), F.lit("buy").alias("side"), F.lit(0.0).alias("tokens"), F.lit(None).cast("string").alias("mark")).withColumn("ts", F.timestamp_micros("us"))
    with S.rocksdb(spark):
        for i in range(4):
            lo, hi = (first or 0) + ((last or 0) - (first or 0)) * i // 3, (first or 0) + ((last or 0) - (first or 0)) * (i + 1) // 3
            part = events.where(F.col("us").between(lo + (i > 0), hi)) if i < 3 else drain
            part.write.mode("append").parquet(f"{at}/in")
            S.run_once(S.lifecycle(spark.readStream.schema(events.schema).parquet(f"{at}/in"), TTL), f"{at}/state", f"{at}/rows")
    return spark.read.schema(S.LIFECYCLE).parquet(f"{at}/rows").where("mint <> -1")
