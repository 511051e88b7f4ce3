"""A1 to A6 over files that the given tables are written to, slice rules, and expressions of C and Z that have no other query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..adapters import ev_trades, table, with_views
from ..functions import text as X
from ..operators import ledger as L
from ..operators import quality as Q
from ..plans import features as P
from ..sources import catalog as C
from ..sources import files as S
from ..streaming import operators as Z
from . import query
from .relational import _LEDGER
from .streams import _finished, _stream


def _folder(spark, name: str) -> str:
    shared = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def _log(spark, sf_dir, spoil: bool = False) -> str:
    """The events as an event log in JSON lines, laid out by run and scenario; every line whose k is 13 broken, if asked."""
    at = _folder(spark, "log")
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    payload = F.to_json(F.struct(F.col("user_id").cast("string").alias("mint"), F.col("value").alias("quote")))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.lit("raw").alias("source"), k.alias("slot"), F.when(F.col("event_type") == "purchase", "buy").otherwise(F.col("event_type")).alias("kind"), payload.alias("payload")))
    if spoil:
        line = F.when(k == 13, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(line)
    e.select(line.alias("value"), F.concat(F.lit("r"), F.col("user_id") % 3).alias("run_id"), F.col("event_type").alias("scenario_id")).write.partitionBy("run_id", "scenario_id").text(at)
    return at


@query("SELECT event_id::VARCHAR AS event_id, CASE WHEN event_type = 'purchase' THEN 'buy' ELSE event_type END AS kind, (props->>'$.k')::BIGINT AS slot, 'r' || (user_id % 3) AS run_id, event_type AS scenario_id FROM events")
def a1_event_log(spark, sf_dir):
    return S.read_events(spark, _log(spark, sf_dir)).select("event_id", "kind", "slot", "run_id", "scenario_id")


@query("SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS mint, value AS quote FROM events WHERE user_id % 3 = 1 AND event_type = 'purchase'")
def a2_filtered_log(spark, sf_dir):
    x = S.typed(S.read_events(spark, _log(spark, sf_dir), run="r1", scenario="purchase"), "buy")
    return x.select("event_id", "mint", F.col("quote").cast("double").alias("quote"))


@query("SELECT event_type AS scenario_id, count(*) FILTER ((props->>'$.k')::BIGINT <> 13) AS good, count(*) FILTER ((props->>'$.k')::BIGINT = 13) AS bad FROM events GROUP BY 1")
def a3_tolerant_log(spark, sf_dir):
    e = S.read_events(spark, _log(spark, sf_dir, spoil=True)).cache()  # a corrupt-record column can't be asked for alone
    return e.groupBy("scenario_id").agg(F.count_if(F.col("_corrupt").isNull()).alias("good"), F.count_if(F.col("_corrupt").isNotNull()).alias("bad"))


@query("SELECT p_partkey, nullif(CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END, '') AS p_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS p_size FROM part")
def a4_csv_table(spark, sf_dir):
    at = _folder(spark, "csv")
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")).alias("p_name"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).cast("int").alias("p_size"))
    p.write.option("header", "true").option("emptyValue", "").csv(at)
    return S.read_csv(spark, at, "p_partkey long, p_name string, p_size int")


@query("SELECT o_orderstatus AS status, count(*) AS rows, sum(o_totalprice) AS price FROM orders GROUP BY 1")
def a5_append_log(spark, sf_dir):
    at = _folder(spark, "append")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey", "o_totalprice", "o_orderpriority")
    for urgent in (True, False):
        S.append(o.where((F.col("o_orderpriority") == "1-URGENT") == urgent), at, ["status"])
    return spark.read.parquet(at).groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("price"))


@query("SELECT o_orderstatus AS status, count(*) AS rows, true AS in_bounds, true AS named FROM orders GROUP BY 1")
def a6_snapshot_chunks(spark, sf_dir):
    at = _folder(spark, "chunks")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey", "o_totalprice")
    S.write_chunks(o, at, 400, ["status"])
    x = spark.read.parquet(at).withColumn("path", F.input_file_name())
    files = x.groupBy("status", F.element_at(F.split("path", "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    listed = files.join(S.manifest(spark, at).withColumnRenamed("rows", "listed"), "file", "left")
    return listed.groupBy("status").agg(F.sum("n").alias("rows"), (F.max("n") <= 400).alias("in_bounds"), F.bool_and(F.col("listed").isNotNull()).alias("named"))


_SLICES = """s AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 1 AS counted, o_custkey % 13 <> 2 AS r2_verified, CASE WHEN o_custkey % 17 = 3 THEN NULL ELSE o_orderkey % 19 <> 4 END AS artifact_consistency_ok, CASE WHEN o_orderkey % 7 = 5 THEN NULL ELSE greatest(0, o_custkey % 23 - 20) END AS sequence_gap_count,
    greatest(0, o_orderkey % 29 - 27) AS hash_mismatch_count, greatest(0, o_custkey % 31 - 29) AS receiver_backpressure_count, o_orderkey % 37 = 6 AS holder_rpc_enabled, o_custkey % 41 = 7 AS rpc_mint_supply_canonical, o_orderkey % 43 = 8 AS replay_allowed, o_custkey % 47 = 9 AS formal_backtesting_allowed,
    o_orderkey % 53 = 10 AS threshold_tuning_allowed, o_custkey % 59 = 11 AS live_trading_enabled FROM orders)"""


def _slices(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as k", "o_orderkey % 11 <> 1 as counted", "o_custkey % 13 <> 2 as r2_verified", "if(o_custkey % 17 = 3, null, o_orderkey % 19 <> 4) as artifact_consistency_ok", "if(o_orderkey % 7 = 5, null, greatest(0, o_custkey % 23 - 20)) as sequence_gap_count",
        "greatest(0, o_orderkey % 29 - 27) as hash_mismatch_count", "greatest(0, o_custkey % 31 - 29) as receiver_backpressure_count", "o_orderkey % 37 = 6 as holder_rpc_enabled", "o_custkey % 41 = 7 as rpc_mint_supply_canonical", "o_orderkey % 43 = 8 as replay_allowed", "o_custkey % 47 = 9 as formal_backtesting_allowed",
        "o_orderkey % 53 = 10 as threshold_tuning_allowed", "o_custkey % 59 = 11 as live_trading_enabled",
    )


_REASON = """concat_ws(';', CASE WHEN NOT counted THEN 'counted_phase107b_result_false' END, CASE WHEN NOT r2_verified THEN 'r2_not_verified' END, CASE WHEN NOT coalesce(artifact_consistency_ok, false) THEN 'artifact_consistency_not_ok' END, CASE WHEN coalesce(sequence_gap_count, 0) > 0 THEN 'sequence_gap_count_nonzero' END,
    CASE WHEN hash_mismatch_count > 0 THEN 'hash_mismatch_count_nonzero' END, CASE WHEN receiver_backpressure_count > 0 THEN 'receiver_backpressure_count_nonzero' END, CASE WHEN holder_rpc_enabled THEN 'holder_rpc_enabled' END, CASE WHEN rpc_mint_supply_canonical THEN 'rpc_mint_supply_canonical' END, CASE WHEN replay_allowed THEN 'replay_enabled' END,
    CASE WHEN formal_backtesting_allowed THEN 'formal_backtesting_enabled' END, CASE WHEN threshold_tuning_allowed THEN 'threshold_tuning_enabled' END, CASE WHEN live_trading_enabled THEN 'trading_enabled' END)"""


@query(f"WITH {_SLICES} SELECT k, {_REASON} AS reason, {_REASON} = '' AS included FROM s")
def a18_slice_inclusion(spark, sf_dir):
    return C.slice_checks(_slices(spark, sf_dir)).select("k", "reason", "included")


@query(f"""WITH {_SLICES}, g AS (SELECT k FROM s WHERE {_REASON} = ''), f AS (SELECT l_linenumber AS horizon, l_partkey AS mint, l_quantity AS q FROM lineitem WHERE l_orderkey IN (SELECT k FROM g)), l AS (SELECT count(*) AS labels FROM orders WHERE o_orderkey IN (SELECT k FROM g))
    SELECT horizon, count(*) AS rows, count(DISTINCT mint) AS mints, avg(q) AS mean_quantity, any_value(labels) AS labels FROM f, l GROUP BY 1""")
def a16_a22_mart_cut(spark, sf_dir):
    """The mart is written by horizon and read back; labels are orders, features are their lines."""
    slices = C.slice_checks(_slices(spark, sf_dir)).select(F.col("k").alias("slice_id"), "included")
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slice_id"), "o_totalprice")
    features = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slice_id"), F.col("l_linenumber").alias("horizon"), F.col("l_partkey").alias("mint"), F.col("l_quantity").alias("q"))
    good = slices.where("included").select("slice_id")
    at = _folder(spark, "mart")
    S.append(features.join(good, "slice_id", "left_semi"), f"{at}/features", ["horizon"])
    S.append(labels.join(good, "slice_id", "left_semi").withColumn("part", F.lit(0)), f"{at}/labels", ["part"])
    f = spark.read.parquet(f"{at}/features").groupBy("horizon").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("mint").alias("mints"), F.avg("q").alias("mean_quantity"))
    return f.crossJoin(F.broadcast(spark.read.parquet(f"{at}/labels").agg(F.count(F.lit(1)).alias("labels"))))  # one row


@query("""SELECT o_custkey AS run_id, count(*) AS segments, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderpriority = '1-URGENT') AS counted, count(*) FILTER (o_orderkey % 5 = 0) AS empty, sum(o_orderkey % 5) AS attempted, sum(o_totalprice) AS bytes, max(o_orderkey) AS last_segment FROM orders GROUP BY 1""")
def a20_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey as run_id", "o_orderkey as segment", "o_orderstatus = 'F' as verified", "o_orderpriority = '1-URGENT' as counted", "o_orderkey % 5 as attempted", "o_totalprice as bytes")
    return C.coverage(o)


_FLAGS = ["sequence_gap_count", "hash_mismatch_count", "receiver_backpressure_count", "receiver_unavailable_count", "r2_failed", "r2_local_spool_full", "artifact_consistency", "asof_alpha_feature_validation", "vps_forbidden_artifacts", "not_counted", "local_rc", "remote_relay_timeout", "missing_final_artifacts"]
_RESULT = [
    "o_custkey % 6 = 1 AS zero_attempt_no_signal", "o_orderkey % 4 AS all_launches_seen", "greatest(0, o_orderkey % 9 - 6) AS upstream_provider_blocker_count", "CASE WHEN o_custkey % 3 = 0 THEN 'x' ELSE NULL END AS provider_blocker_class", "greatest(0, o_custkey % 7 - 5) AS candidate_checkpoint_count", "o_orderkey % 3 AS replay_eligible_count",
    "o_custkey % 5 = 2 AS replay_allowed",
]


@query(f"""WITH s AS (SELECT o_orderkey AS k, list_filter([{', '.join(f"CASE WHEN (o_orderkey + o_custkey) % {23 + 2 * i} = {i} THEN '{n}' END" for i, n in enumerate(_FLAGS))}], lambda x: x IS NOT NULL) AS b, {', '.join(_RESULT)} FROM orders),
    c AS (SELECT *, CASE WHEN len(b) = 0 THEN CASE WHEN zero_attempt_no_signal THEN CASE WHEN all_launches_seen = 0 THEN 'RELAY_LOCAL_DATASET_PASS_EMPTY_NO_ATTEMPTS' ELSE 'RELAY_LOCAL_DATASET_PASS_NO_SIGNAL' END WHEN upstream_provider_blocker_count > 0 THEN 'RELAY_PROVIDER_GAP_CONTINUATION_PASS' ELSE 'RELAY_LOCAL_DATASET_PASS' END
        ELSE 'RELAY_LOCAL_DATASET_BLOCK_' || CASE WHEN list_contains(b, 'sequence_gap_count') THEN 'SEQUENCE_GAP' WHEN list_contains(b, 'hash_mismatch_count') THEN 'HASH_MISMATCH' WHEN list_contains(b, 'receiver_backpressure_count') THEN 'RECEIVER_BACKPRESSURE' WHEN list_contains(b, 'receiver_unavailable_count') THEN 'RECEIVER_UNAVAILABLE'
            WHEN list_contains(b, 'r2_failed') THEN 'R2' WHEN list_contains(b, 'r2_local_spool_full') THEN 'SPOOL' WHEN list_contains(b, 'artifact_consistency') THEN 'ARTIFACT_CONSISTENCY' WHEN list_contains(b, 'asof_alpha_feature_validation') THEN 'ASOF_ALPHA_FEATURES' WHEN list_contains(b, 'vps_forbidden_artifacts') THEN 'VPS_FORBIDDEN_ARTIFACTS'
            WHEN list_contains(b, 'not_counted') AND provider_blocker_class = 'x' THEN 'PROVIDER' WHEN list_contains(b, 'not_counted') THEN 'COUNTABILITY' WHEN list_contains(b, 'local_rc') OR list_contains(b, 'remote_relay_timeout') THEN 'ORCHESTRATION' ELSE 'STRUCTURAL' END END AS class FROM s)
    SELECT k, array_to_string(b, '|') AS blockers, class, CASE WHEN zero_attempt_no_signal THEN CASE WHEN all_launches_seen = 0 THEN 'RELAY_LOCAL_DATASET_PASS_EMPTY_NO_ATTEMPTS' ELSE 'RELAY_LOCAL_DATASET_PASS_NO_SIGNAL' END WHEN candidate_checkpoint_count > 0 OR (replay_eligible_count > 0 AND replay_allowed) THEN 'RELAY_COLLECTION_PASS_REVIEW_CANDIDATE'
        WHEN upstream_provider_blocker_count > 0 THEN 'RELAY_COLLECTION_PASS_PROVIDER_GAP_CONTINUED' ELSE 'RELAY_COLLECTION_PASS_COUNTED_NO_CANDIDATE' END AS collected FROM c""")
def a21_slice_classes(spark, sf_dir):
    b = F.array_compact(F.array(*[F.when((F.col("o_orderkey") + F.col("o_custkey")) % (23 + 2 * i) == i, n) for i, n in enumerate(_FLAGS)]))
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), b.alias("blockers"), *[F.expr(e) for e in _RESULT])
    return x.select("k", F.array_join("blockers", "|").alias("blockers"), C.slice_class().alias("class"), C.collection_class().alias("collected"))


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderkey % 5 = 1 AS lp, greatest(0, o_custkey % 7 - 4) AS rc, o_orderkey % 6 = 2 AS pr, o_custkey % 4 AS fr, o_orderkey % 3 = 0 AS mp, o_custkey % 5 <> 1 AS co, o_custkey % 2 = 0 AS rp, o_orderkey % 4 <> 3 AS ro FROM orders),
    c AS (SELECT k, CASE WHEN lp AND rc > 0 THEN 'AVAILABLE_LOCAL_AND_R2' WHEN lp THEN 'AVAILABLE_LOCAL' WHEN rc > 0 THEN 'AVAILABLE_R2' WHEN pr THEN 'PRUNED_AFTER_VERIFICATION' WHEN fr = 0 AND NOT mp THEN 'NOT_CAPTURED' WHEN NOT co OR (rp AND NOT ro) THEN 'UNVERIFIED_ABORTED_RUN' ELSE 'UNKNOWN_NEEDS_MANUAL_REVIEW' END AS c FROM s)
    SELECT k, 'RAW_FRAMES_' || c AS class, c LIKE 'AVAILABLE%' AS usable FROM c""")
def a23_raw_frames(spark, sf_dir):
    x = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_orderkey % 5 = 1 as local_present", "greatest(0, o_custkey % 7 - 4) as r2_count", "o_orderkey % 6 = 2 as pruned", "o_custkey % 4 as frames_received", "o_orderkey % 3 = 0 as relay_manifest_present", "o_custkey % 5 <> 1 as completed", "o_custkey % 2 = 0 as r2_present", "o_orderkey % 4 <> 3 as retention_ok")
    x = x.select("k", C.raw_frames_class().alias("class"))
    return x.withColumn("usable", F.col("class").contains("_AVAILABLE"))


@query("""SELECT event_id, CASE WHEN k % 5 = 0 AND k % 3 = 0 THEN NULL ELSE 'cul:' || coalesce(CASE WHEN k % 5 <> 0 THEN k * 1000 END::VARCHAR, 'na') || '|cup:' || coalesce(CASE WHEN k % 3 <> 0 THEN k END::VARCHAR, 'na') || '|acct:na|ix:' || coalesce(CASE WHEN k % 5 <> 0 THEN 3 END::VARCHAR, 'na') || '|pgm:na' END AS fingerprint
    FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events)""")
def c13_client_fingerprints(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    none = F.lit(None).cast("long")
    return table(spark, sf_dir, "events").select("event_id", X.client_fingerprint(F.when(k % 5 != 0, k * 1000), F.when(k % 3 != 0, k), none, F.when(k % 5 != 0, F.lit(3)), none).alias("fingerprint"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN NULL ELSE epoch_us(o_orderdate::TIMESTAMP) + 3600000000 END AS us FROM orders""")
def c17_timestamps(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(day, F.lit("T01:00:00Z"))
    kind = F.col("o_orderkey") % 5
    stated = F.when(kind == 0, text).when(kind == 1, F.concat(day, F.lit(" 01:00:00 UTC"))).when(kind == 2, F.concat(F.lit(" "), day, F.lit("T01:00:00 "))).when(kind == 3, F.concat(F.lit("['"), text, F.lit("']"))).otherwise("no time")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(X.timestamp_of(stated)).alias("us"))


@query("""WITH r AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'late' END, CASE WHEN o_custkey % 4 = 0 THEN 'gap' END, CASE WHEN o_orderkey % 5 = 0 THEN 'thin' END], lambda x: x IS NOT NULL) AS r FROM orders)
    SELECT o_orderkey, CASE WHEN list_contains(r, 'gap') THEN 'gap' WHEN list_contains(r, 'thin') THEN 'thin' WHEN list_contains(r, 'late') THEN 'late' END AS gate FROM r""")
def c20_first_gate(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    reasons = F.array_compact(F.array(F.when(k % 3 == 0, "late"), F.when(c % 4 == 0, "gap"), F.when(k % 5 == 0, "thin")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.first_gate(reasons, ["gap", "thin", "late"]).alias("gate"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"status":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS row_hash FROM orders""")
def c21_row_hash(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return o.select("o_orderkey", X.row_hash(["status", "o_orderkey", "o_custkey"]).alias("row_hash"))


@query("""SELECT o_orderkey, 'm' || o_custkey || CASE WHEN o_orderkey % 3 <> 0 THEN ',m' || (o_custkey + 1) ELSE '' END AS mints, CASE WHEN o_orderkey % 3 <> 0 THEN 2 ELSE 1 END AS n FROM orders""")
def c22_mint_lists(spark, sf_dir):
    m = F.concat(F.lit("m"), F.col("o_custkey").cast("string"))
    other = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("m"), (F.col("o_custkey") + 1).cast("string"))).otherwise(m)
    x = table(spark, sf_dir, "orders").select("o_orderkey", X.mint_list(F.concat(F.lit(" "), m, F.lit(" |, "), other, F.lit(","))).alias("l"))
    return x.select("o_orderkey", F.array_join("l", ",").alias("mints"), F.size("l").alias("n"))


@query("""WITH f AS (SELECT user_id AS mint, count(*) AS trades, sum(value) FILTER (event_type = 'purchase') AS volume, min(event_type) FILTER (value > 90) AS kind FROM events GROUP BY 1)
    SELECT 'trades' AS feature, 'bigint' AS kind, 'flow' AS category, count(trades) AS available, count(*) - count(trades) AS missing FROM f UNION ALL SELECT 'volume', 'double', 'flow', count(volume), count(*) - count(volume) FROM f UNION ALL SELECT 'kind', 'string', 'other', count(kind), count(*) - count(kind) FROM f""")
def f24_registry(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "mint")
    f = e.groupBy("mint").agg(F.count(F.lit(1)).alias("trades"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("volume"), F.min(F.when(F.col("value") > 90, F.col("event_type"))).alias("kind"))
    seen = P.long(f, "mint").groupBy("feature").agg(F.count_if(F.col("status") == "available").alias("available"), F.count_if(F.col("status") == "missing").alias("missing"))
    return P.registry(f, {"trades": "flow", "volume": "flow"}).join(seen, "feature")


def _streamed_positions(spark, sf_dir):
    """The last ledger row of each (mint, wallet) that the stateful stream gives."""
    e = _stream(spark, sf_dir).where("event_type in ('purchase', 'error')")
    side = F.when(F.col("event_type") == "purchase", "buy").otherwise("sell")
    seq = F.unix_micros("ts")
    t = e.select(F.col("user_id").alias("mint"), F.col("k").alias("wallet"), side.alias("side"), F.col("value").alias("quote"), (F.col("k") + 10.0).alias("tokens"), (F.col("value") / (F.col("k") + 10.0)).alias("price"), seq.alias("us"), F.col("event_id").alias("seq"))
    return _finished(spark, Z.positions(t), "ledger").groupBy("mint", "wallet").agg(F.max_by(F.struct("held", "cost", "realised"), "seq").alias("p")).select("mint", "wallet", "p.*")


@query(with_views("ev", sql=_LEDGER + " SELECT mint, wallet, held, cost, realised FROM p").replace("WITH", "WITH RECURSIVE", 1))
def z5_stream_ledger(spark, sf_dir):
    return _streamed_positions(spark, sf_dir)


@query(with_views("ev", sql="p AS (SELECT DISTINCT mint, wallet FROM ev) SELECT 'both' AS side, count(*) AS positions FROM p"))
def z9_replay_equals_live(spark, sf_dir):
    """Positions of the stream and of the batch ledger, by where they are; a position that differs counts for either side."""
    r = lambda df: df.select("mint", "wallet", *[F.round(F.col(c) + 1.3e-8, 6).alias(c) for c in ("held", "cost", "realised")])
    live, replay = r(_streamed_positions(spark, sf_dir)), r(L.positions(ev_trades(spark, sf_dir)))
    both = live.withColumn("live", F.lit(1)).join(replay.withColumn("replay", F.lit(1)), ["mint", "wallet", "held", "cost", "realised"], "full")
    return both.groupBy(F.when(F.col("live").isNull(), "replay_only").when(F.col("replay").isNull(), "live_only").otherwise("both").alias("side")).agg(F.count(F.lit(1)).alias("positions"))


@query("""WITH e AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 86400000000 AS day FROM events), d AS (SELECT day, count(*) > (SELECT count(*) / count(DISTINCT day) FROM e) AS over FROM e GROUP BY 1) SELECT event_id, NOT over AS allowed FROM e JOIN d USING (day)""")
def z10_gap_fail_closed(spark, sf_dir):
    """A day with more events than the mean day overflows: a global gap from its start, until the next day's that doesn't. Nothing is allowed within."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("seq"), F.col("user_id").alias("mint"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("day", F.expr("us div 86400000000"))
    days = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    mean = days.agg((F.sum("n") / F.count(F.lit(1))).alias("mean"))
    g = days.join(F.broadcast(mean), F.lit(True)).select(F.lit("global").alias("scope"), F.lit(0).cast("long").alias("key"), (F.col("day") * 86_400_000_000).alias("us"), (F.col("n") <= F.col("mean")).alias("recovered"))  # mean is one row
    return Q.trade_allowed(e, Q.gap_intervals(g, 4_102_444_800_000_000), 86_400_000_000).select("event_id", "allowed")
